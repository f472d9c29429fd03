"""Facts against their evidence: supported numbers, dates and counts, typed anchors, coverage and copy risk. Plain Python,
batched by the callers through `python_text.arrow`."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

from ..functions.numerals import canonical, digits, evidence_numbers as evidence_numbers, fact_numbers as fact_numbers, shown_numbers, surface, ungrouped, unit_integer
from ..functions.python_text import bare, sequence_ratio

numeric_surface = surface

# Measure words by the type of anchor that they make, words that make a quantity vague, marks around names.
MONEY = "亿元 万元 美元 欧元 元".split()
SHARE = "% 个百分点".split()
THINGS = "公里 平方米 小时 分钟 米 吨 秒 人 名 户 家 辆 台 座 个 款 条 项 件 份 次 套 倍 天 年 月 支 部 本 维 届 场 位 所 只".split()
VAGUE = "超过 不足 低于 超 近 约 上 数 几 多 第 零下".split()
_NUMERAL = "零〇一二两三四五六七八九十百千万亿"
_DATE = re.compile(r"(?:(?P<y>\d{4})年)?(?:(?P<m>\d{1,2})月)?(?:(?P<d>\d{1,2})[日号])?")
_RULES = (
    ("date_year", re.compile(r"\d{4}年(?:\d{1,2}月)?(?:\d{1,2}[日号])?|\d{1,2}月\d{1,2}[日号]|\d{1,2}[点时](?:\d{1,2}分|半)?")),
    *(
        (kind, re.compile(rf"(?:{'|'.join(VAGUE)})?(?:-?\d+(?:\.\d+)?|[{_NUMERAL}]+|若干)[十百千万亿]*(?:余|多)?(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?:以上|以下)?"))
        for kind, words in (("amount", MONEY), ("percentage", SHARE), ("number", THINGS))
    ),
    ("number", re.compile(r"(?<![A-Za-z\d.])\d+(?:\.\d+)?(?![A-Za-z\d])")),
    ("unclassified_named_span", re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[-+./][A-Za-z0-9]+)*|(?<=[“「])[^“”「」]{2,50}(?=[”」])")),
)


# Patterns over whole texts; those that begin with a digit pass over text without numbers quickly.
_DIGIT = re.compile(r"\d")
_COUNTED = re.compile(rf"(\d(?<!\d\d)\d*)(?:{'|'.join(THINGS)}|大|类|种|方面)")
_POINTS = re.compile(r"(?:^|[\n。；;])\s*(?:第([一二三四五六七八九十]+)[，、是]|[(（]?([一二三四五六七八九十]+|\d{1,2})[)）、.．])")
_PLAIN_DATE = re.compile(r"(\d(?<!\d\d)\d{3})[.\-/](\d{1,2})[.\-/](\d{1,2})(?!\d)")
_DAYS = re.compile(r"(\d(?<!\d\d)\d?)月(\d{1,2})-(\d{1,2})[日号]")
_DAYS_AFTER = re.compile(r"-(\d{1,2})(?:日|号)")
_DAY_BEFORE = re.compile(r"(\d{1,2})-$")
_SENTENCE_END = re.compile("[。！？\n]")


class Evidence:
    """Paragraphs that facts cite. Numbers, dates and lists are read when a fact first asks for them, once for all facts."""

    def __init__(self, *paragraphs: str):
        self.paragraphs = paragraphs
        self._dates_by: dict[tuple[int, ...], set] = {}

    @property
    def text(self) -> str:
        return "\n".join(self.paragraphs)

    @cached_property
    def numbers(self) -> set[str]:
        return evidence_numbers(self.text)

    @cached_property
    def dates(self) -> set[tuple[int | None, int | None, int | None]]:
        return _dates(self.text)

    @cached_property
    def listed(self) -> set[int]:
        """Numbers of items between 、 in one sentence; after the last 、 a word for "and" parts two items as well."""
        out = set()
        for s in re.split("[。！？；;\n]", self.text):
            if "、" in s:
                last = s.rpartition("、")[2]
                out.add(s.count("、") + 1 + s.count("以及") + len(re.findall("[和及与]", last.replace("以及", ""))))
        return out

    @cached_property
    def numbered(self) -> set[int]:
        """Numbers at the heads of points."""
        return {v for a, b in _POINTS.findall(self.text) if (v := int(b) if b.isdigit() else unit_integer(a or b))}

    def names(self, want: tuple[int | None, int | None, int | None]) -> bool:
        """Whether a date agrees with what is given of another."""
        given = tuple(k for k, w in enumerate(want) if w is not None)
        if given not in self._dates_by:
            self._dates_by[given] = {tuple(d[k] for k in given) for d in self.dates}
        return tuple(want[k] for k in given) in self._dates_by[given]


def _evidence(x: str | Evidence) -> Evidence:
    return x if isinstance(x, Evidence) else Evidence(x)


def unsupported_numbers(fact: str, evidence: str | Evidence) -> list[str]:
    return _missing_numbers(surface(fact), _evidence(evidence))


def _missing_numbers(x: str, evidence: Evidence) -> list[str]:
    """Unsupported numbers of a fact in its surface form."""
    shown = shown_numbers(x)
    left = shown - evidence.numbers if shown else shown
    if not left:
        return []
    counted = set(_COUNTED.findall(x))
    return sorted(n for n in left if not _counts(n, counted, evidence))


def _counts(number: str, counted: set[str], evidence: Evidence) -> bool:
    if not number.isdigit() or number not in counted or len(digits(number)) > 2 or not 2 <= (n := int(digits(number))) <= 50:
        return False
    return n in evidence.listed or set(range(1, n + 1)) == evidence.numbered


def count_supported(number: str, fact: str, evidence: str | Evidence) -> bool:
    """Whether a count of a fact follows from a list in the evidence: as many items between 、 in one sentence, or as
    many numbered points. The fact must give the number a measure word."""
    return _counts(number, set(_COUNTED.findall(surface(fact))), _evidence(evidence))


def _named(x: str) -> Iterator[re.Match]:
    """Dates of a text in its surface form, in order."""
    at = 0 if any(c in x for c in "年月日号") else len(x)
    while start := _DIGIT.search(x, at):
        m = _DATE.match(x, start.start())
        if m[0]:
            yield m
        at = m.end() if m[0] else start.end()


def _dates(text: str) -> set[tuple[int | None, int | None, int | None]]:
    """(year, month, day) that a text names. A later day takes month and year of the date before it, as in 5月1日至3日."""
    x = _PLAIN_DATE.sub(r"\1年\2月\3日", surface(text))
    out: set = set()
    year = month = None
    end = 0
    for m in _named(x):
        y, mo, d = (int(v) if v else None for v in m.group("y", "m", "d"))
        if y is None and mo is None and _SENTENCE_END.search(x, end, m.start()):
            month = None  # a bare day looks for its month in its own sentence
        end = m.end()
        year, month = y or year, mo if mo or y else month
        out |= {(a, b, d) for a in {y, year, None} for b in {mo, month} if (b or d is None)}
        if d and (r := _DAYS_AFTER.match(x, end)):
            out |= {(a, month, k) for a in {year, None} for k in range(d, int(r[1]) + 1)}
        if d and month and (r := _DAY_BEFORE.search(x[max(0, m.start() - 4) : m.start()])):
            out |= {(a, month, k) for a in {year, None} for k in range(int(r[1]), d + 1)}
    for m in _DAYS.finditer(x):
        out |= {(a, int(m[1]), k) for a in {year, None} for k in range(int(m[2]), int(m[3]) + 1)}
    return out


def date_supported(token: str, evidence: str | Evidence) -> bool:
    """Whether evidence names a date of a fact (2024年5月1日, 5月1日, 5月, 2024年), written out, with points, within a range
    of days, or as a bare day whose month stands before it."""
    m = _DATE.fullmatch(surface(token).strip())
    if m is None or not m[0]:
        return token in _evidence(evidence).text
    return _evidence(evidence).names(tuple(int(v) if v else None for v in m.group("y", "m", "d")))


def unsupported_dates(fact: str, evidence: str | Evidence) -> list[str]:
    return _missing_dates(surface(fact), _evidence(evidence))


def _missing_dates(x: str, evidence: Evidence) -> list[str]:
    """Unsupported dates of a fact in its surface form."""
    return sorted(t for t in {m[0] for m in _named(x) if m["m"] or m["y"]} if not date_supported(t, evidence))


def anchors(text: str, lexicon: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, str, int, int]]:
    """(type, canonical value, start, end) of typed spans: names of a lexicon (longest first), dates, quantities, vague
    ones too, numbers and open names; spans don't overlap, a type and value is listed once, in order of place."""
    x = ungrouped(re.sub(r"\s+", "", unicodedata.normalize("NFKC", text or "")))
    names = sorted(((n, kind) for kind, ns in (lexicon or {}).items() for n in ns), key=lambda p: (-len(p[0]), p))
    rules = [(kind, re.compile(("(?<![0-9A-Za-z])" if n[:1].isascii() else "") + re.escape(n), re.I)) for n, kind in names]
    free = [(0, len(x))]
    spans: list[tuple[int, int, str]] = []
    for kind, rule in (*rules, *_RULES):
        left = []
        for lo, hi in free:  # what no earlier rule has taken
            for m in rule.finditer(x, lo, hi):
                spans.append((*m.span(), kind))
                left.append((lo, m.start()))
                lo = m.end()
            left.append((lo, hi))
        free = [(a, b) for a, b in left if a < b]
    out: dict[tuple[str, str], tuple[str, str, int, int]] = {}
    for a, b, kind in sorted(spans):
        value = canonical(x[a:b])
        out.setdefault((kind, value), (kind, value, a, b))
    return list(out.values())


def retention(facts: list[str], text: str, lexicon: dict[str, tuple[str, ...]] | None = None) -> tuple[list, list, list]:
    """(retained, missing, new) anchors of a text against its facts, as (type, value)."""
    own, got = ({a[:2] for a in anchors(x, lexicon)} for x in ("\n".join(facts), text))
    return sorted(own & got), sorted(own - got), sorted(got - own)


def copy_risk(fact: str, sentences: list[str]) -> float:
    """Greatest sequence similarity of a fact with a sentence of its source."""
    return max((sequence_ratio(fact, s) for s in sentences), default=0.0)


def validate_facts(facts: list[dict], paragraphs: list[str], max_copy: float | None = None) -> list[str]:
    """Codes of what is wrong with numbered facts (fact, evidence_paragraph_ids, evidence_sha256): sequence, references,
    hash of the evidence where one is given, support of numbers and dates, repeats, and copying where a bound is given."""
    out: list[str] = []
    first: dict[str, int] = {}
    read: dict[tuple[int, ...], Evidence] = {}  # facts of one paragraph cite it each: it is read once
    for i, f in enumerate(facts, 1):
        refs = f.get("evidence_paragraph_ids") or []
        known = bool(refs) and all(1 <= r <= len(paragraphs) for r in refs)
        key = tuple(refs) if known else ()
        evidence = read.get(key) or read.setdefault(key, Evidence(*[paragraphs[r - 1] for r in key]))
        given = f.get("evidence_sha256")
        x = surface(f["fact"]) if known else ""
        checks = {
            "fact_sequence": f.get("fact_id") != f"F{i:02d}",
            "evidence_reference": not known,
            "evidence_hash": known and given is not None and given != hashlib.sha256(evidence.text.encode()).hexdigest(),
            "unsupported_number": known and bool(_missing_numbers(x, evidence)),
            "unsupported_date": known and bool(_missing_dates(x, evidence)),
            "duplicate_fact": known and first.setdefault(bare(f["fact"]), i) != i,
            "copy_risk": known and max_copy is not None and copy_risk(f["fact"], re.split("[。！？；\n]", evidence.text)) > max_copy,
        }
        out += [f"{code}:{i}" for code, wrong in checks.items() if wrong]
    return out


def coverage(facts: list[dict], paragraphs: list[str]) -> float:
    """Share of paragraphs that some fact cites."""
    cited = {r for f in facts for r in f.get("evidence_paragraph_ids") or []}
    return len(cited & set(range(1, len(paragraphs) + 1))) / len(paragraphs) if paragraphs else 0.0
