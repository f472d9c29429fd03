"""Numbers in running text, Arabic and Chinese: one reader of number phrases, and the forms that follow from a phrase."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from typing import NamedTuple

# Chinese digits, units and scales, and the measure words after which a Chinese numeral is a number.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
SCALES = {"万": 10_000, "亿": 100_000_000}
MEASURES = "年 月 日 时 点 分 秒 个 家 次 届 辆 车 人 名 部 台 座 条 款 项 户 城 席 楼 号 公里 米 吨 元 美元 万 亿".split()
COUNTERS = "个 家 次 名 部 台 座 条 款 项 户".split()
#: Characters beside a numeral that are looked at.
NEAR = 40
LATE = ("下午", "晚上", "晚")

_NUMERAL = "".join([*DIGITS, *UNITS, *SCALES])
_TOKEN = re.compile(rf"(?P<arabic>\d+(?:\.\d+)?)|(?P<han>[{_NUMERAL}]+)")
# Patterns begin with a class of characters, so that a search passes over text without numbers quickly.
_START = re.compile(rf"[\d{_NUMERAL}]")
_GROUPED = re.compile(r"\d\d{0,2}(?:,\d{3})+")
_GAP = re.compile(r"\s(?:(?<=\d\s)\s*(?=[.%年月日时点分秒万亿GKM])|(?<=\.\s)\s*(?=\d))")
_DIGIT = re.compile(r"\d")
_DASHES = "—–～~至到"


class Token(NamedTuple):
    """A numeral and the text beside it, as far as any form looks."""

    text: str
    arabic: bool
    before: str
    after: str


def ungrouped(x: str) -> str:
    return _GROUPED.sub(lambda m: "".join(m[0].split(",")), x)


def surface(text: str | None) -> str:
    """Text whose numbers compare: compatibility forms, no gaps inside a number, no digit groups, one sign for ranges."""
    x = text or ""
    if not x.isascii():
        x = unicodedata.normalize("NFKC", x)
    if _DIGIT.search(x):
        x = ungrouped(_GAP.sub("", x))
    for c in _DASHES:
        x = x.replace(c, "-")
    return x


def tokens(x: str) -> list[Token]:
    out, at = [], 0
    while start := _START.search(x, at):
        m = _TOKEN.match(x, start.start())
        at = m.end()
        out.append(Token(m[0], m["arabic"] is not None, x[max(0, m.start() - NEAR) : m.start()], x[at : at + NEAR]))
    return out


def digits(x: str) -> str:
    """A row of digits of any length without leading zeros; int() refuses more than some thousand."""
    return (x if x.isascii() else "".join(str(int(c)) for c in x)).lstrip("0") or "0"


def _folded(x: str, whole: bool) -> int | None:
    """Value of a numeral as a sum of sections. `whole`: a scale multiplies all that stands before it, not its section."""
    if not x or set(x) - set(_NUMERAL):
        return None
    value, section, digit = 0, 0, None
    for c in x:
        if c in DIGITS:
            digit = DIGITS[c]
            continue
        if c in UNITS:
            section += (1 if digit is None else digit or 1) * UNITS[c]
        elif whole and c == "亿":
            value, section = ((value + section + (digit or 0)) or 1) * SCALES[c], 0
        else:
            value, section = value + ((section + (digit or 0)) or 1) * SCALES[c], 0
        digit = None
    return value + section + (digit or 0)


def chinese_integer(x: str) -> int | None:
    """A numeral with units, or a row of digits as in 二〇二四; 亿 multiplies all before it; null where a character is none."""
    if x and not set(x) - set(DIGITS):
        return int("".join(str(DIGITS[c]) for c in x))
    return _folded(x, True)


def _chinese_digits(x: str) -> str | None:
    """`chinese_integer` in digits, for numerals of any length."""
    if x and not set(x) - set(DIGITS):
        return digits("".join(str(DIGITS[c]) for c in x))
    v = _folded(x, True)
    return None if v is None else format(Decimal(v), "f")


def unit_integer(x: str) -> int | None:
    """A numeral read by its units alone: of a row of digits the last counts, a bare scale counts once, and each scale
    multiplies its own section."""
    return _folded(x, False)


def plain(value: Decimal | int) -> str:
    return format(Decimal(value).normalize(), "f")


def _apart(c: str) -> bool:
    """Whether a neighbour of a number is neither a Latin letter nor a digit."""
    return not (c.isascii() and c.isalnum())


def fact_forms(t: Token) -> set[str]:
    """An Arabic number that stands apart, with its percent sign, and without leading zeros."""
    if not t.arabic:
        return set()
    sign = t.after[:1] == "%" and _apart(t.after[1:2])
    if not (_apart(t.before[-1:]) and _apart(t.after[int(sign) : int(sign) + 1])):
        return set()
    return {t.text + "%" * sign} | ({digits(t.text)} if t.text.isdigit() and not sign else set())


def _hour(t: Token, shown: str) -> str:
    return str(int(shown) + 12) if len(shown) <= 2 and int(shown) < 12 and t.before.endswith(LATE) else shown


def _arabic_forms(t: Token) -> set[str]:
    percent = "%" if t.after.startswith("%") else ""
    latin = t.before[-1:].isascii() and t.before[-1:].isalpha()
    out = {t.text + percent} if not latin or percent or t.after.startswith((*SCALES, *COUNTERS)) else set()
    if m := re.match(r"\s*-+\s*(\d+(?:\.\d+)?)%", t.after):
        out |= {f"{t.text}%", f"{m[1]}%"}
    if t.text.isdigit():
        if t.after[:1] in ("点", "时") and len(t.text) <= 2:
            half = t.after[1:2] == "半"
            out |= {_hour(t, digits(t.text))} | ({str(int(t.text)), "30"} if half else set())
        if len(t.text) >= 5 and t.after.removeprefix("余").startswith(tuple(COUNTERS)):
            out.add(plain(Decimal(t.text) / SCALES["万"]))
    return out


def _han_forms(t: Token) -> set[str]:
    out: set[str] = set()
    value = unit_integer(t.text)
    if t.before.endswith("百分之"):
        out.add(f"{value}%")
    head, tail = t.text, t.after.removeprefix("多")
    if not tail.startswith(tuple(MEASURES)) and len(head) > 1 and head[-1] in SCALES:
        head, tail = head[:-1], head[-1]  # a scale may be the measure itself, as in 三万
    if tail.startswith(tuple(MEASURES)):
        whole = unit_integer(t.text)
        out |= {str(unit_integer(head)), str(whole)}
    if t.text[-1] in SCALES and value % SCALES[t.text[-1]] == 0:
        out.add(str(value // SCALES[t.text[-1]]))
    if t.after[:1] == "点" and (m := re.match(f"[{_NUMERAL}]+", t.after[1:])):
        if not set(t.text[-1] + m[0]) - set(DIGITS):
            out.add(f"{DIGITS[t.text[-1]]}." + "".join(str(DIGITS[c]) for c in m[0]))
        out |= {_hour(t, _chinese_digits(t.text)), _chinese_digits(m[0])}
    return out


def shown_numbers(x: str) -> set[str]:
    """`fact_numbers` of a text in its surface form."""
    return {f for t in tokens(x) for f in fact_forms(t)} if _DIGIT.search(x) else set()


def fact_numbers(text: str | None) -> set[str]:
    """Arabic numbers of a fact, with and without leading zeros."""
    return shown_numbers(surface(text))


def evidence_numbers(text: str | None) -> set[str]:
    """All forms in which a text supports a number: Arabic, Chinese, percentages, clock times, ranges and ten-thousands."""
    return {f for t in tokens(surface(text)) for f in fact_forms(t) | (_arabic_forms(t) if t.arabic else _han_forms(t))}


def canonical(text: str | None) -> str:
    """A name or quantity in the form in which it compares: no blanks, small letters, numbers and their scales as plain
    decimals, so that 2万元, 两万元 and 20,000元 meet."""
    x = re.sub(r"\s+", "", surface(text)).casefold()

    def value(m: re.Match) -> str:
        if m["n"] is not None:
            v = Decimal(m["n"])
            for c in m["s"]:
                v *= {**UNITS, **SCALES}[c]
            return plain(v)
        v = _chinese_digits(m["h"])
        return m["h"] if v is None else v

    return re.sub(rf"(?P<n>\d+(?:\.\d+)?)(?P<s>[十百千万亿]*)|(?P<h>[{_NUMERAL}]+)(?=(?:余|多)?(?:{'|'.join(MEASURES)}|%))", value, x)
