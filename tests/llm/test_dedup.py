import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from lexmill.llm import decontaminate, forest, linking, near_dup, paragraphs, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(sets, percent):
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def family(seed, n=120, words=260, edits=10):
    """A large group of near copies at all distances, and texts of its own."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def corpus():
    rows = [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    rows += family(1) + family(2, n=60, edits=4)
    return rows + [None, "", " \n", "one two", "ONE  two", "one two three four five", "a b c d e f" * 2, rows[0], rows[0]]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, None, None, None) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("small", [48, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "BLOCK", 1024 if small > 2 else 7)
    texts = corpus()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = brute_components(sets, 85)
    got = near_dup.near_duplicates(frame(spark, texts).repartition(5)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_odd_tables(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2)], "doc_id long, text string, component_id int")
    got = near_dup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("4", 4), ("4", 4), ("None", 4)]
    assert near_dup.first_of_each(df).columns == df.columns


def test_first_of_each_decides_by_row(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:k], "edited", *base[k + 1 :]])
    other, lone = " ".join(f"v{i}" for i in range(40)), " ".join(f"z{i}" for i in range(40))
    rows = [(5, " ".join(base)), (5, " ".join(base)), (6, near(58)), (None, " ".join(base)), (None, near(59)), (None, other), (None, other), (None, lone), (None, None), (None, ""), (8, " "), (8, lone + " end")]
    got = near_dup.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("5", " ".join(base)), ("None", other), ("None", "None"), ("None", ""), ("8", " "), ("8", lone + " end")])


def test_first_of_each_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a", 7, 1), (1, text, "a", 7, 1), (2, text + " x", "b", 8, 2), (3, "other words", "c", 9, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, id int, _id int")
    assert sorted(tuple(r) for r in near_dup.first_of_each(df).collect()) == [rows[0], rows[3]]


def test_first_of_each_keeps_clean_documents(spark):
    df = frame(spark, [f"alpha{i} beta gamma delta{i} epsilon zeta" for i in range(5)] + [None, ""])
    assert near_dup.first_of_each(df).count() == 7


def plain_units(text):
    """{(kind, start): words} of a text, read line by line and run by run; a whole text starts at paragraphs.WHOLE."""
    lines = [x for x in map(words_of, (text or "").split("\n")) if x]
    ws, out, at = [w for x in lines for w in x], {}, 0
    for x in lines:
        out["line", at] = x
        at += len(x)
    if len(ws) < 50 and len(lines) > 1:
        out["line", paragraphs.WHOLE] = ws
    number = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in ws]
    rank = [sum(a * b for a, b in zip(number[i : i + 5], paragraphs.FACTORS)) % 2147483647 for i in range(len(ws) - 4)]
    for p in range(len(ws) - 49):
        i = min(range(p, p + 30), key=lambda i: (rank[i], i))
        out["passage", i] = ws[i : i + 21]
    return out


def plain_removed(texts):
    want = set()
    for kind in paragraphs.KINDS:
        all_ = {(i, k[1]): w for i, t in enumerate(texts) for k, w in plain_units(t).items() if k[0] == kind}
        top = brute_components({k: shingles(" ".join(w)) if kind == "line" else {tuple(w)} for k, w in all_.items()}, 80)
        found = {(i, kind, s % paragraphs.WHOLE, len(all_[i, s]), top[i, s][0], top[i, s][1] % paragraphs.WHOLE) for i, s in all_ if top[i, s] != (i, s)}
        want |= {r for r in found if r[4] != r[0] or r[2] - r[5] >= r[3]}
    return want


def passages_corpus(n=80):
    """Runs of 50 words inside one long line or over lines of 11 to 15 words, near copies of lines, short lines."""
    rnd = random.Random(11)
    own = lambda n: [f"u{rnd.randrange(10**7)}" for _ in range(n)]
    wrapped = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    runs, texts, at = [own(50) for _ in range(n // 2)], [], []
    for i in range(n):
        before = own(rnd.randrange(60))
        at.append(len(before))
        texts.append(wrapped([*before, *runs[i % (n // 2)], *own(rnd.randrange(60))], 1000 if i % 2 else rnd.randint(11, 15)))
    shared = [own(60) for _ in range(4)]
    for i in range(40):
        s = list(shared[i % 4])
        if i % 3:
            s[rnd.randrange(60)] = "edited"
        texts.append("\n".join([" ".join(own(rnd.randint(1, 40))), " ".join(s), " ".join(own(rnd.randint(1, 40)))]))
    license = "a short line of seven words here"
    return texts + [license, "other\n" + license, "Two words", "two  WORDS", None, "", "\n\n \n", " ".join(shared[0]), " ".join(shared[0]).upper(), "of " * 40, "of " * 90, wrapped(own(24), 9)], at


def test_units_match_brute_force(spark):
    texts, at = passages_corpus()
    got = paragraphs.removed_units(frame(spark, texts).repartition(3)).collect()
    assert {tuple(r) for r in got} == plain_removed(texts) and len(got) == len(set(got))
    inside = {r.doc_id for r in got if r.kind == "passage" and r.kept_doc_id == r.doc_id - 40 and at[r.doc_id] <= r.start <= at[r.doc_id] + 29}
    assert inside == set(range(40, 80))
    assert {(r.doc_id, r.start, r.kept_doc_id) for r in got if 120 <= r.doc_id < 124} == {(121, 1, 120), (123, 0, 122)}


def test_short_lines_are_compared(spark):
    """Lines of under 20 words, at the bound and under it, beside long lines and in short texts; one text on other lines."""
    w = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    long, other = " ".join(f"l{i}" for i in range(25)), " ".join(f"m{i}" for i in range(60))
    texts = [f"{w(0, 19)}\n{long}", f"{other}\n{w(0, 16)}", f"{w(0, 15)}\nx", "x", "a b\nc d e f g\nh", "a b c d\ne f g h", f"{w(40, 45)}\n{w(50, 70)}", f"{w(40, 45)} {w(50, 70)}"]
    got = {tuple(r) for r in paragraphs.removed_units(frame(spark, texts).repartition(3)).collect()}
    # 12 of 15 shingles are at the bound; the third text's line and whole text are linked by way of the second
    want = {(1, "line", 60, 16, 0, 0), (2, "line", 0, 15, 0, 0), (2, "line", 0, 16, 0, 0), (3, "line", 0, 1, 2, 15), (5, "line", 0, 8, 4, 0), (7, "line", 0, 25, 6, 0)}
    assert got == want == plain_removed(texts)


@pytest.mark.parametrize("small", [48, 2])
def test_crowded_bands_lose_nothing(spark, monkeypatch, small):
    """One line in many versions, of which the first are like no other: the regions stay in several components."""
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "BLOCK", 5)
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for i in range(60):
        t = list(base)
        for _ in range(rnd.choice([1, 2, 3, 6])):
            t[rnd.randrange(40)] = f"x{rnd.randrange(12)}"
        texts.append(" ".join(t))
    assert {tuple(r) for r in paragraphs.removed_units(frame(spark, texts).repartition(3)).collect()} == plain_removed(texts)


def test_units_of_odd_tables(spark):
    assert paragraphs.removed_units(frame(spark, [])).count() == 0
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(None, long, 1), (3, long, 2), (3, long, 2), (7, "x " + long, 3), (9, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_doc_id int")
    got = paragraphs.removed_units(df).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(7, 3)} and len(got) > 60_000 // 21
    left = sorted((str(r.doc_id), len((r.text or "").split()), r.kept_doc_id) for r in paragraphs.without_removed(df, paragraphs.removed_units(df)).collect())
    assert [x for x in left if x[0] != "7"] == [("3", 60_000, 2), ("3", 60_000, 2), ("9", 0, 4), ("None", 60_000, 1)] and left[2][1] < 60
    for bad in (-1, 1 << 37):
        with pytest.raises(Exception, match="doc_id must be in"):
            paragraphs.removed_units(spark.createDataFrame([(bad, "a b c d e f")], "doc_id long, text string")).count()


def test_removed_words_leave_the_text(spark):
    one = " ".join(f"é{i}" for i in range(30))
    rows = [(1, f"own start\n{one}\nown end", 0, None), (2, f"Other\n{one.upper()}\nlast", 1, "z"), (3, None, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, runs string")
    removed = spark.createDataFrame([(2, "line", 1, 30, 1, 2)], "doc_id long, kind string, start long, n_words long, kept_doc_id long, kept_start long")
    left = {r.doc_id: tuple(r)[1:] for r in paragraphs.without_removed(df, removed).collect()}
    assert left == {1: rows[0][1:], 2: ("Other\n\nlast", 1, "z"), 3: rows[2][1:]}


def brute_bytes(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def byte_rows():
    rnd = random.Random(8)
    rows = list(enumerate(corpus()))
    base = "".join(rnd.choice("abc ") for _ in range(1500))
    for i in range(2000, 2060):
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        a = rnd.randrange(300)
        rows.append((i, "".join(t)[a : a + rnd.randint(50, 1400)]))
    return rows + [(3000, "Of " * 200), (3001, "Of " * 500), (3002, "a" * 99), (3003, "a" * 100), (3004, "a" * 150), (3005, "é" * 80), (3006, "xé" * 80), (3007, "z" * 30000)]


@pytest.mark.parametrize("parts", [1, 6])
def test_bytes_match_brute_force(spark, parts):
    rows = byte_rows()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(parts)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_bytes(df).collect()}
    assert got == brute_bytes(rows)
    assert suffix_dedup.dedup_bytes(df.limit(0)).count() == 0


def test_refinement_of_buckets():
    raws = [b"abcdefgh" * 20, b"xabcdefgh" + b"abcdefgh" * 15, b"short", b"q" * 120]
    ids, at = suffix_dedup.refined(raws)
    flat = [(ids[at[k] + p], raws[k][p : p + 100]) for k in range(len(raws)) for p in range(len(raws[k]) - 99)]
    by_id, by_text = {}, {}
    for i, s in flat:
        assert by_id.setdefault(i, s) == s and by_text.setdefault(s, i) == i
    assert all(ids[at[k] + p] == -1 for k in range(len(raws)) for p in range(max(0, len(raws[k]) - 99), len(raws[k])))


def test_refinement_in_several_blocks(spark, monkeypatch):
    rows = [(b, d, 0, 0, 0, 0, bytes([65 + b, 65 + d % 3]) * 50) for b in (1, 2) for d in range(40)]
    df = spark.createDataFrame(rows, "bucket long, doc_id long, place int, lo int, first int, last int, raw binary").repartition(3)
    for block in (4096, 8, 5):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        got = sorted((r.doc_id, r.lo, r.hi) for r in suffix_dedup._refined(df).collect())
        assert got == sorted((d, 0, 100) for d in range(3, 40) for _ in (1, 2))


@pytest.mark.parametrize("block", [1024, 6])
def test_one_passage_in_many_contexts(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rnd = random.Random(9)
    own = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = own(170)
    rows = [(i, own(rnd.randrange(200)) + passage[rnd.randrange(30) :] + own(rnd.randrange(200))) for i in range(150)] + [(200, own(400_000) + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_bytes(df).collect()} == brute_bytes(rows)


def test_contained_items_match_brute_force(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(f"b{rnd.randrange(10**5)}" for _ in range(rnd.choice([3, 6, 12, 30, 60, 150])))) for i in range(60)] + [(60, None), (61, ""), (62, "b1 b2"), (63, "b1 b2")]
    texts = []
    for i in range(150):
        w = [f"d{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 40, 2000]))]
        q = items[rnd.randrange(60)][1].split()
        if rnd.random() < 0.6 and len(q) > 8:
            q[rnd.randrange(len(q))] = "edited"
        at = rnd.randint(0, len(w))
        texts.append(" ".join([*w[:at], *q, *w[at:]]))
    texts += [None, "", "B1  b2", "b1 b2 b3 b4"]
    want = set()
    for d, t in enumerate(texts):
        s = shingles(t)
        for i, q in items:
            x = shingles(q)
            if x and 100 * len(x & s) >= 80 * len(x):
                want.add((d, i, len(x), len(x & s)))
    df = frame(spark, texts).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(df, bench)
    assert {tuple(r)[:4] for r in got.collect()} == want
    left = {r.doc_id for r in decontaminate.without_contaminated(df, bench).collect()}
    assert left == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.contained_items(df, bench.limit(0)).count() == 0
    assert decontaminate.contained_items(df.limit(0), bench).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 2)
    bench = spark.createDataFrame([(i, f"a{i} b c d e f{i}") for i in range(5)], "item_id long, text string")
    df = frame(spark, [f"x y a{i} b c d e f{i} z" for i in range(5)])
    assert {tuple(r)[:2] for r in decontaminate.contained_items(df, bench).collect()} == {(i, i) for i in range(5)}


def test_bytes_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "n" * 40 + "m" * 120, 1), (1, "m" * 110, 2), (2, None, 3), (3, "", 4), (4, "other", 5)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_bytes(df).collect()}
    assert got == {None: 119, 1: 110, 2: 0, 3: 0, 4: 0}
