"""Text functions and grouping rules against hand-made cases."""

import difflib
import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions import python_text as P
from lexmill.functions import text as T
from lexmill.operators import grouping, metrics


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_ngrams_and_jaccard(spark):
    a, b, e = F.lit("abcdef"), F.lit("abcdeg"), F.lit("")
    j = lambda x, y, z=0.0: T.jaccard(T.char_ngram_set(x, 5), T.char_ngram_set(y, 5), z)
    r = one(spark, j(a, b), j(e, e), j(e, e, 1.0), T.whole_or_ngram_set(F.lit("abc"), 5), T.char_ngrams(F.lit("abc"), 5), T.char_ngrams(F.lit("a😀b"), 2), T.char_ngrams(e, 1))
    assert (r.c0, r.c1, r.c2) == (pytest.approx(1 / 3), 0.0, 1.0) and r.c3 == ["abc"] and r.c4 == [] and r.c5 == ["a😀", "😀b"] and r.c6 == []


def test_tokens(spark):
    r = one(spark, T.number_tokens(F.lit("A55 5G 2026")), T.metric_tokens(F.lit("星湾 5G Demo")), T.date_tokens(F.lit("2024年5月1日 5月1日")), T.mixed_tokens(F.lit("Ab 中国人")), T.number_unit_tokens(F.lit("3.5万 10%")))
    assert r.c0 == ["2026", "5"] and r.c1 == ["星", "湾", "5g", "demo"] and r.c2 == ["2024年", "2024年5月", "2024年5月1日", "5月1日"] and r.c3 == ["ab", "中国", "国人"] and r.c4 == ["10%", "3.5万"]


def test_theme_and_types(spark):
    r = one(spark, T.theme(F.lit("绿色创新")), T.theme(F.lit("x")), T.fact_type(F.lit("签署协议")), T.fact_type(F.lit("in 2024")), T.fact_type(F.lit("x")), T.event_verbs(F.lit("发布并签约")), T.collapse_spaces(F.lit(" a　\n b ")))
    assert (r.c0, r.c1, r.c2, r.c3, r.c4, r.c5, r.c6) == ("technology_innovation", "corporate_strategy", "cooperation", "number", "other", ["发布", "签约"], "a b")


def test_buckets_and_targets(spark):
    from lexmill.operators.sampling import split_targets

    t = split_targets(F.lit(25))
    r = one(spark, T.length_bucket_le(F.lit(600)), T.length_bucket_lt(F.lit(600)), *t.values())
    assert (r.c0, r.c1, r.c2, r.c3, r.c4) == ("short", "medium", 20, 2, 3)


@pytest.mark.parametrize("raw,risks,publishable,unsupported,want", [(96, 2, True, 0, 59), (96, 3, False, 2, 53), (96, 1, True, 0, 69), (96, 0, False, 0, 79), (96, 0, True, 0, 96), (120, 0, True, 1, 97), (2, 0, True, 1, 0), (-5, 0, True, 0, 0), (90, 1, False, 1, 66)])
def test_release_adjusted(spark, raw, risks, publishable, unsupported, want):
    assert one(spark, metrics.release_adjusted(F.lit(raw), F.lit(risks), F.lit(publishable), F.lit(unsupported))).c0 == want


def test_bleu_and_rouge(spark):
    p = spark.createDataFrame([(1, "the cat sat on the mat", "the cat is on the mat"), (2, "星湾通信 5G 演示", "星湾通信完成5G演示")], "id long, prediction string, reference string")
    r = metrics.bleu4(p, "id").first()
    assert (r.m1, r.m2, r.m3, r.m4, r.t1, r.t2, r.t3, r.t4, r.prediction_length, r.reference_length) == (12, 8, 4, 1, 13, 11, 9, 7, 13, 15) and r.bleu4 == pytest.approx(0.465728, abs=1e-6)
    assert [round(x[1], 6) for x in metrics.rouge_n(p, "id", 1).orderBy("id").collect()] == [0.833333, 0.875]
    assert [round(x[1], 6) for x in metrics.rouge_n(p, "id", 2).orderBy("id").collect()] == [0.6, 0.714286]


def test_mcnemar_and_hash_rank(spark):
    from lexmill.operators.sampling import hash_sample

    assert metrics.mcnemar(5, 1) == 0.21875 and metrics.mcnemar(0, 0) == 1.0
    d = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert [r.id for r in hash_sample(d, "id", "seed", 4).collect()] == ["c", "d", "a", "b"]


def test_line_repetition(spark):
    from lexmill.operators.dedup import line_repetition

    d = spark.createDataFrame([(n, "\n".join(["line"] * n)) for n in (2, 3, 4, 5)] + [(9, "a\nb\na\nb\na"), (10, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_repetition(d).collect()}
    assert [got[n].any3 for n in (2, 3, 4, 5, 9, 10)] == [False, True, True, True, True, False]
    assert [got[n].consecutive3 for n in (2, 3, 9)] == [False, True, False] and [got[n].severe5 for n in (4, 5)] == [False, True]


def test_python_text():
    assert P.event_text(" Ａ，ｂ​ ") == "a,b" and P.chinese_integer("三百二十一") == 321 and P.chinese_integer("十") == 10 and P.chinese_integer("二〇二四") == 2024 and P.chinese_integer("一万二千") == 12000 and P.chinese_integer("三亿五千万") == 350_000_000 and P.chinese_integer("x") is None
    assert P.scaled_number("1.2万") == "12000" and P.scaled_number("1,000") == "1000" and P.scaled_number("abc") is None
    assert P.sequence_ratio("abcd", "bcde") == 0.75 == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()
    assert P.pack_batches([4, 4, 4], 5, 8) == [[4, 4], [4]] and P.span_repeats("x" + "abcdefgh" * 3) and not P.span_repeats("abcdefgh" * 2 + "x")
    assert P.entities("“星湾” launch 星湾研究院")
    assert P.model_draft("```\n标题：T\n\n正文：B\n```") == ("T", "B") and P.model_draft("only") is None
    assert "".join(P.long_unit_parts("a" * 250)) == "a" * 250 and max(map(len, P.long_unit_parts("字" * 250))) <= 100


def test_simhash_is_a_sum_of_signs():
    import hashlib

    for text in ("", "abc", "the quick brown fox jumps", "快速的狐狸跳过懒狗"):
        y = P.quality_text(text)
        hashes = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in {y[i : i + 5] for i in range(len(y) - 4)}]
        want = sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) >= 0)
        assert P.simhash64(text) % 2**64 == want


def test_lcs_against_a_table():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert P.lcs_length(a, b) == t[-1][-1]


def test_semantic_units():
    units = P.semantic_units(["甲公司发布新产品。乙公司签约。", "乙公司签约。共三项，包括甲、乙。"])
    assert [u[1] for u in units] == ["甲公司发布新产品。", "乙公司签约。", "共三项，包括甲、乙。"] and units[2][0] == [2]
    assert len(P.semantic_units([f"句子{i}。" for i in range(100)])) <= 30


def test_mcnemar_of_many_pairs_is_exact_and_quick():
    from math import comb

    for a, b in ((1001, 1000), (1500, 1500), (1400, 1300), (2500, 7), (4000, 1), (2001, 0)):
        n, c, total = a + b, 1, 0
        for i in range(min(a, b) + 1):
            total += c
            c = c * (n - i) // (i + 1)
        assert c == comb(n, min(a, b) + 1)
        want = min(1.0, 2 * total / 2**n)
        assert abs(metrics.mcnemar(a, b) - want) <= 1e-11 * want
    began = time.process_time()
    assert 0.31 < metrics.mcnemar(1_000_500, 999_080) < 0.32 and metrics.mcnemar(3_000_000, 1_000_000) == 0.0
    assert time.process_time() - began < 5


def test_complete_link_groups():
    e = [(1, 2, 0.9, 0.9, "p"), (2, 3, 0.8, 0.8, "q")]
    assert grouping.complete_link(e, 9) == {1: 1, 2: 1, 3: 3}
    assert grouping.complete_link([*e, (1, 3, 0.7, 0.7, "r")], 9) == {1: 1, 2: 1, 3: 1}
    assert grouping.complete_link([*e, (1, 3, 0.7, 0.7, "r")], 2) == {1: 1, 2: 1, 3: 3}


def test_survivors_in_order():
    rows = [("A", -9), ("B", -8), ("C", -1)]
    assert grouping.survivors_in_order(rows, {("A", "B"), ("B", "C")}) == {"B": "A"}


def test_split_assignment_keeps_groups_and_targets():
    groups = [{"group_id": f"g{i}", "size": 1 + i % 5, "y": {"a": 1 + i % 5}} for i in range(60)]
    n = sum(g["size"] for g in groups)
    targets = {"train": -(-n * 4 // 5), "validation": round(n / 10)}
    targets["test"] = n - sum(targets.values())
    got = grouping.assign_splits(groups, targets, "s", ("y",))
    assert set(got) == {g["group_id"] for g in groups}
    assert all(abs(sum(g["size"] for g in groups if got[g["group_id"]] == s) - t) <= 5 for s, t in targets.items())
    assert got == grouping.assign_splits(groups[::-1], targets, "s", ("y",))


def test_components(spark):
    from lexmill.operators.graph import components

    e = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (10, 11), (7, 7)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = dict(components(e).collect())
    assert got[4] == 1 and got[11] == 10 and 7 not in got and {got[100 + i] for i in range(41)} == {100}
    assert components(e.limit(0)).count() == 0


def test_deduplicate_against_a_plain_loop(spark):
    import random
    from datetime import date

    from lexmill.operators.dedup import deduplicate

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = base[i % 6].split()
        for _ in range(rnd.choice([0, 0, 1, 2, 9])):
            t[rnd.randrange(len(t))] = word()
        text = " ".join(t)
        rows.append((i, rnd.choice(["same title here", "quite another one"]), text if rnd.random() < 0.7 else text.replace(" ", "\n", 2), date(2024, 1, 1 + i % 20) if i % 7 else None))
    norm = {i: P.quality_text(b) for i, _, b, _ in rows}
    rank = {i: (-len(norm[i]), d is None, d or date.min, str(i)) for i, _, _, d in rows}
    want, left = {}, [r[0] for r in rows]
    body, title = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    for stage, key in (("exact", body), ("normalized", norm)):
        groups = {}
        for i in left:
            groups.setdefault(key[i], []).append(i)
        for g in groups.values():
            best = min(g, key=rank.__getitem__)
            want |= {i: (best, stage) for i in g if i != best}
        left = [i for i in left if i not in want]
    grams = {i: {norm[i][k : k + 5] for k in range(len(norm[i]) - 4)} for i in left}
    bands = {i: [P.simhash64(body[i]) >> 16 * k & 0xFFFF for k in range(4)] for i in left}
    for x, a in enumerate(left):
        for b in left[x + 1 :]:
            if a in want or b in want or not any(p == q for p, q in zip(bands[a], bands[b])):
                continue
            j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
            if j >= 0.97 or j >= 0.92 and P.sequence_ratio(title[a], title[b]) >= 0.85:
                keep, lose = (a, b) if rank[a] <= rank[b] else (b, a)
                want[lose] = (keep, "near")
    got = {r.doc_id: (r.survivor_id, r.stage) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, title string, body string, publish_date date")).collect()}
    assert {s for _, s in want.values()} == {"exact", "normalized", "near"} and got == want
    assert deduplicate(spark.createDataFrame([], "doc_id long, title string, body string, publish_date date")).count() == 0
