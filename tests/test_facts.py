import hashlib

import pytest

from lexmill.functions import numerals, python_text
from lexmill.operators import facts


def test_two_readings_of_chinese_integers():
    assert [numerals.chinese_integer(x) for x in ("一二", "二〇二四", "三百二十一", "十", "一万二千亿", "万", "x", "")] == [12, 2024, 321, 10, 1_200_000_000_000, 10000, None, None]
    assert [numerals.unit_integer(x) for x in ("一二", "三百二十一", "十五", "一万二千亿", "万", "亿", "x")] == [2, 321, 15, 200_000_010_000, 10_000, 100_000_000, None]


def test_bare_scales_count_once():
    assert "1" in facts.evidence_numbers("万元 亿元") and "0" not in facts.evidence_numbers("万元 亿元")


@pytest.mark.parametrize("token, evidence, want", [
    ("2024年5月1日", "于2024年5月1日开幕", True), ("2024年5月1日", "于2024.5.1开幕", True), ("5月3日", "5月1日至5日举行", True), ("5月3日", "5月1-5日举行", True),
    ("5月8日", "5月1日开幕，8日闭幕", True), ("6月8日", "5月1日开幕，8日闭幕", False), ("5月8日", "5月1日开幕。8日闭幕", False), ("2023年", "2024年5月", False), ("5月", "2024年5月", True), ("5月1日", "", False),
])
def test_dates_in_evidence(token, evidence, want):
    assert facts.date_supported(token, evidence) is want


def test_counts_of_lists():
    assert facts.count_supported("3", "发布3项成果", "包括甲、乙、丙。") and facts.count_supported("3", "共3项", "第一，甲。第二，乙。第三，丙。")
    assert not facts.count_supported("4", "发布4项成果", "包括甲、乙、丙。") and not facts.count_supported("3", "版本3", "包括甲、乙、丙。")
    assert facts.unsupported_numbers("发布3项成果", "包括甲、乙、丙。") == [] and facts.unsupported_numbers("发布5项成果", "包括甲、乙、丙。") == ["5"]


def test_quantities_meet_in_canonical_form():
    got = [{a[:2] for a in facts.anchors(x)} for x in ("投入2万元", "投入20,000元", "投入两万元")]
    assert got[0] == got[1] == got[2] == {("amount", "20000元")}
    assert ("number", "数10家") in {a[:2] for a in facts.anchors("覆盖数十家")} and facts.anchors(None) == []


def test_codes_of_dates_hashes_and_copies():
    ps = ["公司于2024年5月1日成立。", "另一段。"]
    good = {"fact_id": "F01", "fact": "2024年5月1日公司成立", "evidence_paragraph_ids": [1], "evidence_sha256": hashlib.sha256(ps[0].encode()).hexdigest()}
    assert facts.validate_facts([good], ps) == []
    assert facts.validate_facts([good | {"evidence_sha256": "0", "fact": "2024年6月1日公司成立"}], ps) == ["evidence_hash:1", "unsupported_number:1", "unsupported_date:1"]
    assert facts.validate_facts([good | {"fact": "公司于2024年5月1日成立"}], ps, max_copy=0.9) == ["copy_risk:1"]


def test_units_keep_words_whole():
    text = "字" * 95 + "ABCDEFGHIJ" + "字" * 40
    parts = python_text.long_unit_parts(text)
    assert "".join(parts) == text and any("ABCDEFGHIJ" in p for p in parts)
    assert python_text.semantic_units([]) == [] and python_text.semantic_units(["", " "]) == []
    assert python_text.semantic_units(["甲，乙，丙"]) == [([1], "甲，"), ([1], "乙，"), ([1], "丙")]


SF = "/root/testdata/sf0.001"


def rows(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_fact_validation_matches_a_plain_loop(spark):
    from lexmill.plans import catalogue

    want = {}
    for r in rows("documents"):
        ps = [p.strip() for p in (r["text"] or "").split("\n") if p.strip()]
        units = python_text.semantic_units(ps)
        found = [{"fact_id": f"F{i:02d}", "fact": t, "evidence_paragraph_ids": ids} for i, (ids, t) in enumerate(units, 1)]
        cited = {i for ids, _ in units for i in ids}
        want[r["doc_id"]] = (len(units), round(len(cited) / len(ps), 6) if ps else 0.0, tuple(facts.validate_facts(found, ps)))
    got = {r.doc_id: (r.n_facts, r.coverage, tuple(r.codes)) for r in catalogue.QUERIES["fact_validation"](spark, SF).collect()}
    assert got == want


def test_turn_support_matches_a_plain_loop(spark):
    from lexmill.plans import catalogue

    turns = sorted(rows("conversations"), key=lambda r: (r["conv_id"], r["turn"]))
    want = {}
    for a, b in zip(turns, turns[1:]):
        if a["conv_id"] == b["conv_id"] and a["role"] == "user" and b["role"] == "assistant":
            named = [{x[:2] for x in facts.anchors(t["text"])} for t in (a, b)]
            want[b["conv_id"] * 1000 + b["turn"]] = (tuple(facts.unsupported_numbers(b["text"], a["text"])), *(len(x) for x in (named[0] & named[1], named[0] - named[1], named[1] - named[0])))
    got = {r.id: (tuple(r.unsupported_numbers), len(r.retained), len(r.missing), len(r.new)) for r in catalogue.QUERIES["turn_fact_support"](spark, SF).collect()}
    assert got == want and len(want) > 0


def test_evidence_is_read_once_for_all_facts(monkeypatch):
    read = []
    for name in ("evidence_numbers", "_dates"):
        monkeypatch.setattr(facts, name, lambda x, f=getattr(facts, name): read.append(x) or f(x))
    ps = ["".join(f"第{i}次会议于2024年5月{i}日举行，代表{i + 100}家到会" for i in range(1, 29)), "另一段没有数字。"]
    units = python_text.semantic_units(ps)
    found = [{"fact_id": f"F{i:02d}", "fact": t, "evidence_paragraph_ids": ids} for i, (ids, t) in enumerate(units, 1)]
    assert sum(ids == [1] for ids, _ in units) > 5 and facts.validate_facts(found, ps) == []
    assert read == [ps[0], ps[0]]  # once for numbers, once for dates; a paragraph whose facts name neither is not read


@pytest.mark.parametrize("read", [lambda n: facts._dates("5月1日，" * n), lambda n: facts.count_supported("3", "共3项", "甲、" + "乙和" * n)])
def test_reading_evidence_grows_with_its_length(read):
    from time import process_time

    def took(n):
        start = process_time()
        read(n)
        return process_time() - start

    least = [min(took(n) for _ in range(3)) for n in (2_000, 16_000)]
    assert least[1] < 24 * max(least[0], 1e-4)


def test_and_parts_items_after_the_last_comma_only():
    for n, listed in (("4", "甲和乙、丙、丁及戊。"), ("4", "甲以及乙、丙以及丁。"), ("3", "以以及及、丙。"), ("4", "丙、以以及及。")):
        assert facts.count_supported(n, f"共{n}项", listed) and not facts.count_supported("5", "共5项", listed)


def test_numbers_of_any_length():
    ones, zeros = "1" * 5000, "0" * 5000
    assert facts.fact_numbers(f"{ones} {zeros}3") == {ones, f"{zeros}3", "3"}
    assert facts.unsupported_numbers(f"共{ones}项", "无") == [ones] and facts.unsupported_numbers(f"共{zeros}3项", "甲、乙、丙。") == ["3"]
    assert ones in facts.evidence_numbers(f"{'一' * 5000}点二") and numerals.canonical("一" * 5000 + "个") == ones + "个"
    assert numerals.canonical("亿" * 600 + "个") == "1" + "0" * 4800 + "个"
    assert facts.validate_facts([{"fact_id": "F01", "fact": ones, "evidence_paragraph_ids": [1]}], [f"共{ones}项"]) == []
