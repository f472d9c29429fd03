"""Facts, schemas, workflow and contracts against hand-made cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import contracts, facts, lineage, sampling, schema_check, workflow


def test_numbers_and_their_support():
    assert facts.fact_numbers("A55 5G 1,000 与 08 ％3") >= {"1000", "08", "8"}
    e = facts.evidence_numbers("三百二十一个，百分之五，三点五，下午三点二十，晚8点，9点半，3-5%，20000个，一万户")
    assert {"321", "5%", "3.5", "15", "20", "9", "30", "3%", "2", "10000", "1"} <= e
    assert facts.unsupported_numbers("共12家", "十二家") == [] and facts.unsupported_numbers("共13家", "十二家") == ["13"]
    assert facts.numeric_surface("1 ,000 12 %") == "1 ,000 12%" and facts.numeric_surface("3～5") == "3-5"


def test_anchors_and_retention():
    got = [a[:2] for a in facts.anchors("星湾科技于2024年5月1日投入3亿元，新增20家，覆盖5G", {"organization": ("星湾科技", "星湾")})]
    assert got[0] == ("organization", "星湾科技") and ("date_year", "2024年5月1日") in got and ("amount", "300000000元") in got and ("number", "20家") in got
    kept, missing, new = facts.retention(["投入3亿元"], "投入4亿元")
    assert missing == [("amount", "300000000元")] and new == [("amount", "400000000元")] and kept == []


def test_fact_validation():
    ps = ["投入三亿元。", "新增20家。"]
    good = [{"fact_id": "F01", "fact": "新增20家", "evidence_paragraph_ids": [2]}]
    assert facts.validate_facts(good, ps) == [] and facts.coverage(good, ps) == 0.5
    bad = [{"fact_id": "F02", "fact": "新增21家", "evidence_paragraph_ids": [2]}, {"fact_id": "F02", "fact": "新增21家!", "evidence_paragraph_ids": [2]}, {"fact_id": "F03", "fact": "x", "evidence_paragraph_ids": [9]}]
    assert facts.validate_facts(bad, ps) == ["fact_sequence:1", "unsupported_number:1", "unsupported_number:2", "duplicate_fact:2", "evidence_reference:3"]
    assert facts.copy_risk("abcd", ["bcde", "zz"]) == 0.75 and facts.copy_risk("x", []) == 0.0 and facts.coverage([], []) == 0.0


SCHEMA = {
    "type": "object", "required": ["id", "items"], "additionalProperties": False,
    "properties": {"id": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}, "when": {"type": "string", "format": "date-time"}, "n": {"type": "integer", "minimum": 0, "maximum": 5}, "kind": {"enum": ["a", "b"]},
                   "items": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/item"}}, "pair": {"type": "array", "prefixItems": [{"const": 1}], "items": False}},
    "$defs": {"item": {"type": ["string", "object"], "properties": {"child": {"$ref": "#/$defs/item"}}}},
}


@pytest.mark.parametrize("value,errors", [
    ({"id": "ab", "items": ["x", {"child": "y"}]}, []),
    ({"id": "A", "items": []}, ["$.id: minLength", "$.id: pattern", "$.items: minItems"]),
    ({"id": "ab", "items": ["x", "x"], "zz": 1}, ["$.zz: additionalProperties", "$.items: uniqueItems"]),
    ({"items": [{"child": 3}], "n": True, "kind": "c"}, ["$.id: required", "$.n: type", "$.kind: enum", "$.items[0].child: type"]),
    ({"id": "ab", "items": ["x"], "n": 9, "when": "2024-01-01", "pair": [2, 3]}, ["$.when: format", "$.n: maximum", "$.pair[0]: const", "$.pair: items"]),
    ([], ["$: type"]),
])
def test_schema_subset(value, errors):
    assert sorted(schema_check.compile_schema(SCHEMA)(value, "$")) == sorted(errors)


def test_schema_errors_of_rows(spark):
    d = spark.createDataFrame([(1, json.dumps({"id": "ab", "items": ["x"]})), (2, "{"), (3, None)], "id long, j string")
    assert {r.id: r.errors for r in schema_check.schema_errors(d, "id", "j", SCHEMA).collect()} == {1: [], 2: ["$: json"], 3: ["$: json"]}


def test_workflow(spark):
    d = spark.createDataFrame([(1, "T", ["a", "b"]), (2, "T", ["a [fix]"]), (3, " ", ["a"]), (4, "T", None)], "id long, topic string, facts array<string>")
    got = {r.id: r for r in workflow.run(d).collect()}
    assert (got[1].state, got[1].revised, got[1].score) == ("done", False, 3) and (got[2].body, got[2].revised) == ("a", True)
    assert got[3].state == got[4].state == "invalid_input" and got[4].score is None
    with pytest.raises(ValueError):
        workflow.provider("none")


def test_workflow_stops_at_a_bad_answer():
    class Bad(workflow.Provider):
        asked = 0

        def answer(self, role, payload):
            Bad.asked += role == "review"
            return json.dumps({"title": "t", "body": "b"}) if role == "write" else "not json"

    assert workflow.one(Bad(), "t", ["f"])["state"].startswith("failed: review") and Bad.asked == 2


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert workflow.retried(flaky, 3, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(TimeoutError):
        workflow.retried(lambda: (_ for _ in ()).throw(TimeoutError()), 2, 1.0, waits.append)


def test_contract_columns(spark):
    d = spark.createDataFrame([("2019年发布，2021年签约", "2021年")], "f string, s string")
    r = d.select(contracts.unsupported_years(F.col("f"), F.col("s")).alias("y"), contracts.normalized_date(F.lit("2024-02-30")).alias("bad"), contracts.normalized_date(F.lit("2024-02-03T10:00:00")).alias("good"), contracts.review_contract(F.lit(True), F.lit(1)).alias("x"), contracts.stability_codes(F.lit(2), F.lit(0), F.lit(0), F.lit(0.1), F.lit(0.4), 0.2, 0.4).alias("c")).first()
    assert r.y == ["2019"] and r.bad is None and str(r.good) == "2024-02-03" and r.x and r.c == ["bleu", "severe"]


def test_review_of_an_empty_article(spark):
    d = spark.createDataFrame([(1, "", "", None), (2, "t", "点击播放视频", None)], "doc_id long, title string, body string, publish_date date")
    got = {r.doc_id: r for r in contracts.deterministic_review(d).collect()}
    assert got[1].status == "deterministic_reject" and {"missing_title", "missing_body", "invalid_publish_date"} <= set(got[1].reject_codes) and "video_only_page" in got[2].reject_codes


def test_lineage_checks(spark):
    d = spark.createDataFrame([(1, 2), (2, 2)], "a long, b long")
    assert [r.check for r in lineage.integrity(d, {"equal": F.col("a") == F.col("b"), "positive": F.col("a") > 0}).collect()] == ["equal"]
    s = spark.range(1).select(lineage.terminal_state(F.lit("FIX"), F.lit("PASS"), F.lit(0), F.lit(1)).alias("s"), lineage.terminal_state(F.lit("FIX"), F.lit("FIX"), F.lit(0), F.lit(0)).alias("t")).first()
    assert tuple(s) == ("accepted_with_warning", "dropped")


def test_rate_sample_is_exact_at_any_size(spark):
    for n in (0, 1, 19, 1000):
        assert sampling.rate_sample(spark.range(n).toDF("id"), "id", "x", 5).count() == -(-n * 5 // 100)


def test_selection():
    from lexmill.operators import selection

    got = selection.balanced_positions({f"s{i}": ["a", "b", "c"] for i in range(24)}, "seed")
    counts = {(c, i): sum(o[i] == c for o in got.values()) for c in "abc" for i in range(3)}
    assert set(counts.values()) == {8}
    assert [c for _, c in selection.apart([("1", "x"), ("2", "x"), ("3", "y"), ("4", "y")])] == ["x", "y", "x", "y"]
    assert selection.resolve_artifact({"a/b": {"1", "2"}, "a": {"1"}}, {"1"}) == "a"
    with pytest.raises(ValueError):
        selection.resolve_artifact({"a": {"1"}, "b": {"1"}}, {"1"})
    assert selection.sweet_spot(["q4"]) == "q4" and selection.sweet_spot(["q4", "q6"]) == "INCONCLUSIVE"
    assert selection.matrix_errors({"a": {"r": 8, "l": 1}, "b": {"r": 16, "l": 1}, "c": {"r": 16, "l": 2}}, [("a", "b"), ("a", "c")], set()) == ["a:c:l,r"]
    assert selection.guards({"model": "m", "dataset": "d", "seed": 1, "cutoff": 2048, "authorized": True}) == [] and "test_split_in_training" in selection.guards({"split": "test"})


def test_coverage_picks(spark):
    from lexmill.operators.selection import coverage_picks

    d = spark.range(50).toDF("id")
    got = coverage_picks(d, "id", "s", {"even": F.col("id") % 2 == 0, "large": F.col("id") > 40, "none": F.lit(False)}, 10).collect()
    assert len(got) == 10 == len({r.id for r in got}) and [r.reason for r in got][:2] == ["even", "large"]


def test_preliminary_groups():
    from datetime import date

    from lexmill.operators.grouping import preliminary_groups

    e = [{"a": 1, "b": 2, "score": 0.9}, {"a": 2, "b": 3, "score": 0.8}, {"a": 4, "b": 5, "score": 0.7}, {"a": 5, "b": 6, "score": 0.6}]
    days = {1: date(2024, 1, 1), 2: date(2024, 1, 2), 3: None, 4: date(2024, 1, 1), 5: date(2024, 3, 1), 6: date(2024, 3, 2)}
    got, blocked = preliminary_groups(e, days, 2, 30, lambda a, b: (a, b) != (5, 6) and (b, a) != (5, 6))
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert [b["reason"] for b in blocked] == ["maximum_auto_group_size_exceeded", "maximum_auto_date_span_exceeded", "pairwise_compatibility_failed"]


def test_small_text_functions(spark):
    from lexmill.functions import python_text as P
    from lexmill.functions import text as T

    text, n = T.media_fallbacks(F.lit("a Your browser does not support the video tag. b"))
    r = spark.range(1).select(text.alias("t"), n.alias("n"), T.yaml_scalar(F.lit("it's")).alias("y"), T.yaml_scalar(F.lit("true")).alias("z"), T.yaml_scalar(F.lit("abc/d")).alias("w"), T.complete_paragraphs(F.lit("a b"), F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))["source"].alias("s")).first()
    assert tuple(r) == ("a  b", 1, "'it''s'", "'true'", "abc/d", "fallback")
    assert P.keyphrases("“星湾计划” x", ["小标题一"], "正文“引用短语”") == ["小标题一", "引用短语", "星湾计划"]


def test_issue_tables(spark):
    from lexmill.operators import experiments as X

    i = spark.createDataFrame([("s", "number", ["F02", "F01"], "minor"), ("s", "number", ["F01", "F02", "F02"], "blocking"), ("s", "date", [], "major")], "sample_id string, issue_type string, fact_ids array<string>, severity string")
    assert sorted(tuple(r) for r in X.merged_issues(i).collect()) == [("s", "date", "", "major", 1), ("s", "number", "F01,F02", "blocking", 2)]
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id long, t string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "id long, t string")
    judge = spark.createDataFrame([(2, "z", True), (1, "y", False)], "id long, t string, upheld boolean")
    assert {tuple(r) for r in X.confirmed(a, b, judge, ["id", "t"]).collect()} == {(1, "x", "both"), (2, "z", "judge")}
    r = spark.createDataFrame([(False, True, 0.96)] * 50, "same_output boolean, same_issues boolean, explanation_ratio double")
    assert X.independence(r).first()["suspicious"] and not X.independence(r.limit(3)).first()["suspicious"]


def test_preflight_and_pairs(spark):
    from lexmill.operators import experiments as X
    from lexmill.operators.grouping import compatible_pair, pair_relation

    d = spark.createDataFrame([(0.95, 0.8, 3), (0.85, 0.85, 20), (0.85, 0.5, 20), (0.5, 0.9, 1), (0.95, 0.8, None)], "t double, b double, g int")
    got = [tuple(r.x) for r in d.select(X.preflight_decision(F.col("t"), F.col("b"), F.col("g")).alias("x")).collect()]
    assert got == [("same_event", False), ("uncertain", True), ("uncertain", False), ("different_event", False), ("same_event", False)]
    p = spark.createDataFrame([(1.0, 0.3, 0.0, 10, True), (0.7, 0.4, 0.3, 100, False), (0.1, 0.1, 0.0, 1, False), (0.4, 0.9, 0.0, 150, False)], "t double, b double, e double, g int, q boolean")
    got = [tuple(r.x) for r in p.select(pair_relation(F.col("t"), F.col("b"), F.col("e"), F.col("g"), F.col("q")).alias("x")).collect()]
    assert got == [("high", True), ("none", False), ("none", False), ("high", True)]
    limits = {"max_days": 30, "body": 0.5, "title": 0.5, "strong_body": 0.8, "keyphrases": 0.3}
    c = spark.range(1).select(compatible_pair(F.lit(0.85), F.lit(0.1), F.lit(0.0), F.array(F.lit("x")), F.lit(3), limits).alias("a"), compatible_pair(F.lit(0.85), F.lit(0.9), F.lit(1.0), F.array(F.lit("x")), F.lit(None).cast("int"), limits).alias("b"), X.copy_share(F.lit("abcd"), F.lit("bcde")).alias("c")).first()
    assert tuple(c) == (True, False, 0.75)


def test_every_paragraph_is_evidence(spark, tmp_path):
    from lexmill.plans import catalogue

    texts = [(1, "\n".join(f"p{i}" for i in range(120)), "en", "s"), (2, "a\n\n b ", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.fact_id): (r.evidence_sha256, r.next_sha256) for r in catalogue.QUERIES["fact_evidence_all"](spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(1, f"F{i + 1:02d}"): (sha(f"p{i}"), sha(f"p{i + 1}") if i < 119 else None) for i in range(120)} | {(2, "F01"): (sha("a"), sha("b")), (2, "F02"): (sha("b"), None)}
    assert got == want


def test_escalation_has_three_rounds(spark):
    def rounds(hard, blocking):
        order = sorted(range(390), key=lambda i: hashlib.sha256(f"x|{i}".encode()).hexdigest())
        rows = [(i, f"s{k % 3}", k in hard, k in blocking) for k, i in enumerate(order)]
        got = sampling.escalation(spark.createDataFrame(rows, "id long, stratum string, hard boolean, blocking boolean"), "id", "x", 5, 0.02).collect()
        return sorted((order.index(r.id), r.round) for r in got)

    first, second = [(k, 1) for k in range(20)], [(k, 2) for k in range(20, 40)]
    assert rounds(set(), set()) == first
    assert rounds({3}, set()) == first + second
    assert rounds(set(), {3}) == first + second
    assert rounds({3, 21, 24}, set()) == first + second + [(k, 3) for k in range(40, 390) if k % 3 == 0]
