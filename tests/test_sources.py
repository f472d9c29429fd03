"""Sources, sinks and streaming, on files of a test's own."""

import json

import pytest

from lexmill.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "x.jsonl", '{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert [tuple(r) for r in readers.jsonl(spark, p, "a long, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    bad = write(tmp_path / "y.jsonl", '{"a": 1}\nnot json\n')
    rows = readers.jsonl(spark, bad, "a long", strict=False).collect()
    assert {r["_corrupt_record"] for r in rows} == {None, "not json"}
    with pytest.raises(Exception):
        readers.jsonl(spark, bad, "a long").collect()


def test_csv_with_mark(spark, tmp_path):
    p = write(tmp_path / "x.csv", '﻿id,text\n1,"a, b"\n')
    assert [r.asDict() for r in readers.csv(spark, p).collect()] == [{"id": "1", "text": "a, b"}]


def test_checkpoints(spark, tmp_path):
    d = tmp_path / "c"
    d.mkdir()
    write(d / "1.json", '{"sample_id": "a", "v": 1}\n')
    assert readers.checkpoints(spark, str(d), "sample_id string, v long", "sample_id").count() == 1
    write(d / "2.json", '{"sample_id": "a", "v": 2}\n')
    with pytest.raises(ValueError):
        readers.checkpoints(spark, str(d), "sample_id string, v long", "sample_id")


def test_trainer_log(spark, tmp_path):
    log = {"log_history": [{"step": 10, "epoch": 0.5, "loss": 2.0, "effective_batch": 8}, {"step": 20, "eval_loss": 1.5, "effective_batch": 8}, {"step": 30, "eval_loss": 1.6, "effective_batch": 8}]}
    t = readers.trainer_log(spark, write(tmp_path / "t.json", json.dumps(log)))
    assert [r.examples_seen for r in t.orderBy("step").collect()] == [80, 160, 240]
    assert tuple(readers.best_and_last(t).first()) == (1.5, 20, 1.6)


def test_runs_lists_and_yaml(spark, tmp_path):
    m = spark.createDataFrame([("r1", "4"), ("r2", None)], "run string, rank string")
    k = spark.createDataFrame([("r1", 0.5)], "run string, bleu double")
    assert sorted(tuple(r) for r in readers.runs(m, k, "run", ["rank", "bleu", "none"]).collect()) == [("r1", "4", "0.5", ""), ("r2", "", "", "")]
    assert readers.id_list(spark, write(tmp_path / "i.txt", "a\n\nb\n"), 2).count() == 2
    with pytest.raises(ValueError):
        readers.id_list(spark, write(tmp_path / "j.txt", "a\na\n"))
    y = readers.flat_yaml(spark, write(tmp_path / "y.yaml", "# c\na: 1\nb: 'x: y'\n"))
    assert {tuple(r) for r in y.collect()} == {("a", "1"), ("b", "x: y")}


def test_split_guard(spark):
    d = spark.createDataFrame([("train",), ("test",)], "split string")
    assert readers.split_for(d, "training").count() == 1
    with pytest.raises(PermissionError):
        readers.split_for(d, "anything")


def test_frozen_dataset(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    folder = str(tmp_path / "frozen")
    sinks.freeze({"train": d, "test": d.limit(1)}, folder, "v1")
    assert (tmp_path / "frozen" / "VERSION").exists() and sinks.changed_files(spark, folder, ["train", "test"]).count() == 0
    with pytest.raises(Exception):
        sinks.freeze({"train": d}, folder, "v2")
    sinks.write_jsonl(d.select("t", "id"), str(tmp_path / "j"), ["id"])
    lines = [x for p in sorted((tmp_path / "j").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"id":1,"t":"x"}', '{"id":2,"t":null}']


def test_streams_give_what_batches_give(spark, tmp_path):
    from lexmill.streaming import ledger

    sf = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "events"
    batch.orderBy("ts").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    q = ledger.error_streaks(stream).writeStream.outputMode("update").format("memory").queryName("streaks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {r.user_id: r.longest_error_streak for r in spark.table("streaks").collect()}
    want: dict = {}
    run: dict = {}
    for r in batch.orderBy("ts", "event_id").collect():
        run[r.user_id] = run.get(r.user_id, 0) + 1 if r.event_type == "error" else 0
        want[r.user_id] = max(want.get(r.user_id, 0), run[r.user_id])
    assert got == want
    assert ledger.window_counts(batch).agg({"n": "sum"}).first()[0] == batch.count()


def test_page_blocks_and_urls(spark):
    from pyspark.sql import functions as F

    from lexmill.operators import pages

    blocks, heads = pages.page_blocks("<body><p><strong>Head</strong></p><p>one<br>two</p><p>two</p><script>x</script><div hidden>no</div><p>a &amp; b</p></body>")
    assert blocks == ["Head", "one", "two", "a & b"] and heads == ["Head"] and pages.page_blocks(None) == ([], [])
    d = spark.createDataFrame([("https://h.example/a/1.html#x",), ("ftp://h.example/",), ("https://h.example:99/",), ("https://h.example/?a=1&ref=2",)], "u string")
    r = d.select(pages.canonical_url(F.col("u"), F.lit("h.example")).alias("x"), pages.drop_parameter(F.col("u"), "ref").alias("y")).collect()
    assert [x.x.url for x in r] == ["https://h.example/a/1.html", None, None, None] and [x.x.code for x in r] == [None, "invalid_url", "invalid_url", "query_not_allowed"] and r[3].y == "https://h.example/?a=1"
