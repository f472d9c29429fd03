import hashlib
import importlib
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexmill.llm import bpe, decontaminate, language, near_dup, page_text, quality_model, queries, secrets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header class="site-header"><p>Site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy <b>now</b></div>
<article><header><h1>Title &amp; more</h1></header><p>First   line<br>goes <i>on</i>.<p>Second &lt;b&gt; &#233;&nbsp;x
<script>var a = "</p><p>bad";</script></p><aside>Side</aside><form><p>Mail</p></form><ul><li>One</li><li>Two</li></ul>
<div id="comments"><p>Nice post</p></div><p hidden>gone</p><p>Last 1 < 2</p></article><footer>&copy; x</footer></body></html>"""


def test_blocks_of_a_page():
    inside, outside, declared = page_text.blocks(PAGE)
    assert declared and outside == []
    assert inside == ["Title & more", "First line goes on.", "Second <b> é x", "One", "Two", "Last 1 < 2"]
    assert page_text.blocks(None) == ([], [], False) and page_text.blocks("") == ([], [], False)
    assert page_text.blocks("<article><p>cut &am")[0] == ["cut &am"]
    assert page_text.blocks("<article><p>cut</p><p cla")[0] == ["cut"]
    assert page_text.blocks('<main><p title="a > b">x</p></main>')[0] == ["x"]
    assert page_text.blocks('<div>bar</div><div class="post-content"><p>a <span class="ad">buy</span>b</p><article class="comment">no</article></div>')[0] == ["a b"]
    assert page_text.blocks('<article><p>x</p><article class="comment-reply"><p>no</p></article><p>y</p></article>')[0] == ["x", "y"]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        a, b = ([str(x) for x in rnd.integers(0, 5, rnd.integers(0, 14))] for _ in range(2))
        got = page_text.shared_lines(a, b)
        kept = iter(b)
        assert len(got) == brute_lcs(a, b) and all(a[i] in kept for i in sorted(got))


def test_differencing_against_the_nearest_page(spark):
    wrap = lambda x: f"<div>Top bar</div><div>{x}</div><div>Bottom line</div>"
    rows = [(i, f"http://h.example/a/{i}", wrap(f"own text {i}"), 5) for i in range(6)] + [(7, "http://other.example/x", wrap("alone"), 5), (8, None, None, 5), (9, "not a url", "", 5), (10, "http://h.example/a/1", wrap("own text 1"), 5)]
    got = {r.page_id: r for r in page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert len(got) == len(rows) and [got[i].text for i in range(6)] == [f"own text {i}" for i in range(6)]
    assert got[7].text == "Top bar\n\nalone\n\nBottom line" and got[8].text == "" and got[8].url is None and got[9].n_chars == 0
    assert page_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_query_matches_a_plain_reading(spark):
    """The test pages are regular enough to be read by splitting at their block tags."""
    import html

    got = {r.page_id: r for r in queries.op1_page_main_text(spark, SF).collect()}
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        a, b = r["html"].find("<article>"), r["html"].find("</article>")
        parts = re.split(r"</?(?:p|h1)>", r["html"][a + 9 : b if b >= 0 else None])
        want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts) if x)
        assert got[r["page_id"]].text == want and got[r["page_id"]].n_chars == len(want)


def test_factor_machine_sums_all_pairs():
    fm = quality_model.FactorMachine()
    rng = np.random.default_rng(2)
    fm.weights[:], fm.factors[:], fm.bias = rng.normal(size=fm.weights.shape), rng.normal(size=fm.factors.shape), 0.3
    idx, val = rng.integers(0, len(fm.weights), 9), rng.normal(size=9)
    got = fm._margin(idx, val, np.array([0, 4, 9]))[0]
    for k, (a, b) in enumerate(((0, 4), (4, 9))):
        want = fm.bias + (fm.weights[idx[a:b]] * val[a:b]).sum()
        want += sum(fm.factors[idx[i]] @ fm.factors[idx[j]] * val[i] * val[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[k] == pytest.approx(want)


def test_quality_scores_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = queries.op2_quality_classifier(spark, sf).collect()
    assert len(rows) == pq.read_table(f"{sf}/documents.parquet").num_rows
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    assert sum(p for p, q in held if not q) <= 0.2 * sum(1 for _, q in held if not q)


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (None, "a b", None, None, None), (3, "word " * 9000, None, None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_model.score(docs, quality_model.train(docs, none)).collect()] == [0.5] * 4
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None), (9, 1)], "doc_id long, quality int")
    rows = quality_model.score(docs, quality_model.train(docs, some)).collect()
    assert all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality_model.score(docs.limit(0), quality_model.train(docs, none)).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = queries.op8_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(langs)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_of_odd_tables(spark):
    texts = [None, "", "123 $$", "der die das und nicht " * 30, "the and of that with " * 30, "x", "é" * 50000]
    docs = spark.createDataFrame([(i, t, "de" if i == 3 else "en" if i == 4 else None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].lang_pred in ("de", "en") for i in range(3, 7))
    assert {r.lang_pred for r in language.predict(docs, language.train(docs.limit(0))).collect()} == {"und"}
    assert language.predict(docs.limit(0), language.train(docs.limit(0))).count() == 0


def test_convolution_gradient():
    """The gradient of the loss along a few weights, against differences."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(1, 255, (6, language.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    m = language.ByteCnn(["a", "b", "c"])
    before = -m.log_probabilities(x)[np.arange(6), y].mean()
    m.fit(x, y)
    assert -m.log_probabilities(x)[np.arange(6), y].mean() < before


def test_pipeline_matches_its_stages_done_plainly(spark):
    pipe = importlib.import_module("corpus_pipeline")
    from tests_brute import pipeline_rows

    want = pipeline_rows(SF)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipe.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    pipe = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name, stage in pipe.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "word " * 30, None, None, None), (2, " ".join(f"w{i}" for i in range(40)), None, None, None)], DOCS)
    for name, stage in pipe.STAGES:
        assert stage(spark, odd, SF).count() <= 3, name


def test_bounded_samples(spark):
    from pyspark.sql import functions as F

    from lexmill.llm.common import least_hashed

    d = spark.range(3000).select("id", (F.col("id") % 3).alias("g"))
    order = [r.id for r in d.orderBy(F.shiftrightunsigned(F.xxhash64("id"), 40), F.xxhash64("id"), "id").collect()]
    assert {r.id for r in least_hashed(d, "id", 100).collect()} == set(order[:100])
    got = least_hashed(d, "id", 50, "g").collect()
    assert all({r.id for r in got if r.g == g} == set([i for i in order if i % 3 == g][:50]) for g in range(3))
    assert least_hashed(d, "id", 5000).count() == 3000 and least_hashed(d.limit(0), "id", 5, "g").count() == 0


def test_signs_of_numbers_are_no_letters():
    assert not any(language.has_letter(x) for x in ("²", "½", "①", "Ⅷ", "12_3", "")) and language.has_letter("½ a") and language.has_letter("ж")


def moved_mb(spark, run):
    """MB that the executors write to shuffles while run() lasts."""

    def written():
        time.sleep(0.3)
        spark.range(10).count()  # brings the figures of the tasks before it
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite() / 1e6

    before = written()
    run()
    return written() - before


def test_texts_that_stay_as_they_are_are_not_moved(spark, tmp_path):
    pipe = importlib.import_module("corpus_pipeline")
    rnd = np.random.default_rng(4)
    own = lambda: " ".join(np.char.add("w", rnd.integers(0, 10**9, 400).astype(str)))
    texts = [own() for _ in range(800)]
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate([*texts, *texts[:5], *(f"{t} secret=abcdefghij0123456789" for t in texts[5:10]), None, ""])]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    size = sum(len(r[1] or "") for r in rows) / 1e6
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sketched = moved_mb(spark, lambda: near_dup.near_duplicates(docs, percent=80).collect())
        out = {}
        near = moved_mb(spark, lambda: out.update(near=pipe.near_duplicates(spark, docs, "").collect()))
        secret = moved_mb(spark, lambda: out.update(secret=pipe.secret_scan(spark, docs, "").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r.doc_id for r in out["near"]) == [*range(800), 810, 811]
    assert {r.doc_id: r.text for r in out["secret"]} == {r[0]: r[1] and r[1].replace("secret=abcdefghij0123456789", "[SECRET]") for r in rows}
    assert near - sketched < size / 3 and secret < size / 3, (near, sketched, secret, size)
