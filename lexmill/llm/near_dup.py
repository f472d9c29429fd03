"""MinHash near-duplicates of whole documents by the LSH forest of `forest`.

Exact copies (equal shingle sets) are one node from the start, the least doc_id among them. A link is confirmed on the
full sets. Two documents at the bound of 0.85 share no prefix of 4 values in any of the 24 orders with a chance of
(1 - 0.85**4)**24, 2e-8, and none of 8 values, to which only regions of over 48 members in several components are cut,
with (1 - 0.85**8)**24, 5e-4.

Null and empty texts, and texts without words, have no shingles and link with nothing; a text of fewer words than a
shingle has its whole sequence as its one shingle. Repeated rows are copies of each other and share a component; rows
that share a doc_id but not a text are taken for versions of one document, linked with each other. A null doc_id is
kept, with its class's component. doc_id is an integer, or a text of one; other ids raise the error of the cast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .forest import LONGEST, Forest, sketches
from .linking import bit_filter, in_filter, may_hold, set_key
from .shingles import SMALL_CHUNK_BYTES, chunks, functions, shingle_sets, text_buffer

SIZE = 5
TREES = 24
PERCENT = 85


def sketch(docs: DataFrame, size: int = SIZE, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes; null without words), sig (MinHash values as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        muls = functions(trees * LONGEST)
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            n, keys, sigs = [], [], []
            for i, j in chunks(offsets, SMALL_CHUNK_BYTES):
                sets = shingle_sets(data, offsets[i : j + 1], size)
                n += [len(s) for s in sets]
                keys += [set_key(s) for s in sets]
                sigs += sketches(sets, muls)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, set_key binary, sig binary")


def document_sets(docs: DataFrame, size: int = SIZE):
    """A reader of (node, hashes) of the documents that a filter lets pass: sorted 64-bit hashes as bytes."""

    def read(wanted: DataFrame) -> DataFrame:
        bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(may_hold(bits.value, b.column("node").to_numpy(zero_copy_only=False))))
                data, offsets = text_buffer(b.column("text"))
                for i, j in chunks(offsets, SMALL_CHUNK_BYTES):
                    sets = shingle_sets(data, offsets[i : j + 1], size)
                    yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

        own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
        return own.mapInArrow(run, "node long, hashes binary")

    return read


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs."""
    with small_batches(docs.sparkSession):
        sketched = cut(sketch(docs, size))
        nodes = cut(
            sketched.filter("set_key is not null and doc_id is not null").groupBy("set_key", F.col("n_shingles").alias("n"))
            .agg(F.min(F.struct(F.col("doc_id").cast("long").alias("node"), "sig")).alias("m")).select("set_key", "n", "m.*")
        )
        found = Forest(nodes, document_sets(docs, size), percent, TREES).run()
    classes = nodes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("c"))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.coalesce(F.col("c"), F.col("doc_id").cast("long"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def first_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates, its least doc_id; rows without words all stay.

    A row with a null doc_id goes by a number made from its text, over all ids up to 2**62, so it links like any other
    and stays only where its group has no id. Of several rows of the id that stays, the one of least text digest does.
    """
    made = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    # rows travel as one struct, so no column of docs can clash with those made here
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.when(F.col("text").isNotNull(), made)).alias("id"))
    found = near_duplicates(named.select(F.col("id").alias("doc_id"), "text"), size, percent)
    ids = cut(found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("node")).agg(F.max("kept").alias("kept"), F.count("*").alias("copies")))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # rows whose id the filter does not know stay for sure and are not moved; of the others those that stay are joined
    known = in_filter(ids.filter("not kept or copies > 1"))
    doubt = cut(ids.filter("kept").filter(known(F.col("node"))).select("node"))
    sure = named.filter(~worded | ~known(F.coalesce("id", F.lit(0)))).select("row")
    met = named.filter(worded).filter(in_filter(doubt)(F.col("id"))).join(doubt, F.col("id") == F.col("node"), "left_semi")
    return sure.unionByName(met.groupBy("id").agg(F.min_by("row", F.sha2("text", 256)).alias("row")).select("row")).select("row.*")
