"""Removal of repeated byte strings by bucket-pointer refinement, over the whole corpus and without a suffix array of it.

A byte goes if it lies in a 100-byte string that also starts earlier (smaller doc_id, or same document, earlier start).

Bucket-pointer refinement puts positions into buckets by their first q bytes and refines a bucket by sorting on the
bucket identifiers at later offsets, whose refined values serve the next, doubled depth. Here:

1. Buckets of q-grams. Only anchors are kept: for each 100-byte string the place of its least q-gram hash. The choice
   depends on nothing but the string, so equal strings have their anchor at the same offset, and one place in forty
   stands for all positions around it. An anchor carries its bucket and the identifier of its wide context (all bytes
   of any string that it stands for).
2. A bucket whose places have one context needs no refinement: each place but the first is a repeat as a whole. Of a
   bucket with several contexts, the first place of each context is refined.
3. Refinement of these places on the bytes themselves: positions of a block of buckets are sorted on 8-byte buckets,
   then on pairs of identifiers at offsets 8, 16, 32 and 36, to the depth of 100 bytes. A string is a repeat if its
   identifier has an earlier place.

Places reach a bucket sorted by context and document and are read as a stream, one pending row at a time. A place that
repeats an earlier one of its own batch is known as a repeat at once and is dealt out by its document, not its bucket,
so a passage or document with very many copies doesn't gather in one task. Documents in which nothing repeats are told
by a bit filter of fixed size and never moved.

Null text counts as empty; texts under 100 bytes lose nothing. Rows that share a doc_id are one document in the order,
so repeated rows all lose the bytes that any of them repeats of the others; make ids unique where that is unwanted. A
null doc_id comes before all others. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64
from .linking import MAX_STATES, bit_filter, may_hold
from .shingles import _BACK, _BASE, chunks, powers, text_buffer

LENGTH, Q = 100, 24
REACH = LENGTH - Q
WIDE = REACH + LENGTH
#: Stands for a null doc_id: before all others.
NO_ID = -(1 << 62)
#: Bytes of texts and of results that a Python task holds at once (a longer text is held alone), and anchors.
TEXT_BYTES, HELD_BYTES, ANCHORS = 1 << 18, 1 << 21, 1 << 17
#: Contexts refined at once; a bucket with more is refined in several blocks.
BLOCK = 1024
_rng = np.random.default_rng(77)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(part: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of concatenated texts: (place, first and last start of the strings it stands for, text, bucket, context) of each anchor."""
    n = len(part)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < LENGTH:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[part] * powers(_BASE, n), out=sums[1:])
    back = powers(_BACK, n)
    val = mix64((sums[Q:] - sums[:-Q]) * back[: n - Q + 1])
    gram, idx, w = val, np.arange(len(val), dtype=np.int32), 1
    steps = []
    while 2 * w <= REACH + 1:
        steps.append(w)
        w *= 2
    steps += [REACH + 1 - w] * (w < REACH + 1)
    for s in steps:
        take = val[s:] < val[:-s]
        val, idx = np.where(take, val[s:], val[:-s]), np.where(take, idx[s:], idx[:-s])
    doc = np.repeat(np.arange(len(starts)), ends - starts)[: n - LENGTH + 1]
    p = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= ends[doc])
    if not len(p):
        return none
    a, d = idx[p].astype(np.int64), doc[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    place, of = a[at], d[at]
    lo, hi = np.maximum(place - REACH, starts[of]), np.minimum(place + LENGTH, ends[of])
    context = mix64((sums[hi] - sums[lo]) * back[lo] + ((place - lo) * 1024 + (hi - place)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return place, p[at], p[last], of, gram[place], context


def _places(docs: DataFrame) -> DataFrame:
    """(bucket, context, doc_id, place): an anchor a row. A known repeat has ~place and a key of its own as its bucket."""

    def marked(found: list[tuple]) -> pa.RecordBatch:
        doc, place, bucket, context = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, doc, context, bucket))
        known = np.zeros(len(order), bool)
        known[order[1:]] = (bucket[order][1:] == bucket[order][:-1]) & (context[order][1:] == context[order][:-1])
        bucket = np.where(known, mix64(doc.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), bucket)
        context, place = np.where(known, np.uint64(0), context), np.where(known, ~place, place)
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(place)], ["bucket", "context", "doc_id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            found, held = [], 0
            for i, j in chunks(offsets, TEXT_BYTES):
                o = offsets[i : j + 1] - offsets[i]
                place, _, _, of, bucket, context = anchors(data[offsets[i] : offsets[j]], o[1:], o[:-1])
                found.append((ids[i + of], (place - o[of]).astype(np.int32), bucket, context))
                held += len(place)
                if held >= ANCHORS:
                    yield marked(found)
                    found, held = [], 0
            if found:
                yield marked(found)

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, context long, doc_id long, place int")


def _judged(places: DataFrame) -> DataFrame:
    """(doc_id, place, refine): repeats as a whole, and places to refine; places alone in their bucket go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # bucket, context, whether several contexts were seen, pending (doc, place)
        for b in batches:
            bucket, context, doc, place = (b.column(c).to_numpy() for c in ("bucket", "context", "doc_id", "place"))
            known = place < 0
            out = [(doc[known], ~place[known], np.zeros(int(known.sum()), bool))]
            bucket, context, doc, place = (x[~known] for x in (bucket, context, doc, place))
            n = len(bucket)
            if n:
                new_b, first = np.ones(n, bool), np.ones(n, bool)
                new_b[1:] = bucket[1:] != bucket[:-1]
                first[1:] = new_b[1:] | (context[1:] != context[:-1])
                goes_on = last is not None and last[0] == bucket[0]
                first[0] = not (goes_on and last[1] == context[0])
                group = np.cumsum(new_b) - 1
                several = np.bincount(group, first) > 1
                if goes_on:
                    # a new context in the bucket's further rows makes several with the one before
                    several[0] = last[2] or bool(first[group == 0].any())
                    if several[0] and last[3] is not None:
                        out.append((np.array([last[3][0]]), np.array([last[3][1]], np.int32), np.array([True])))
                hit = ~first | several[group]
                pending = None
                if not several[-1]:
                    # the first place of the last bucket waits until a second context is seen
                    head = np.flatnonzero((group == group[-1]) & first)
                    pending = (int(doc[head[0]]), int(place[head[0]])) if len(head) else last[3]
                out.append((doc[hit], place[hit], first[hit]))
                last = (bucket[-1], context[-1], bool(several[-1]), pending)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["doc_id", "place", "refine"])

    dealt = places.repartition("bucket").sortWithinPartitions("bucket", "context", "doc_id", "place")
    return dealt.mapInArrow(run, "doc_id long, place int, refine boolean")


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals; those that touch are one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def digest(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, str]:
    """(bytes, removed bytes, removed runs, hash of what is left)."""
    left = hashlib.sha256()
    at = 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        left.update(raw[at:a])
        at = b
    left.update(raw[at:])
    return len(raw), int((hi - lo).sum()), len(lo), left.hexdigest()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _packed(docs: DataFrame, bits) -> DataFrame:
    """Texts of the documents that a filter lets pass, as compressed bytes, to move less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.filter(pa.array(may_hold(bits.value, b.column("doc_id").to_numpy(zero_copy_only=False))))
            for i, j in chunks(text_buffer(b.column("text"))[1], HELD_BYTES):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([pack.compress((t.as_py() or "").encode()) for t in part.column("text")], pa.binary())], ["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def _whole(docs: DataFrame, bits) -> DataFrame:
    """Digests of the documents that a filter shows to be without repeats; they are not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in batches:
            b = b.filter(pa.array(~may_hold(bits.value, b.column("doc_id").to_numpy(zero_copy_only=False))))
            rows = [digest((t.as_py() or "").encode(), none, none) for t in b.column("text")]
            cols = [b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(run, RESULT)


def _first_pass(joined: DataFrame) -> DataFrame:
    """A row a document: its digest where nothing is to refine, else its text, intervals so far and contexts to refine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("packed", pa.binary()), ("spans", pa.list_(pa.int32())), ("contexts", pa.list_(pa.struct([("bucket", pa.int64()), ("place", pa.int32()), ("lo", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("raw", pa.binary())])))])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

        for b in batches:
            rows, held = [], 0
            for doc_id, packed, found in zip(b.column("doc_id").to_pylist(), b.column("packed"), b.column("found")):
                if held >= HELD_BYTES:
                    yield out(rows)
                    rows, held = [], 0
                small = packed.as_py()
                raw = unpack.decompress(small) if small else b""
                got = np.asarray(found.values, np.int64) if found.is_valid else np.zeros(0, np.int64)
                if not len(got):
                    rows.append((doc_id, *digest(raw, got, got), None, None, None))
                    continue
                x = np.frombuffer(raw, np.uint8)
                place, first, last, _, bucket, _ = anchors(x, np.array([len(x)]), np.array([0]))
                whole = np.isin(place, got[got % 2 == 0] // 2)
                lo, hi = merged(first[whole], last[whole] + LENGTH)
                fine = np.flatnonzero(np.isin(place, got[got % 2 == 1] // 2))
                if not len(fine):
                    rows.append((doc_id, *digest(raw, lo, hi), None, None, None))
                    continue
                contexts = []
                for k in fine.tolist():
                    s = int(max(first[k], 0))
                    contexts.append({"bucket": int(bucket[k : k + 1].view(np.int64)[0]), "place": int(place[k]), "lo": s, "first": int(first[k]), "last": int(last[k]), "raw": raw[s : int(last[k]) + LENGTH]})
                rows.append((doc_id, len(raw), None, None, None, small, np.stack([lo, hi], 1).ravel().astype(np.int32), contexts))
                held += len(small) + 1024 * len(contexts)
            yield out(rows)

    return joined.mapInArrow(run, RESULT + ", packed binary, spans array<int>, contexts array<struct<bucket:bigint,place:int,lo:int,first:int,last:int,raw:binary>>")


def refined(raws: list[bytes], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers, offsets): the `depth`-byte bucket of each position of concatenated strings, by refinement on the buckets of later offsets.

    Positions with less than `depth` bytes left in their string have -1.
    """
    at = np.cumsum([0] + [len(r) for r in raws])
    x = np.frombuffer(b"".join(raws), np.uint8)
    n = len(x)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    wide = np.zeros(n, np.uint64)
    for k in range(8):
        wide[: n - k] |= x[k:].astype(np.uint64) << np.uint64(8 * k)
    alive = np.flatnonzero(left >= 8)
    ids = np.full(n, -1, np.int64)
    ids[alive] = np.unique(wide[alive], return_inverse=True)[1]
    have = 8
    while have < depth:
        step = min(have, depth - have)
        alive = np.flatnonzero(left >= have + step)
        pair = (ids[alive] << 32) | ids[alive + step]
        ids = np.full(n, -1, np.int64)
        ids[alive] = np.unique(pair, return_inverse=True)[1]
        have += step
    return ids, at


def _refined(contexts: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): strings of the contexts that an earlier place of their bucket has too.

    A bucket of more than BLOCK contexts is dealt into blocks of about that many. What repeats within a block is known
    there; the first place of each string of such a block is passed on with a 128-bit key of the string, and keys tell
    which of them repeat an earlier one. So a task holds one block, however large the bucket.
    """

    def block(rows: list[tuple], keyed: bool) -> pa.RecordBatch:
        ids, at = refined([r[6] for r in rows])
        own = [np.arange(at[k] + r[4] - r[3], at[k] + r[5] - r[3] + 1) for k, r in enumerate(rows)]
        flat = np.concatenate(own)
        of = np.repeat(np.arange(len(rows)), [len(o) for o in own])
        # rows are sorted by bucket, doc_id and place; buckets are told apart by the anchor's offset and bytes, which the strings hold
        _, first = np.unique(ids[flat], return_index=True)
        repeat = np.ones(len(flat), bool)
        repeat[first] = False
        docs, los, his, keys = [], [], [], []
        shift = np.array([r[3] for r in rows]) - at[:-1]
        for i, s in zip(of[repeat].tolist(), (flat + shift[of])[repeat].tolist()):
            if docs and docs[-1] == rows[i][1] and los[-1] <= s <= his[-1]:
                his[-1] = s + LENGTH
            else:
                docs.append(rows[i][1])
                los.append(s)
                his.append(s + LENGTH)
        keys = [None] * len(docs)
        if keyed:
            raw = b"".join(r[6] for r in rows)
            for f in first.tolist():
                s = int(flat[f] + shift[of[f]])
                docs.append(rows[of[f]][1])
                los.append(s)
                his.append(s + LENGTH)
                keys.append(hashlib.blake2b(raw[flat[f] : flat[f] + LENGTH], digest_size=16).digest())
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(los, pa.int32()), pa.array(his, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "lo", "hi", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "place", "lo", "first", "last", "raw", "blocks", "salt"))):
                if held and (r[0], r[8]) != (held[-1][0], held[-1][8]) and (r[7] > 1 or held[-1][7] > 1 or len(held) >= BLOCK // 2):
                    yield block(held, held[-1][7] > 1)
                    held = []
                held.append(r)
        if held:
            yield block(held, held[-1][7] > 1)

    count = cut(contexts.groupBy("bucket").agg(F.count("*").alias("c")).filter(f"c > {BLOCK}"))
    sized = contexts.join(F.broadcast(count) if count.count() <= MAX_STATES else count, "bucket", "left")
    dealt = sized.withColumn("blocks", F.coalesce(F.ceil(F.col("c") / BLOCK), F.lit(1)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), "blocks").cast("int")).drop("c")
    out = cut(dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "doc_id", "place").mapInArrow(run, "doc_id long, lo int, hi int, key binary"))
    firsts = out.filter("key is not null")
    least = firsts.groupBy("key").agg(F.min(F.struct("doc_id", "lo")).alias("m"))
    again = firsts.join(least, "key").filter("doc_id <> m.doc_id or lo <> m.lo")
    return out.filter("key is null").select("doc_id", "lo", "hi").unionByName(again.select("doc_id", "lo", "hi"))


def _last_pass(rest: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, packed, spans, more in zip(b.column("doc_id").to_pylist(), b.column("packed"), b.column("spans"), b.column("more")):
                s = np.asarray(spans.values, np.int64).reshape(-1, 2)
                m = np.asarray(more.values, np.int64) if more.is_valid else np.zeros(0, np.int64)
                lo, hi = merged(np.concatenate([s[:, 0], m >> 32]), np.concatenate([s[:, 1], m & 0xFFFFFFFF]))
                rows.append((doc_id, *digest(unpack.decompress(packed.as_py()), lo, hi)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rest.mapInArrow(run, RESULT)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a row of docs."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    judged = _judged(_places(own.filter(F.octet_length("text") >= LENGTH)))
    found = cut(judged.groupBy("doc_id").agg(F.collect_list(F.col("place").cast("long") * 2 + F.col("refine").cast("long")).alias("found")))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(found.select(F.col("doc_id").alias("node"))))
    state = cut(_first_pass(_packed(own, bits).join(found, "doc_id", "left").select("doc_id", "packed", "found")))
    contexts = state.filter("contexts is not null").select("doc_id", F.explode("contexts").alias("c")).select("doc_id", "c.*")
    more = _refined(contexts).groupBy("doc_id").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))).alias("more"))
    done = state.filter("packed is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rest = state.filter("packed is not null").select("doc_id", "packed", "spans").join(more, "doc_id", "left").select("doc_id", "packed", "spans", "more")
    out = _whole(own, bits).unionByName(done).unionByName(_last_pass(rest))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
