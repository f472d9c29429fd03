"""Substring dedup by paragraph MinHash banding.

A unit is a run of words of one text, named by its first word. There are two kinds, and no word is without a unit:

* `line`: every line with a word, however short, and a text of several lines with under `RUN` words as a whole too, so
  that it meets the same words on other lines.
* `passage`: `PASSAGE` words whose place the words choose, whatever lines they span: of all starts in each run of `RUN`
  words the one whose first five words have the least rank. So every run of `RUN` words that two texts share, inside a
  line or across lines, holds a passage that is cut alike in both.

Bands of MinHash values are tuned for recall (`BANDS`): lines at the bound of 0.8 collide in none with a chance of
(1 - 0.8**3)**10, 8e-4. Colliding lines are joined, and their exact Jaccard similarity on sets of five-word shingles is
verified. Colliding passages are verified to be copies: a passage that differs in a word has a similarity under 0.8 but
at its ends, and a shared run holds a copied passage anyway, so one band finds all. Removals are clustered by connected
components: of each, the first unit in order of (doc_id, start) stays and the others go.

Two hashes a band and a place are moved for a unit; a later copy in a block of texts is moved for its first band only.
Copies (the same words in order) are told in that one exchange and are one node from there on; sets are made only for
lines that collide with other words.

Null and empty texts have no units; a unit of fewer than five words has its whole sequence as its one shingle. Repeated
rows of one doc_id and text count as one document; of rows of one doc_id with different texts, a unit of any of them
stands for all that start at its word. Rows with a null doc_id are left alone; a doc_id outside of
0 .. 2**37-1 or a text of 2**25 words raises ValueError. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64
from .linking import Linker, bit_filter, may_hold
from .shingles import chunks, combine, functions, sequence_hash, text_buffer, words

SIZE = 5
PERCENT = 80
#: Words of a passage, and of a shared run that is sure to hold one.
PASSAGE, RUN = 21, 50
KINDS = ("line", "passage")
#: Bands of each kind and values of a band.
BANDS, DEPTH = (10, 1), 3
#: A place is the doc_id, the kind and the first word in one number.
KIND_BIT = 25
MAX_ID = (1 << 63 - KIND_BIT - 1) - 1
#: Stands for the first word of a whole text in its place, after those of its lines.
WHOLE = (1 << KIND_BIT) - 1
#: Rank of a word sequence: the words' numbers times these, modulo PRIME. Fixed, as the SQL has the same.
PRIME, FACTORS = 2147483647, (1103515245, 1664525, 214013, 16843009, 69069)
#: Word numbers kept by a worker before its table starts anew.
MAX_NUMBERS = 1_000_000
_numbers: dict[int, int] = {}


class Units(NamedTuple):
    """Units of a block of texts: row, kind, first word, number of words and whether it is a whole text; shingles of all (flat, with bounds)."""

    row: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    count: np.ndarray
    whole: np.ndarray
    flat: np.ndarray
    at: np.ndarray


def word_numbers(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number under 2**28 of each word: the first seven digits of the MD5 of its lower-cased form."""
    known, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    if len(_numbers) > MAX_NUMBERS:
        _numbers.clear()
    out = []
    for h, i in zip(known.tolist(), first.tolist()):
        if (n := _numbers.get(h)) is None:
            word = data[starts[i] : ends[i]].tobytes().translate(_LOWER)
            n = _numbers[h] = int(hashlib.md5(word).hexdigest()[:7], 16)
        out.append(n)
    return np.array(out, np.int64)[place] if out else np.zeros(0, np.int64)


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_spans(data: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end, whether it is a whole text) of the line units of texts whose words start at `starts`; row r
    has words bounds[r]:bounds[r + 1]."""
    lo = int(starts[0]) if len(starts) else 0
    breaks = lo + np.flatnonzero(data[lo : int(starts[-1])] == 10) if len(starts) else starts
    line = np.searchsorted(breaks, starts)
    opens = np.ones(len(starts), bool)
    opens[1:] = line[1:] != line[:-1]
    opens[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(opens)
    end = np.append(first[1:], len(starts))[: len(first)]
    row = np.searchsorted(bounds, first, "right") - 1
    whole = np.flatnonzero((np.diff(bounds) < RUN) & (np.bincount(row, minlength=len(bounds) - 1) > 1))
    is_whole = np.arange(len(row) + len(whole)) >= len(row)
    return np.concatenate([row, whole]), np.concatenate([first, bounds[whole]]), np.concatenate([end, bounds[whole + 1]]), is_whole


def passage_starts(rank: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of the passages of texts whose words have ranks."""
    reach = RUN - PASSAGE + 1
    runs = len(rank) - RUN + 1
    if runs <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    val, idx, w = rank, np.arange(len(rank)), 1
    steps = []
    while 2 * w <= reach:
        steps.append(w)
        w *= 2
    steps += [reach - w] * (w < reach)
    for s in steps:  # the first of the least ranks of ever wider windows
        take = val[s:] < val[:-s]
        val, idx = np.where(take, val[s:], val[:-s]), np.where(take, idx[s:], idx[:-s])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:runs]
    inside = np.arange(runs) + RUN <= bounds[row + 1]
    picked = np.unique(idx[:runs][inside])
    return np.searchsorted(bounds, picked, "right") - 1, picked


def units(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> Units:
    hashes, starts, ends, bounds = words(data, offsets)
    row, first, end, whole = line_spans(data, starts, bounds)
    numbers = word_numbers(data, hashes, starts, ends)
    rank = np.full(len(numbers), PRIME, np.int64)
    if len(numbers) >= size:
        rank[: len(numbers) - size + 1] = sum(numbers[k : len(numbers) - size + 1 + k] * FACTORS[k % len(FACTORS)] for k in range(size)) % PRIME
    prow, pfirst = passage_starts(rank, bounds)
    rolled = combine(hashes, size)
    row, first, end = np.concatenate([row, prow]), np.concatenate([first, pfirst]), np.concatenate([end, pfirst + PASSAGE])
    kind = np.repeat(np.array([0, 1]), [len(row) - len(prow), len(prow)])
    whole = np.concatenate([whole, np.zeros(len(prow), bool)])
    count = end - first
    sizes = np.maximum(count - size + 1, 1)
    at = np.zeros(len(row) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    index = np.arange(at[-1]) + np.repeat(first - at[:-1], sizes)
    short = count < size
    flat = rolled[np.minimum(index, len(rolled) - 1)] if len(rolled) else np.zeros(at[-1], np.uint64)
    for i in np.flatnonzero(short).tolist():
        flat[at[i]] = sequence_hash(hashes[first[i] : end[i]])
    return Units(row, kind, first - bounds[row], count, whole, flat, at)


def places(ids: np.ndarray, u: Units) -> np.ndarray:
    """Numbers of units whose rows have these doc_ids."""
    if len(u.row) and (ids.min() < 0 or ids.max() > MAX_ID or u.start.max() >= WHOLE):
        raise ValueError(f"doc_id must be in 0 .. {MAX_ID} and a text have under {1 << KIND_BIT} words")
    return (ids[u.row] << KIND_BIT + 1) | (u.kind << KIND_BIT) | np.where(u.whole, WHOLE, u.start)


def band_keys(u: Units, node: np.ndarray, muls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, region, sequence): the bands of units, keyed by kind, band and DEPTH MinHash values, with a hash of the
    unit's words in order. The region of a first band has bit 0, that of a line
    bit 1. Of units of one sequence all but the least node have their
    first band only: their class is found there, and its least node stands for it elsewhere."""
    if not len(u.row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(u.flat)) - np.repeat(u.at[:-1], np.diff(u.at))
    sequence = np.add.reduceat(mix64(u.flat + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), u.at[:-1])
    order = np.argsort(node, kind="stable")
    first = np.zeros(len(node), bool)
    first[order[np.unique(sequence[order] ^ u.kind[order].astype(np.uint64), return_index=True)[1]]] = True
    out_unit, out_key, out_seq = [], [], []
    lines = int((u.kind == 0).sum())
    for kind, (a, b) in enumerate(((0, lines), (lines, len(node)))):
        if a == b:
            continue
        flat, at = u.flat[u.at[a] : u.at[b]], u.at[a:b] - u.at[a]
        for band in range(BANDS[kind]):
            key = np.full(b - a, band * 2 + kind + 1, np.uint64)
            for d in range(DEPTH):
                key = mix64(key * np.uint64(0xD1B54A32D192ED03) ^ np.minimum.reduceat(flat * muls[band * DEPTH + d], at))
            keep = np.arange(a, b) if band == 0 else a + np.flatnonzero(first[a:b])
            out_unit.append(keep)
            out_key.append((key[keep - a] & ~np.uint64(3)) | np.uint64((band == 0) + 2 * (kind == 0)))
            # 32 bits tell sequences apart in further bands, where a false copy costs a band of many
            out_seq.append(sequence[keep] if band == 0 else sequence[keep] & np.uint64(0xFFFFFFFF))
    return tuple(np.concatenate(x).view(np.int64) for x in (out_unit, out_key, out_seq))


def _located(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def bands(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(region, sequence, node, n_words): the bands of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        muls = functions(max(BANDS) * DEPTH, seed=3)
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            for i, j in chunks(offsets):
                u = units(data, offsets[i : j + 1], size)
                node = places(ids[i:j], u)
                unit, region, sequence = band_keys(u, node, muls)
                yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(sequence), pa.array(node[unit]), pa.array(u.count[unit].astype(np.int32))], ["region", "sequence", "node", "n_words"])

    return _located(docs).mapInArrow(run, "region long, sequence long, node long, n_words int")


def shared_bands(rows: DataFrame) -> DataFrame:
    """(region, node, other, n_words): copies, with a null region and the least node of their sequence, and, of lines, the
    least nodes of regions that hold two or more sequences, each with the region's leader.

    One exchange of all bands of all units, so that one common unit is a small part of a task; each task reads its
    regions as a sorted stream and holds one pending row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # region, sequence and least node of the last row, leader of its region with n_words, whether it is still to be emitted
        last: tuple | None = None
        for b in batches:
            region, sequence, node, count = (b.column(c).to_numpy() for c in ("region", "sequence", "node", "n_words"))
            if not len(region):
                continue
            goes_on = last is not None and last[0] == region[0]
            head = np.ones(len(region), bool)
            head[1:] = (region[1:] != region[:-1]) | (sequence[1:] != sequence[:-1])
            head[0] = not (goes_on and last[1] == sequence[0])
            h = np.flatnonzero(head)
            # the least node of each row's sequence
            rep = node[h[np.maximum(np.cumsum(head) - 1, 0)]] if len(h) else np.zeros(len(node), node.dtype)
            before = int(h[0]) if len(h) else len(node)
            if before:
                rep = rep.copy()
                rep[:before] = last[2]
            copy = np.flatnonzero((rep != node) & (region & 1 == 1))
            cols = [[np.zeros(len(copy), np.int64)], [node[copy]], [rep[copy]], [count[copy]], [np.ones(len(copy), bool)]]
            pending = last[3:] if last is not None else None
            if len(h):
                new = np.ones(len(h), bool)
                new[1:] = region[h][1:] != region[h][:-1]
                new[0] = not (last is not None and last[0] == region[h[0]])
                group = np.cumsum(new) - new[0]
                at = np.flatnonzero(new)
                leader, shown = node[h[at]], np.bincount(group)[:] > 1
                if not new[0]:  # the first heads belong to the region of the last batch
                    leader = np.concatenate([[last[3]], leader])
                    shown[0] = True
                    if last[5] and last[0] & 2:
                        for c, x in zip(cols, (last[0], last[3], last[3], last[4], False)):
                            c.append(np.array([x]))
                hit = np.flatnonzero(shown[group] & (region[h] & 2 > 0))
                for c, x in zip(cols, (region[h[hit]], node[h[hit]], leader[group[hit]], count[h[hit]], np.zeros(len(hit), bool))):
                    c.append(x)
                lead = h[at[-1]] if len(at) else None
                pending = (int(node[lead]), int(count[lead]), not shown[-1]) if lead is not None else (last[3], last[4], False)
            last = (int(region[-1]), int(sequence[-1]), int(rep[-1]), *pending)
            region, node, other, count, copied = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays([pa.array(region, mask=copied), pa.array(node), pa.array(other), pa.array(count.astype(np.int32))], ["region", "node", "other", "n_words"])

    dealt = rows.repartition("region").sortWithinPartitions("region", "sequence", "node")
    return dealt.mapInArrow(run, "region long, node long, other long, n_words int")


def unit_sets(docs: DataFrame, wanted: DataFrame, size: int = SIZE) -> DataFrame:
    """(node, hashes) of the wanted units and of a few others that the filter lets pass; texts without any are passed over."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted))
    of_docs = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.shiftright("node", KIND_BIT + 1).alias("node")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(may_hold(of_docs.value, b.column("doc_id").to_numpy())))
            data, offsets = text_buffer(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            for i, j in chunks(offsets):
                u = units(data, offsets[i : j + 1], size)
                node = places(ids[i:j], u)
                hit = np.flatnonzero(may_hold(bits.value, node))
                sets = [np.unique(u.flat[x:y]).tobytes() for x, y in zip(u.at[hit].tolist(), u.at[hit + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(sets, pa.binary())], ["node", "hashes"])

    return _located(docs).mapInArrow(run, "node long, hashes binary")


def removed_units(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, kind, start (word number from 0), n_words, kept_doc_id, kept_start: a row for each unit that repeats an
    earlier one of its kind. A unit that overlaps the kept one in its own text stays."""
    shared = cut(shared_bands(bands(docs, size)))
    members = shared.filter("region is not null")
    linker = Linker(percent, sets=cut(unit_sets(docs, cut(members.select("node").distinct()), size)))
    linker.confirm(cut(members.filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()))
    muls = functions(max(BANDS) * DEPTH, seed=3)

    def signature(sets: list[np.ndarray]) -> np.ndarray:
        flat, at = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        return np.stack([np.minimum.reduceat(flat * m, at) for m in muls], 1).reshape(len(sets), -1, DEPTH)

    # sizes are left to the exact check
    found = linker.settle(members.select("region", F.lit(0).alias("tree"), "node", F.lit(1).alias("n")).distinct(), trees=1, signature=signature)
    copies = shared.filter("region is null").select("node", F.col("other").alias("rep"), "n_words").distinct()
    kept = copies.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", "n_words", F.coalesce("component", "rep").alias("kept"))
    merged = members.select("node", "n_words").distinct().join(found, "node").select("node", "n_words", F.col("component").alias("kept"))
    start = lambda c: F.when(F.col(c).bitwiseAND(F.lit(WHOLE)) == WHOLE, 0).otherwise(F.col(c).bitwiseAND(F.lit(WHOLE)))
    out = kept.unionByName(merged).filter("kept <> node").select(
        F.shiftright("node", KIND_BIT + 1).alias("doc_id"),
        F.when(F.shiftright("node", KIND_BIT).bitwiseAND(F.lit(1)) == 0, KINDS[0]).otherwise(KINDS[1]).alias("kind"),
        start("node").alias("start"), F.col("n_words").cast("long").alias("n_words"),
        F.shiftright("kept", KIND_BIT + 1).alias("kept_doc_id"), start("kept").alias("kept_start"),
    )
    return out.filter("doc_id <> kept_doc_id or start - kept_start >= n_words")


def without_removed(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs whose texts lack the words of the removed units and the white space inside of them; all columns pass."""
    runs = removed.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.collect_set(F.struct("start", "n_words")).alias("runs"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("key"))
    both = packed.join(runs, "key", "left").select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], "runs")
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(width)
            if spans.null_count < len(spans):
                texts = [t if s is None or t is None else _cut_words(t, [(x["start"], x["start"] + x["n_words"]) for x in s]) for t, s in zip(b.column(at).to_pylist(), spans.to_pylist())]
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b.select(range(width)).rename_columns(names)

    names = docs.columns
    return both.mapInArrow(run, docs.schema)


def _cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, starts, ends, _ = words(raw, np.array([0, len(raw)]))
    out, at = [], 0
    for a, b in sorted(runs):
        lo, hi = int(starts[a]), int(ends[b - 1])
        if lo >= at:
            out.append(raw[at:lo].tobytes())
        at = max(at, hi)
    return b"".join([*out, raw[at:].tobytes()]).decode()
