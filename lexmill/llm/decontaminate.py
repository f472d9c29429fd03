"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity says little. Items are therefore partitioned by
size: class k holds items of 2**k to 2**(k+1)-1 distinct shingles, and for it each document is searched in overlapping
windows of four times 2**k shingles, in which an item keeps a Jaccard similarity of about 0.2 or more. A window and an
item that agree in any of `FUNCTIONS` MinHash values are candidates (bands of one value: the tuning for that
similarity; a contained item is missed with a chance under 1e-5). Window minima of a class come from those of the class
below, so a document is hashed once. Candidates are verified by exact shingle containment in the whole document.

A text of fewer words than a shingle has its whole sequence as its one shingle. Null and empty texts contain nothing
and are contained in nothing; equal items and repeated rows are reported each. The item index is bounded: items are
read in blocks of `ITEM_BLOCK`, one pass of the documents a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64
from .shingles import chunks, functions, shingle_lists, shingle_sets, text_buffer

SIZE = 5
PERCENT = 80
FUNCTIONS = 64
#: Items whose index is sent to the workers at once; about 1 kB an item.
ITEM_BLOCK = 20_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


class ItemIndex:
    """MinHash values of items by size class, and their full sets."""

    def __init__(self, ids: list, texts: list[str | None], size: int, count: int = FUNCTIONS):
        self.size, self.count = size, count
        data, offsets = text_buffer(pa.array([t or "" for t in texts], pa.string()))
        self.ids, self.sets = ids, shingle_sets(data, offsets, size)
        muls = functions(count, seed=7)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                by_class.setdefault(len(s).bit_length() - 1, []).append(i)
        for k, items in by_class.items():
            # the function's number is mixed into the value, so that one sorted array serves all functions
            keys = np.array([[mix64(np.array([(self.sets[i] * m).min() ^ np.uint64(f)]))[0] for f, m in enumerate(muls)] for i in items], np.uint64).ravel()
            owner = np.repeat(np.array(items), count)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[keys >> np.uint64(64 - _BITS)] = True
            self.classes[k] = keys[order], owner[order], seen

    def search(self, data: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) for each item that a row contains."""
        flat, at = shingle_lists(data, offsets, self.size)
        if not len(flat) or not self.classes:
            return []
        low = min(self.classes)
        step = 1 << (low + 1)
        rows = np.repeat(np.arange(len(at) - 1), -(-np.diff(at) // step))
        first = np.concatenate([np.arange(a, b, step) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if b > a])
        mins = np.empty((self.count, len(first)), np.uint64)
        buf = np.empty_like(flat)
        for f, m in enumerate(functions(self.count, seed=7)):
            np.multiply(flat, m, out=buf)
            np.minimum.reduceat(buf, first, out=mins[f])
        found: set[tuple[int, int]] = set()
        number = np.arange(self.count, dtype=np.uint64)[:, None]
        for k in range(low, max(self.classes) + 1):
            if k in self.classes:
                keys, owner, seen = self.classes[k]
                windows = mins.copy()
                same = np.flatnonzero(rows[:-1] == rows[1:])
                windows[:, same] = np.minimum(mins[:, same], mins[:, same + 1])
                v = mix64(windows ^ number)
                w = np.flatnonzero(seen[v >> np.uint64(64 - _BITS)].ravel())
                v = v.ravel()[w]
                lo, hi = np.searchsorted(keys, v, "left"), np.searchsorted(keys, v, "right")
                for i in np.flatnonzero(hi > lo).tolist():
                    found.update((int(rows[w[i] % len(rows)]), o) for o in owner[lo[i] : hi[i]].tolist())
            # blocks of the next class: two of this one
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = np.flatnonzero(place % 2 == 0)
            mins, rows = np.minimum.reduceat(mins, keep, axis=1), rows[keep]
        out, sets = [], {}
        for r, i in sorted(found):
            if r not in sets:
                sets = {r: np.unique(flat[at[r] : at[r + 1]])}
            whole, q = sets[r], self.sets[i]
            p = np.minimum(np.searchsorted(whole, q), len(whole) - 1)
            shared = int((whole[p] == q).sum())
            if 100 * shared >= percent * len(q):
                out.append((r, i, shared))
        return out


def item_blocks(items: DataFrame, id_col: str, size: int) -> Iterator[ItemIndex]:
    """Indexes of bounded blocks of the items, in order of id."""
    rows = items.select(id_col, "text").orderBy(id_col, "text")
    ids, texts = [], []
    for r in rows.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == ITEM_BLOCK:
            yield ItemIndex(ids, texts, size)
            ids, texts = [], []
    if ids:
        yield ItemIndex(ids, texts, size)


def contained_items(docs: DataFrame, items: DataFrame, item_id: str = "item_id", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: a row for each item of which a document holds `percent` of the shingles."""
    sc = docs.sparkSession.sparkContext
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)[item_id]}, n_item_shingles long, n_shared long, containment double"
    out = None
    for index in item_blocks(items, item_id, size):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            kinds = pa.array(index.ids).type
            for b in batches:
                data, offsets = text_buffer(b.column("text"))
                for i, j in chunks(offsets):
                    hits = index.search(data, offsets[i : j + 1], percent)
                    n = [len(index.sets[h[1]]) for h in hits]
                    cols = [b.column("doc_id").take(pa.array([i + h[0] for h in hits], pa.int64())), pa.array([index.ids[h[1]] for h in hits], kinds), pa.array(n, pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[2] / x for h, x in zip(hits, n)], pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that contain an item; no shuffle, all columns pass."""
    for index in item_blocks(items, item_id, size):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = text_buffer(b.column("text"))
                keep = np.ones(b.num_rows, bool)
                for i, j in chunks(offsets):
                    for h in shared.value.search(data, offsets[i : j + 1], percent):
                        keep[i + h[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
