"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The interactions of all pairs of features have low-rank weights and are summed in linear time:
sum over pairs <v_i, v_j> x_i x_j = ((sum v_i x_i)**2 - sum v_i**2 x_i**2) / 2, a rank at a time.

The model is fitted in numpy on the driver from at most `MAX_TRAIN` labelled rows (a documented bound; the rows of
least hash), whose features are taken on the executors. All rows are scored, over whole texts. Labels, language, source
and doc_id are never inputs of a score; the metadata is the length of the text.

Null text counts as empty: its features are those of a text without words, and it gets a score like any other. Without
labelled rows every score is 0.5. Rows repeated in labels count repeatedly; labels that are null are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, least_hashed
from .shingles import chunks, text_buffer, words

MAX_TRAIN = 12_000
BITS, RANK = 14, 6
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
EPOCHS, BATCH, RATE = 8, 64, 0.08
#: Mini-batches that a fit takes at least; few labelled rows are read more often.
MIN_STEPS = 400
L2 = 1e-4

#: Classes of bytes whose shares are structure statistics.
_CLASSES = {
    "symbols": b"#*$%&|<>", "marks": b"!?", "stops": b".,;:", "capitals": bytes(range(65, 91)), "digits": b"0123456789",
    "lines": b"\n", "quotes": b"\"'()[]{}", "wide": bytes(range(128, 256)),
}
STATISTICS = (*_CLASSES, "word_length", "distinct", "adjacent", "short_words", "long_words", "log_words", "log_chars", "line_words")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words of all rows, bounds of each row's, statistics of each row)."""
    hashes, starts, ends, bounds = words(data, offsets)
    n, lo = len(offsets) - 1, int(offsets[0])
    part = data[lo : int(offsets[-1])]
    counts = np.diff(bounds).astype(float)
    size = np.diff(offsets).astype(float)

    def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[at]).astype(float)

    stats = np.zeros((n, len(STATISTICS)))
    per = np.maximum(counts, 1)
    for k, (name, members) in enumerate(_CLASSES.items()):
        table = np.zeros(256, bool)
        table[list(members)] = True
        seen = per_row(table[part], offsets - lo)
        stats[:, k] = seen / (np.maximum(size, 1) if name in ("capitals", "digits", "wide") else per)
    k = len(_CLASSES)
    length = ends - starts
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
    key = np.unique((row << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS)))
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    stats[:, k] = per_row(length, bounds) / per
    stats[:, k + 1] = np.diff(at) / per
    stats[:, k + 2] = per_row(again, bounds) / per
    stats[:, k + 3] = per_row(length <= 1, bounds) / per
    stats[:, k + 4] = per_row(length > 15, bounds) / per
    stats[:, k + 5] = np.log1p(counts)
    stats[:, k + 6] = np.log1p(size)
    stats[:, k + 7] = np.log1p(counts / (stats[:, list(_CLASSES).index("lines")] * per + 1))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), at, stats


class FactorMachine:
    """Weights and rank-`RANK` factors of 2**BITS hashed words and the statistics."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = (1 << BITS) + len(STATISTICS)
        self.bias = 0.0
        self.weights = np.zeros(size)
        self.factors = rng.normal(0, 0.02, (size, RANK))
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
        self.fitted = False

    def _rows(self, index: np.ndarray, at: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: indexes and values of words, then of the statistics; and their bounds."""
        counts, m = np.diff(at), len(STATISTICS)
        to = np.arange(len(counts) + 1) * m + at
        idx, val = np.empty(to[-1], np.int64), np.empty(to[-1])
        own = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(index)) - at[:-1][own] + to[:-1][own]
        idx[place] = index
        val[place] = 1 / np.sqrt(np.maximum(counts, 1))[own]
        tail = (to[1:, None] - m + np.arange(m)).ravel()
        idx[tail] = np.tile((1 << BITS) + np.arange(m), len(counts))
        val[tail] = (np.clip((stats - self.mean) / self.scale, -4, 4) / 2).ravel()
        return idx, val, to

    def _margin(self, idx, val, to):
        v = self.factors[idx] * val[:, None]
        total = np.add.reduceat(v, to[:-1], axis=0)
        linear = np.add.reduceat(self.weights[idx] * val, to[:-1])
        return self.bias + linear + 0.5 * (total**2 - np.add.reduceat(v**2, to[:-1], axis=0)).sum(1), total, v

    def score(self, index: np.ndarray, at: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if not self.fitted or not len(stats):
            return np.full(len(stats), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._margin(*self._rows(index, at, stats))[0], -30, 30)))

    def fit(self, index: list[np.ndarray], stats: np.ndarray, y: np.ndarray, seed: int = 5) -> "FactorMachine":
        """Logistic loss, mini-batches, a step size of its own for each weight (AdaGrad)."""
        if not len(y):
            return self
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-6
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        gw, gv, gb = np.full(len(self.weights), 1e-6), np.full(self.factors.shape, 1e-6), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(y)))):
            order = rng.permutation(len(y))
            for b in range(0, len(y), BATCH):
                take = order[b : b + BATCH]
                at = np.concatenate([[0], np.cumsum([len(index[i]) for i in take])])
                idx, val, to = self._rows(np.concatenate([index[i] for i in take]), at, stats[take])
                margin, total, v = self._margin(idx, val, to)
                err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[take]) / len(take)
                own = np.repeat(np.arange(len(take)), np.diff(to))
                used, place = np.unique(idx, return_inverse=True)
                dw = np.bincount(place, err[own] * val, len(used)) + L2 * self.weights[used]
                each = (err[own] * val)[:, None] * (total[own] - v)
                dv = np.stack([np.bincount(place, each[:, k], len(used)) for k in range(RANK)], 1) + L2 * self.factors[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += err.sum() ** 2
                self.weights[used] -= RATE * dw / np.sqrt(gw[used])
                self.factors[used] -= RATE * 0.5 * dv / np.sqrt(gv[used])
                self.bias -= RATE * err.sum() / np.sqrt(gb)
        self.fitted = True
        return self


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorMachine:
    """Fit on the `max_train` labelled rows of least hash that are not held out; only their features reach the driver."""
    picked = labels.filter("quality is not null and doc_id is not null").filter(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    picked = least_hashed(picked, "_id", max_train).drop("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in chunks(offsets):
                index, at, stats = features(data, offsets[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(index, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(i, j - i).cast(pa.int64()), b.column("_y").slice(i, j - i), lists, pa.array(list(stats), pa.list_(pa.float64()))], ["id", "y", "index", "stats"])

    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")
    rows = joined.mapInArrow(run, "id long, y int, index array<int>, stats array<double>").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("y", "ascending")])
    y = rows["y"].to_numpy().astype(float)
    index = [np.asarray(x.values, np.int64) for x in rows["index"]]
    stats = np.array(rows["stats"].to_pylist(), float).reshape(len(y), len(STATISTICS))
    return FactorMachine().fit(index, stats, y)


def score(docs: DataFrame, model: FactorMachine) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            s = np.concatenate([shared.value.score(*features(data, offsets[i : j + 1])) for i, j in chunks(offsets)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
