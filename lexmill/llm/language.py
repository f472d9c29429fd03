"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter keeps its maximum over a window, and a
softmax layer reads these maxima. A text is cut into windows of fixed length, all of which are read in batches; the
probabilities of its windows are averaged by their logarithms.

The network is fitted on the driver from at most `PER_LANGUAGE` rows a language value (a documented bound; the rows of
least hash), of each of which some windows are taken. Language, source and doc_id are never inputs of a prediction.

A null text, or one without a letter, is `und` with score 0. Without labelled rows every text is. Languages are the
values that labelled rows have; rows without one are not learned from. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, least_hashed
from .shingles import chunks, text_buffer

PER_LANGUAGE = 1_000
WINDOWS_EACH = 2
FOLDS, HELD_OUT = 4, 2
LENGTH = 192
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4, 5), 12
EPOCHS, BATCH, RATE = 5, 64, 0.004
#: A superset of the letters: numbers written as signs (², ½, Ⅷ) are word characters too, so each is asked for itself.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


class ByteCnn:
    """Embedding, convolutions of several widths with rectified maxima, and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        # one matrix for all widths: a filter of width w has zeros beyond its first w bytes
        self.span = max(WIDTHS)
        self.mask = np.repeat(np.concatenate([np.repeat([[float(k < w)] for k in range(self.span)], FILTERS, 1) for w in WIDTHS], 1), EMBED, 0).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)), "conv": rng.normal(0, (2 / (self.span * EMBED)) ** 0.5, (self.span * EMBED, n)) * self.mask,
            "shift": np.zeros(n), "out": rng.normal(0, 0.1, (n, len(languages))), "base": np.zeros(len(languages)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, span * EMBED) of (windows, LENGTH) bytes; what lies behind a window's end is zero."""
        e = np.zeros((len(x), LENGTH + self.span - 1, EMBED), np.float32)
        e[:, :LENGTH] = self.p["embed"][x]
        s = e.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (len(x), LENGTH, self.span * EMBED), (s[0], s[1], s[2])))

    def _pooled(self, x: np.ndarray):
        cols = self._columns(x)
        act = (cols.reshape(-1, cols.shape[2]) @ self.p["conv"]).reshape(len(x), LENGTH, -1)
        return cols, act, np.maximum(act.max(1) + self.p["shift"], 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self._pooled(x)[2] @ self.p["out"] + self.p["base"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 13) -> "ByteCnn":
        """Cross entropy with Adam; the gradient of a maximum goes to its place alone."""
        rng = np.random.default_rng(seed)
        m, v, t = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for b in range(0, len(y), BATCH):
                take = order[b : b + BATCH]
                xb = x[take]
                cols, act, pooled = self._pooled(xb)
                z = pooled @ self.p["out"] + self.p["base"]
                z -= z.max(1, keepdims=True)
                prob = np.exp(z)
                prob /= prob.sum(1, keepdims=True)
                prob[np.arange(len(take)), y[take]] -= 1
                dz = (prob / len(take)).astype(np.float32)
                dpool = (dz @ self.p["out"].T) * (pooled > 0)
                at = act.argmax(1)  # (windows, filters)
                chosen = np.take_along_axis(cols, at[:, :, None], 1)  # (windows, filters, span * EMBED)
                dconv = np.einsum("bf,bfk->kf", dpool, chosen, optimize=True) * self.mask
                back = dpool[:, :, None] * self.p["conv"].T[None]  # (windows, filters, span * EMBED)
                place = at[:, :, None] + np.arange(self.span)
                inside = place < LENGTH
                letters = np.where(inside, xb[np.arange(len(xb))[:, None, None], np.minimum(place, LENGTH - 1)], 0).ravel()
                each = back.reshape(-1, EMBED) * inside.reshape(-1, 1)
                dembed = np.stack([np.bincount(letters, each[:, k], 256) for k in range(EMBED)], 1)
                grads = {"embed": dembed, "conv": dconv, "shift": dpool.sum(0), "out": pooled.T @ dz, "base": dz.sum(0)}
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, LENGTH) bytes of all rows, zero-filled at a row's end, and the row of each; an empty row has none."""
    size = np.diff(offsets)
    counts = -(-size // LENGTH)
    rows = np.repeat(np.arange(len(size)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][rows] + nth * LENGTH
    place = start[:, None] + np.arange(LENGTH)
    x = data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else np.zeros((0, LENGTH), np.uint8)
    return np.where(place < offsets[1:][rows][:, None], x, 0).astype(np.uint8), rows


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteCnn:
    """Fit on some windows of at most `per_language` rows of each language that are not held out; only windows reach the driver."""
    labelled = docs.filter("lang is not null and text is not null").filter(F.coalesce(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            out = []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                count = max(1, -(-(hi - lo) // LENGTH))
                out.append([bytes(data[lo + k * LENGTH : min(hi, lo + (k + 1) * LENGTH)]) for k in sorted({(count * w) // WINDOWS_EACH for w in range(WINDOWS_EACH)})])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rank"), pa.array(out, pa.list_(pa.binary()))], ["lang", "rank", "windows"])

    picked = least_hashed(labelled.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", per_language, "lang")
    rows = picked.mapInArrow(run, "lang string, rank int, windows array<binary>").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    names = sorted(set(rows["lang"].to_pylist()))
    x, y = [], []
    for lang, windows in zip(rows["lang"].to_pylist(), rows["windows"].to_pylist()):
        for w in windows:
            if w.strip():
                x.append(np.frombuffer(w.ljust(LENGTH, b"\0"), np.uint8))
                y.append(names.index(lang))
    model = ByteCnn(names)
    return model.fit(np.array(x), np.array(y)) if x else model


def predict(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            langs: list[str] = []
            scores: list[float] = []
            for i, j in chunks(offsets, 1 << 18):
                x, rows = cut_windows(data, offsets[i : j + 1])
                total, n = np.zeros((j - i, len(model.languages))), np.bincount(rows, minlength=j - i)
                for k in range(0, len(x), 512) if model.languages else ():
                    part = model.log_probabilities(x[k : k + 512])
                    for c in range(part.shape[1]):
                        total[:, c] += np.bincount(rows[k : k + 512], part[:, c], j - i)
                mean = np.exp(total / np.maximum(n, 1)[:, None])
                mean /= np.maximum(mean.sum(1, keepdims=True), 1e-12)
                for t, p in zip(b.column("text").slice(i, j - i), mean):
                    known = bool(model.languages) and (s := t.as_py()) is not None and has_letter(s)
                    langs.append(model.languages[int(p.argmax())] if known else "und")
                    scores.append(float(p.max()) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
