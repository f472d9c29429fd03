"""Word and shingle hashes of whole texts, in numpy over Arrow buffers.

Words are runs of bytes other than white space, with A-Z lower-cased. A word's hash is a polynomial over random 64-bit
values of its bytes, taken from prefix sums, and mixed; a shingle's hash combines the hashes of its words. All are
64-bit, so that two different shingles of one pair of documents meet with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: The same where many hash functions run over each shingle, so that a worker's arrays stay small.
SMALL_CHUNK_BYTES = 1 << 18
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MULS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. Those of up to CHUNK_BYTES are kept for the next call; a longer text's are
    made anew, so that it leaves nothing behind in its worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        # as many as the chunks in use need, in steps
        size = next((s for s in (SMALL_CHUNK_BYTES, CHUNK_BYTES) if n <= s), n)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.cumprod(out, out=out)
        if size <= CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold up to `limit` bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word in bytes of data; bounds: the words of row i are bounds[i]:bounds[i + 1])."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    n = len(part)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[part]
    edges = np.zeros(n + 1, bool)  # a word begins or goes on: rows end words too
    cutat = np.zeros(n + 1, bool)
    cutat[offsets - lo] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cutat[1:n]
    edges[1:n] = inside[:-1] & (~inside[1:] | cutat[1:n])
    edges[n] = inside[-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(edges)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[part] * powers(_BASE, n), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * powers(_BACK, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts + lo, ends + lo, np.searchsorted(starts, offsets - lo)


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _MULS[k]
    return mix64(out)


def sequence_hash(hashes: np.ndarray) -> int:
    """A hash of a whole sequence of words, for texts shorter than a shingle."""
    out = 0x1234567
    for h in hashes.tolist():
        out = (out * 0x2545F4914F6CDD1D + h + 1) % 2**64
    return int(mix64(np.array([out ^ len(hashes)], np.uint64))[0])


def shingle_lists(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in order of place, with repeats, and their bounds; a text of fewer words has one, an empty text none."""
    hashes, _, _, bounds = words(data, offsets)
    rolled = combine(hashes, size)
    counts = np.diff(bounds)
    if not len(counts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    out = [rolled[b : b + c - size + 1] if c >= size else np.array([sequence_hash(hashes[b : b + c])] * (c > 0), np.uint64) for b, c in zip(bounds.tolist(), counts.tolist())]
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum([len(x) for x in out], out=at[1:])
    return np.concatenate(out), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    flat, at = shingle_lists(data, offsets, size)
    return [np.unique(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def functions(count: int, seed: int = 1) -> np.ndarray:
    """Odd multipliers of `count` multiply-shift hash functions on mixed shingle hashes."""
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], muls: np.ndarray) -> np.ndarray:
    """(rows, functions) of uint32: the least hash of each set under each function; all ones for an empty set."""
    out = np.full((len(sets), len(muls)), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        buf = np.empty_like(flat)
        for k, m in enumerate(muls):
            np.multiply(flat, m, out=buf)
            out[full, k] = (np.minimum.reduceat(buf, at) >> np.uint64(32)).astype(np.uint32)
    return out
