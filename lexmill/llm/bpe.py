"""BPE encoding and decoding with a contiguous rank array.

A short word is held as an array of part boundaries and an array of the ranks of adjacent parts. The lowest rank is
found by a scan, its boundary is deleted, and the ranks beside it are refreshed, until no pair has a rank. Words recur,
so each Python worker keeps the ids of words it has met in a table of bounded size.

The vocabulary is a public tokenizer file (JSON) whose path is a parameter; it is read on the driver and sent to the
workers, as it has a fixed size. Null text counts as empty and has no tokens. Rows are encoded one by one, repeated ones
too; a doc_id of any type passes unchanged; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as the vocabulary's own patterns mean it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = regex.compile(f"[^{WHITE}]+")
#: Words kept by a worker, half of them as the newer and half as the older generation; an older one in use becomes a newer.
MAX_WORDS = 240_000
NO_RANK = 1 << 30
#: From this many parts on, a word is merged by linked positions and a heap, so that a very long word costs n log n.
LONG_WORD = 256


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file with word ends and lower-casing."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.piece = regex.compile(split.replace(r"\s", WHITE))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Ids of the parts after all merges: lowest rank first, leftmost among equals."""
        get = self.ranks.get
        if len(parts) >= LONG_WORD:
            return self._merge_long(parts)
        none = (NO_RANK, -1)
        ranks = [get(x, none) for x in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low[0] == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = low[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        import heapq

        get, n = self.ranks.get, len(parts)
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r[0], i, parts[i], parts[i + 1], r[1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], dead[j] = new, True
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (r := get((parts[left], parts[right]))):
                    heapq.heappush(heap, (r[0], left, parts[left], parts[right], r[1]))
        return [p for p, x in zip(parts, dead) if not x]

    def word(self, piece: str) -> list[int]:
        letters = [self.letters[b] for b in piece.encode()]
        letters[-1] += self.suffix
        whole = self.vocab.get("".join(letters)) if len(letters) == 1 else None
        return [whole] if whole is not None else self.merge([self.vocab[x] for x in letters])

    def _chunk(self, chunk: str) -> bytes:
        """Ids, as bytes, of a run without white space."""
        out = self.older.get(chunk)
        if out is None:
            out = np.array([i for p in self.piece.findall(chunk) for i in self.word(p)], dtype="<u4").tobytes()
        if 2 * len(self.words) >= MAX_WORDS:
            self.words, self.older = {}, self.words
        if len(chunk) <= 64:
            self.words[chunk] = out
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        at = 0
        for m in self.at_special.finditer(text) if "<|" in text else ():
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def _plain(self, text: str) -> bytes:
        # lower-casing goes letter by letter, without the rule for a sigma at a word's end
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        known = self.words.get
        return b"".join([x if (x := known(c)) is not None else self._chunk(c) for c in CHUNK.findall(low)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: tokens are joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_built: dict[str, WordBpe] = {}


def tokenizer(spec: str) -> WordBpe:
    """One tokenizer a Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _built:
        _built[key] = WordBpe(spec)
    return _built[key]


def encode_docs(docs: DataFrame, path: str, ids: bool = False, forget: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, with `ids` (array<int>) and `decoded` where asked for.
    With `forget` a task leaves no word tables behind in its worker, which other operators may get next."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if ids else [])]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec.value)
        for b in batches:
            rows = []
            for text in b.column("text"):
                raw = t.encode_bytes(text.as_py())
                got = np.frombuffer(raw, "<u4").tolist()
                back = t.decode(got)
                rows.append((len(got), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), *((got, back) if ids else ())))
            cols = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(cols, kinds))], ["doc_id", *(n for n, _ in kinds)])
        if forget:
            t.words, t.older = {}, {}

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids)
