"""Secret scans with corpus-wide ownership frequency.

Candidates are found in whole texts by fixed patterns. Each candidate value is hashed and counted over the corpus by
distinct repositories and owners: a value that many owners hold is a copied example, one that few hold is specific to
its owner and looks live. Base candidates are always reported; bare tokens without a telling context are reported
(kind `owned`) only where the corpus shows them to be owner-specific.

Null text counts as empty. Empty tables give empty results. Repeated rows are scanned one by one and count once a
repository. A null owner or repository counts as a value of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .linking import in_filter

KINDS = ("assign", "access", "hex", "owned")
#: Patterns fixed by the contract.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Bare tokens that may be credentials: letters and digits mixed, 20 or more characters.
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile(r"[0-9]")
#: Bits a character from which a bare token looks random.
MIN_ENTROPY = 3.0
#: A value held by more owners than this is a copied example.
MAX_OWNERS = 2

SPAN = "array<struct<start:int,kind:int,end:int,value:binary>>"


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in map(token.count, set(token)))


def candidates(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, hash of the value), sorted by start, then kind. Offsets are code points, ends exclusive."""
    if not text:
        return []
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if DIGIT.search(text) or HEX.search(text):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
        taken = sorted((s, e) for s, _, e, _ in found)
        begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for m in BARE.finditer(text):
            # the only spans that can overlap are those that begin before its end; of these the one that reaches farthest
            k = bisect_left(begins, m.end())
            if entropy(m[0]) >= MIN_ENTROPY and not (k and reach[k - 1] > m.start()):
                found.append((m.start(), 3, m.end(), m[0]))
    return sorted((s, k, e, hashlib.blake2b(v.encode(), digest_size=16).digest()) for s, k, e, v in found)


def scan(docs: DataFrame, owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, a digest of the text, owner, repo and the candidates of each row; one pass over the texts, no shuffle."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))
        names = ["row_id", "doc_id", "text_key", "owner", "repo"]
        for b in batches:
            found = [[dict(zip(("start", "kind", "end", "value"), x)) for x in candidates(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, kind)], [*names, "found"])

    marked = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.unhex(F.sha2("text", 256)).alias("text_key"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"),
        F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in repo_cols]).alias("repo"), "text",
    )
    return marked.mapInArrow(spans, f"row_id long, doc_id {dict(docs.dtypes)['doc_id']}, text_key binary, owner string, repo string, found {SPAN}")


def ownership(scanned: DataFrame) -> DataFrame:
    """value, n_repos, n_owners over the corpus. A value's rows are reduced to its repositories before the counts."""
    held = scanned.select("owner", "repo", F.explode("found.value").alias("value")).distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def classified(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id, text_key and the reported spans (start, kind, end, n_repos, n_owners, specific), one row a row of docs."""
    scanned = cut(scan(docs))
    own = ownership(scanned)
    one = scanned.select("row_id", F.explode("found").alias("s")).select("row_id", "s.*")
    verdict = one.join(own, "value").withColumn("specific", F.col("n_owners") <= max_owners).filter((F.col("kind") < 3) | F.col("specific"))
    spans = verdict.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_repos", "n_owners", "specific"))).alias("spans"))
    return scanned.select("row_id", "doc_id", "text_key").join(spans, "row_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,n_repos:bigint,n_owners:bigint,specific:boolean>>")))


def report(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """The contract's digest of `classified`."""
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda f: F.size(F.filter("spans", f)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return classified(docs, max_owners).select(
        "doc_id", *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        count(lambda s: s["specific"]).alias("n_owner_specific"), count(lambda s: ~s["specific"]).alias("n_copied"),
    )


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with each span, or union of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", max_owners: int = MAX_OWNERS) -> DataFrame:
    """docs with every reported span of the text replaced by a mark; all columns pass, n_chars follows the text.

    Spans follow from a text and the verdicts on its values, so rows find theirs by doc_id and text: rows with a null
    doc_id, or of one doc_id with different texts, are masked each at its own places. Texts are moved to their spans only
    where a bit filter does not tell that they have none.
    """
    hit = cut(classified(docs, max_owners).filter(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")).dropDuplicates(["d", "t"]))
    marked = in_filter(hit.select(F.xxhash64("d", "t").alias("node")))(F.xxhash64("id", "key"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.unhex(F.sha2("text", 256)).alias("key"))
    # a sort-merge join, whose exchange parts the filter from the masking: in one task they would hold two Python workers
    both = packed.filter(marked).join(hit.hint("merge"), F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t")), "left").select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], "spans")
    docs_columns, width = docs.columns, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, t = b.column(width), docs_columns.index("text")
            b = b.select(range(width)).rename_columns(docs_columns)
            if spans.null_count < len(spans):
                texts = [x if s is None or x is None else masked(x, [(y["start"], y["end"]) for y in s], mark) for x, s in zip(b.column(t).to_pylist(), spans.to_pylist())]
                b = b.set_column(t, b.schema.field(t), pa.array(texts, b.schema.field(t).type))
                if (n := b.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(b.schema.field(n).type):
                    b = b.set_column(n, b.schema.field(n), pa.array([c if s is None or x is None else len(x) for c, x, s in zip(b.column(n).to_pylist(), texts, spans.to_pylist())], b.schema.field(n).type))
            yield b

    return packed.filter(~marked).select("row.*").union(both.mapInArrow(run, docs.schema))
