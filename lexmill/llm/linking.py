"""Links and components of near-equal sets, from candidate pairs and from regions of neighbours.

A region is a set of nodes that a hash structure holds together (a band, or a prefix of a sorted order). Its members
need not be compared in all pairs: links within one component tell nothing new. So a first round confirms a few
candidates a node, and `settle` looks only at regions that then hold several components: members outside the largest
component against members of other components. Small regions do that in a join; a larger one is cut finer while the
structure has more to say (`finer`), and what stays crowded meets in blocks inside tasks of bounded size, so no pair
that shares a region is passed over. States of regions are partial sums, made where the rows are: no task gathers the
rows of a region.

A link holds where 100 * intersection >= percent * union of the full sets. Sets are read again from the texts only for
nodes that a near pair names, told by a bit filter whose size follows the count of names up to `MAX_WORDS`; beyond
that more sets are made and dropped again by the exact join that follows, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..sources.shared import release
from .common import cut, mix64

#: Members up to which a region compares pairs in a join; members of a block beyond that.
SMALL, BLOCK = 48, 1024
#: Regions (four numbers each) up to which their states are sent to all workers; beyond that they are joined.
MAX_STATES = 200_000
#: Least and most words of 64 bits of a filter (8 kB to 32 MB), and bits a name.
MIN_WORDS, MAX_WORDS, NAME_BITS = 1 << 10, 1 << 22, 16


def set_key(s: np.ndarray) -> bytes | None:
    """A 128-bit key of a set of 64-bit hashes; null for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def common_count(u: np.ndarray, v: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(u) > len(v):
        u, v = v, u
    return int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()) if len(v) else 0


def bit_filter(wanted: DataFrame) -> np.ndarray:
    """Bits of the wanted nodes; its length follows their count."""
    count = wanted.count()
    size = min(MAX_WORDS, max(MIN_WORDS, 1 << (count * NAME_BITS // 64).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, bit = _bit_of(b.column("node").to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], ["w", "b"])

    words = wanted.select("node").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def _bit_of(nodes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(nodes.astype(np.int64).view(np.uint64))
    return ((h >> np.uint64(6)) % np.uint64(size)).astype(np.int64), h & np.uint64(63)


def may_hold(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """False only for nodes that are not in a filter made by `bit_filter`."""
    word, bit = _bit_of(nodes, len(bits))
    return (bits[word] >> bit) & np.uint64(1) > 0


def in_filter(wanted: DataFrame) -> Callable[[Column], Column]:
    """A test of names (no nulls) that is false only for names that are not among the nodes of `wanted`; other columns of
    a row stay in the JVM."""
    bits = wanted.sparkSession.sparkContext.broadcast(bit_filter(wanted))

    @F.arrow_udf("boolean")
    def held(node: pa.Array) -> pa.Array:
        return pa.array(may_hold(bits.value, node.to_numpy(zero_copy_only=False)))

    return held


class Linker:
    """Links of nodes whose full sets come from a table `sets` (node, hashes) or are read for the nodes that need them.

    `screen` drops pairs (a, b) that are surely no link; without it all pairs are held against the full sets.
    """

    def __init__(self, percent: int, sets: DataFrame | None = None, read_sets: Callable[[DataFrame], DataFrame] | None = None, screen: Callable[[DataFrame], DataFrame] | None = None):
        self.percent, self.sets, self.read_sets, self.screen = percent, sets, read_sets, screen
        self.links: DataFrame | None = None

    def fits(self, a: str, b: str) -> str:
        """Sizes that allow a link."""
        return f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})"

    def load(self, wanted: DataFrame) -> None:
        """Read the full sets of nodes that are not there yet."""
        if self.read_sets is None:
            return
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = cut(wanted)
        new = cut(self.read_sets(wanted).join(wanted, "node", "left_semi"))
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def confirm(self, pairs: DataFrame) -> None:
        """Add the pairs (a, b) whose full sets hold the bound to the links."""
        percent = self.percent
        if self.screen is not None:
            pairs = cut(self.screen(pairs))
        self.load(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(self.sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(self.sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                keep = []
                for ha, hb in zip(x.column("ha"), x.column("hb")):
                    u, v = (np.frombuffer(h.as_buffer(), np.uint64) for h in (ha, hb))
                    common = common_count(u, v)
                    keep.append(100 * common >= percent * (len(u) + len(v) - common))
                yield x.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        self.add(both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long"))

    def add(self, links: DataFrame) -> None:
        links = cut(links)
        self.links = links if self.links is None else self.links.unionByName(links)

    def apart(self, rows: DataFrame) -> DataFrame:
        """Rows of regions that hold several components, with m members, k of them outside of the largest component."""
        held = rows.groupBy("region", "comp").agg(F.count("*").alias("c"))
        state = held.groupBy("region").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("comps")).filter("comps > 1")
        state = cut(state.select("region", "m", (F.col("m") - F.col("top.c")).alias("k"), F.col("top.comp").alias("most")))
        found = cut(rows.join(F.broadcast(state) if state.count() <= MAX_STATES else state, "region").withColumn("outside", F.expr("comp <> most")).drop("most"))
        release(state)
        return found

    def settle(self, members: DataFrame, finer: list[Callable[[DataFrame], DataFrame]] = (), trees: int = 1, signature: Callable[[list[np.ndarray]], np.ndarray] | None = None, least_equal: float = 0.0) -> DataFrame:
        """(node, component) after comparing what is still apart in the regions of members (region, tree, node, n, ...).

        Each function of `finer` gives large regions' rows finer region keys. `signature` makes (rows, trees, depth)
        values of full sets for blocks of crowded regions.
        """
        found = cut(components(self.links))
        rows = cut(members.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
        pairs, crowded = None, None
        for step in [*finer, None]:
            mixed = self.apart(rows)
            if mixed.isEmpty():
                break
            small = mixed.filter(f"m <= {SMALL}")
            other = small.select("region", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "comp")])
            here = small.filter("outside").join(other, "region").filter(f"comp <> comp2 and {self.fits('n', 'n2')}").select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
            pairs = here if pairs is None else pairs.unionByName(here)
            large = mixed.filter(f"m > {SMALL}")
            if large.isEmpty():
                break
            if step is None:
                crowded = large
                break
            rows = step(large.drop("m", "k", "outside"))  # read from `mixed`, which stays
        if pairs is not None:
            pairs = cut(pairs.distinct())
            self.confirm(pairs)
            release(pairs)
        if crowded is not None:
            self.load(crowded.select("node").distinct())
            self.add(self.cross_blocks(crowded, trees, signature, least_equal))
        if pairs is None:
            return found
        release(found)
        return cut(components(self.links))

    def cross_blocks(self, large: DataFrame, trees: int, signature: Callable[[list[np.ndarray]], np.ndarray], least_equal: float) -> DataFrame:
        """Links (a, b) that join different components in crowded regions, confirmed on the full sets.

        A block of outsiders meets a block of members in a task of bounded size. A pair that shares crowded regions of
        several trees is looked at in the first of them only, and pairs that links found in the task have joined are
        passed over, so a task returns fewer links than it has nodes.
        """
        percent = self.percent

        def run(x: pd.DataFrame) -> pd.DataFrame:
            a, b = x[x.side == 0], x[x.side == 1]
            out: list[tuple[int, int]] = []
            if len(a) and len(b):
                tree = int(x.tree.iloc[0])
                own, sets = ([np.frombuffer(h, np.uint64) for h in s.hashes] for s in (a, b))
                left, right = signature(own), signature(sets)
                comps, place = np.unique(np.concatenate([a.comp, b.comp]), return_inverse=True)
                group = np.arange(len(comps))  # components of the task, merged as links are found
                ca, cb = place[: len(a)], place[len(a) :]
                nb, zb = b.node.to_numpy(), b.n.to_numpy()
                for node, n, c, s, u in zip(a.node, a.n, ca, left, own):
                    hit = np.flatnonzero((group[cb] != group[c]) & (100 * np.minimum(zb, n) >= percent * np.maximum(zb, n)))
                    equal = right[hit] == s
                    share = equal.mean((1, 2))
                    first = equal.all(2)[:, :tree].any(1)
                    order = np.flatnonzero((share >= least_equal) & ~first)
                    for i in hit[order[np.argsort(-share[order], kind="stable")]].tolist():
                        if group[cb[i]] == group[c]:
                            continue
                        common = common_count(u, sets[i])
                        if 100 * common >= percent * (len(u) + len(sets[i]) - common):
                            out.append((min(node, nb[i]), max(node, nb[i])))
                            group[group == group[cb[i]]] = group[c]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        blocks = lambda count: F.ceil(F.col(count) / F.lit(BLOCK)).cast("int")
        at = lambda count: F.pmod(F.xxhash64("node"), blocks(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), blocks(count) - 1))
        own = ("region", "tree", "node", "comp", "n", "side")
        outs = large.filter("outside").select("region", "tree", "node", "comp", "n", F.lit(0).alias("side"), "m", at("k").alias("i")).select(*own, "i", every("m").alias("j"))
        ins = large.select("region", "tree", "node", "comp", "n", F.lit(1).alias("side"), "k", at("m").alias("j")).select(*own, every("k").alias("i"), "j")
        rows = outs.unionByName(ins).join(self.sets.select("node", "hashes"), "node")
        return rows.groupBy("region", "i", "j").applyInPandas(run, "a long, b long")
