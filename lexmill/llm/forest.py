"""The LSH forest: sorted orders of MinHash signatures and their neighbours by longest common prefix.

Each of the trees is one sorted order: nodes sorted by that tree's own run of `LONGEST` MinHash values. A tree is never
built; it is read off the order, as nodes that share a prefix stand side by side. All orders lie in one table that is
dealt out over ranges of (tree, values, node), so a prefix that very many nodes share spreads over many tasks, and each
task reads its range as a sorted stream and holds one pending row. Ends of ranges (two rows a range) meet in a second,
small stream.

1. A node's candidates are the `NEAREST` of its neighbours in all orders with the longest common prefix, of `LEAST`
   values or more.
2. Nodes that share a prefix of `LEAST` values are a region. In regions that still hold several components the depth
   adapts (`linking.settle`): a region of up to `SMALL` members is compared at that depth, a larger one is cut by
   ever longer prefixes until its parts are small; parts that stay crowded at the longest prefix meet in blocks.

Two sets at the bound p share no region of depth d in any of t trees with a chance of (1 - p**d)**t.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64
from .linking import Linker
from .shingles import functions, signatures

#: Values of the least prefix of neighbours and of the longest, which fill one and two 64-bit numbers.
LEAST, LONGEST = 4, 8
#: Neighbours of a node that the first round compares; the second makes up for the others.
NEAREST = 3
_ORDER = ["tree", "hi", "lo", "node"]
_SCHEMA = "tree int, hi long, lo long, node long, n int, before long, before_n int, shared int, edge int"


def short_values(sets: list[np.ndarray], muls: np.ndarray) -> np.ndarray:
    """(rows, functions): 16 mixed bits of each MinHash value."""
    return (mix64(signatures(sets, muls).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def sketches(sets: list[np.ndarray], muls: np.ndarray) -> list[bytes | None]:
    """Signatures as bytes; null for an empty set."""
    return [x.tobytes() if len(s) else None for x, s in zip(short_values(sets, muls), sets)]


def _rows(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), -1)


def labels(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures (rows, trees, LONGEST): the first and the second half of each tree's values as numbers that sort like them."""
    wide = sig.astype(np.uint64)
    pack = lambda x: (x[..., 0] << np.uint64(48)) | (x[..., 1] << np.uint64(32)) | (x[..., 2] << np.uint64(16)) | x[..., 3]
    return pack(wide[..., :LEAST]).view(np.int64), pack(wide[..., LEAST:]).view(np.int64)


def _equal_values(x: np.ndarray) -> np.ndarray:
    """Leading 16-bit values that two numbers share, of their exclusive or."""
    x = x.view(np.uint64)
    return sum((x >> np.uint64(s) == 0).astype(np.int32) for s in (48, 32, 16, 0))


def shared_prefix(tree: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Values that each row shares with the row before it; 0 for the first row and across trees."""
    out = np.zeros(len(tree), np.int32)
    a = _equal_values(hi[1:] ^ hi[:-1])
    out[1:] = np.where(tree[1:] == tree[:-1], np.where(a == LEAST, LEAST + _equal_values(lo[1:] ^ lo[:-1]), a), 0)
    return out


def orders(nodes: DataFrame, trees: int) -> DataFrame:
    """(tree, hi, lo, node, n): every node in every tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            hi, lo = labels(_rows(b.column("sig")).reshape(b.num_rows, trees, LONGEST))
            at = pa.array(np.repeat(np.arange(b.num_rows), trees))
            tree = pa.array(np.tile(np.arange(trees, dtype=np.int32), b.num_rows))
            yield pa.RecordBatch.from_arrays([tree, pa.array(hi.ravel()), pa.array(lo.ravel()), b.column("node").take(at), b.column("n").cast(pa.int32()).take(at)], [*_ORDER, "n"])

    return nodes.select("node", "n", "sig").mapInArrow(run, "tree int, hi long, lo long, node long, n int")


def _neighbours(ordered: DataFrame) -> DataFrame:
    """Rows that share LEAST values or more with the row before or after them, with the row before and the length of
    the prefix shared with it. The first and the last row of a range are passed on in any case (edge 1 and 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, as arrays of one: tree, hi, lo, node, n, before, before_n, shared, edge
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        batch = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        for b in batches:
            if not b.num_rows:
                continue
            row = [b.column(c).to_numpy() for c in (*_ORDER, "n")]
            start = 0 if held is None else 1
            if start:
                row = [np.concatenate([h, x]) for h, x in zip(held, row)]
            tree, hi, lo, node, n = row
            before, before_n = np.concatenate([node[:1], node[:-1]]), np.concatenate([n[:1], n[:-1]])
            shared, edge = shared_prefix(tree, hi, lo), np.zeros(len(node), np.int32)
            if start:
                before[0], before_n[0], shared[0], edge[0] = (x[0] for x in held[5:])
            else:
                edge[0] = 1
            show = (shared >= LEAST) | (edge > 0)
            show[:-1] |= shared[1:] >= LEAST
            cols = (tree, hi, lo, node, n, before, before_n, shared, edge)
            held = tuple(c[-1:] for c in cols)
            yield batch([c[:-1][show[:-1]] for c in cols])
        if held is not None:
            held[-1][0] |= 2
            yield batch(held)

    return ordered.mapInArrow(run, _SCHEMA)


class Forest:
    """The forest of nodes (node, n, sig): sig holds trees * LONGEST values as `sketches` makes them with `functions`."""

    def __init__(self, nodes: DataFrame, read_sets: Callable[[DataFrame], DataFrame], percent: int, trees: int):
        self.nodes, self.trees = nodes, trees
        p = percent / 100
        #: Share of equal values from which a pair is confirmed on its sets: five standard deviations under the bound.
        self.least_equal = p - 5 * (p * (1 - p) / (trees * LONGEST)) ** 0.5
        self.linker = Linker(percent, read_sets=read_sets, screen=self.alike)

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures agree enough."""
        least = self.least_equal
        sig = self.nodes.select("node", "sig")
        both = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sb"}), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if x.num_rows:
                    x = x.filter(pa.array((_rows(x.column("sa")) == _rows(x.column("sb"))).mean(1) >= least))
                yield x.select(["a", "b"])

        return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")

    def neighbours(self) -> tuple[DataFrame, DataFrame]:
        """(rows of regions, pairs (a, b, shared) of rows that stand side by side)."""
        dealt = orders(self.nodes, self.trees).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
        near = cut(_neighbours(dealt))
        # two rows a range at most: what stands at the end of one and the start of the next
        ends = near.filter("edge > 0").select(*_ORDER, "n").repartition(1).sortWithinPartitions(*_ORDER)
        close = near.unionByName(_neighbours(ends)).filter(f"shared >= {LEAST} and {self.linker.fits('n', 'before_n')}")
        return near, close.select(F.col("before").alias("a"), F.col("node").alias("b"), "shared")

    def run(self) -> DataFrame:
        """(node, component) of the nodes that have a link; component is the smallest node that can be reached."""
        near, close = self.neighbours()
        each = close.select("a", "b", "shared").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")).groupBy("a", "b").agg(F.max("shared").alias("s"))
        best = each.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "b"))), 1, NEAREST).alias("l"))
        pairs = best.select("a", F.explode("l.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        self.linker.confirm(pairs)
        members = near.select(F.xxhash64("tree", "hi").alias("region"), "tree", "node", "n", "lo")
        finer = [lambda rows, d=d: rows.withColumn("region", F.xxhash64("region", F.shiftrightunsigned("lo", 16 * (LONGEST - d)))) for d in range(LEAST + 1, LONGEST + 1)]
        muls = functions(self.trees * LONGEST)
        signature = lambda sets: short_values(sets, muls).reshape(len(sets), -1, LONGEST)
        return self.linker.settle(members, finer, self.trees, signature, self.least_equal)
