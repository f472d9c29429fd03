"""Choices over small tables: balanced positions, orders, artifacts and gates. What works on the driver here is bounded by
its meaning (samples of an experiment, conditions of a report)."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_sample


def coverage_picks(rows: DataFrame, key: str, seed: str, selectors: dict[str, Column], total: int) -> DataFrame:
    """One row by hash for each selector, none twice, then more by hash up to a total; `reason` says why a row is in."""
    out = None
    for name, holds in selectors.items():
        left = rows.filter(holds)
        if out is not None:
            left = left.join(out.select(key), key, "left_anti")
        got = hash_sample(left, key, f"{seed}|{name}", 1).withColumn("reason", F.lit(name))
        out = got if out is None else out.unionByName(got)
    rest = rows if out is None else rows.join(out.select(key), key, "left_anti")
    have = 0 if out is None else out.count()
    more = hash_sample(rest, key, f"{seed}|fill", max(0, total - have)).withColumn("reason", F.lit("fill"))
    return more if out is None else out.unionByName(more)


def balanced_positions(samples: dict[str, list[str]], seed: str, rounds: int = 12) -> dict[str, tuple[str, ...]]:
    """An order of each sample's conditions such that every condition stands equally often at every position: greedy by
    the least sum of squared counts, ties by hash, then rounds of single improvements."""
    count: dict[tuple[str, int], int] = {}
    out: dict[str, tuple[str, ...]] = {}

    def cost(order: tuple[str, ...]) -> int:
        return sum(2 * count.get((c, i), 0) + 1 for i, c in enumerate(order))

    def put(order: tuple[str, ...], by: int) -> None:
        for i, c in enumerate(order):
            count[c, i] = count.get((c, i), 0) + by

    def best(s: str) -> tuple[str, ...]:
        return min(itertools.permutations(sorted(samples[s])), key=lambda o: (cost(o), hashlib.sha256(f"{seed}|{s}|{'|'.join(o)}".encode()).hexdigest()))

    for s in sorted(samples):
        out[s] = best(s)
        put(out[s], 1)
    for _ in range(rounds):
        changed = False
        for s in sorted(samples):
            put(out[s], -1)
            new = best(s)
            changed |= cost(new) < cost(out[s])
            out[s] = new if cost(new) < cost(out[s]) else out[s]
            put(out[s], 1)
        if not changed:
            break
    return out


def apart(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(id, condition) reordered so that equal conditions are not neighbours where another is left; order is kept else."""
    left, out = list(items), []
    while left:
        i = next((k for k, x in enumerate(left) if not out or x[1] != out[-1][1]), 0)
        out.append(left.pop(i))
    return out


def resolve_artifact(candidates: dict[str, set[str]], wanted: set[str]) -> str:
    """The one shortest path whose ids cover the wanted ones; none or several is an error."""
    fit = sorted((len(p), p) for p, ids in candidates.items() if wanted <= ids)
    if not fit or len(fit) > 1 and fit[0][0] == fit[1][0]:
        raise ValueError("no artifact covers the ids" if not fit else f"ambiguous artifacts: {fit[0][1]}, {fit[1][1]}")
    return fit[0][1]


def sweet_spot(frontier: list[str]) -> str:
    """The only condition of a frontier, or that it doesn't decide."""
    return frontier[0] if len(frontier) == 1 else "INCONCLUSIVE"


def matrix_errors(experiments: dict[str, dict], pairs: list[tuple[str, str]], ignored: set[str]) -> list[str]:
    """Pairs of experiments that differ in other than one field."""
    diff: Callable[[dict, dict], set[str]] = lambda a, b: {k for k in (a.keys() | b.keys()) - ignored if a.get(k) != b.get(k)}
    return [f"{a}:{b}:{','.join(sorted(d))}" for a, b in pairs if len(d := diff(experiments[a], experiments[b])) != 1]


def guards(config: dict) -> list[str]:
    """Reasons against a launch."""
    out = [f"missing_{k}" for k in ("model", "dataset", "seed", "cutoff") if config.get(k) in (None, "")]
    if config.get("split") == "test":
        out.append("test_split_in_training")
    if config.get("authorized") is not True:
        out.append("not_authorized")
    return out


def final_gate(audited: DataFrame) -> DataFrame:
    """One row: rates over the survivors of an audit (columns state, verdict, signature) and whether they pass: nothing
    blocking, at most 2 % major, no core error twice, no technical failure."""
    s = audited.filter("state <> 'dropped'")
    counts = s.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "BLOCKING").alias("blocking"), F.count_if(F.col("verdict") == "MAJOR").alias("major"), F.count_if(F.col("verdict").isNull()).alias("technical"))
    repeats = s.filter("signature is not null").groupBy("signature").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("most_repeated"))
    ok = (F.col("blocking") == 0) & (F.col("major") <= 0.02 * F.col("n")) & (F.col("technical") == 0) & (F.col("most_repeated") < 2)
    return counts.join(F.broadcast(repeats)).withColumn("passed", ok)
