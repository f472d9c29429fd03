"""Text-overlap metrics, and aggregates of judged scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import metric_tokens


def gram_counts(pairs: DataFrame, id_col: str, text_col: str, n: int, name: str) -> DataFrame:
    """(id, gram, count) of token n-grams."""
    tokens = metric_tokens(F.col(text_col))
    grams = F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))), 1)
    return pairs.select(id_col, F.explode(grams).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias(name))


def overlap_counts(pairs: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, matched, in_prediction, in_reference): clipped n-gram matches and totals of each pair."""
    p, r = gram_counts(pairs, id_col, "prediction", n, "cp"), gram_counts(pairs, id_col, "reference", n, "cr")
    both = p.join(r, [id_col, "gram"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.groupBy(id_col).agg(F.sum(F.least(zero(F.col("cp")), zero(F.col("cr")))).alias("matched"), F.sum(zero(F.col("cp"))).alias("in_prediction"), F.sum(zero(F.col("cr"))).alias("in_reference"))


def bleu4(pairs: DataFrame, id_col: str) -> DataFrame:
    """One row: corpus BLEU of four orders, each with one added to matches and totals, and the brevity penalty."""
    parts = [overlap_counts(pairs, id_col, n).agg(F.coalesce(F.sum("matched"), F.lit(0)).alias(f"m{n}"), F.coalesce(F.sum("in_prediction"), F.lit(0)).alias(f"t{n}")) for n in range(1, 5)]
    lengths = pairs.agg(F.sum(F.size(metric_tokens(F.col("prediction")))).cast("long").alias("prediction_length"), F.sum(F.size(metric_tokens(F.col("reference")))).cast("long").alias("reference_length"))
    row = lengths
    for p in parts:
        row = row.join(F.broadcast(p))  # one row each
    c, r = F.col("prediction_length"), F.col("reference_length")
    brevity = F.when(c == 0, F.lit(0.0)).when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    logs = sum((F.log((F.col(f"m{n}") + 1) / (F.col(f"t{n}") + 1)) for n in range(1, 5)), F.lit(0.0))
    return row.select(*[F.col(f"m{n}").cast("long").alias(f"m{n}") for n in range(1, 5)], *[F.col(f"t{n}").cast("long").alias(f"t{n}") for n in range(1, 5)], "prediction_length", "reference_length", F.round(brevity * F.exp(logs / 4), 6).alias("bleu4"))


def f1(matched: Column, a: Column, b: Column) -> Column:
    return F.when((matched == 0) | (a == 0) | (b == 0), F.lit(0.0)).otherwise(2.0 * matched / (a + b))


def rouge_n(pairs: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, rouge): F1 of clipped n-gram matches."""
    counts = overlap_counts(pairs, id_col, n)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pairs.select(id_col).join(counts, id_col, "left").select(id_col, f1(zero("matched"), zero("in_prediction"), zero("in_reference")).alias(f"rouge{n}"))


def release_adjusted(raw: Column, risks: Column, publishable: Column, unsupported: Column) -> Column:
    """A raw total under its cap, less three for each unsupported claim, at least 0."""
    cap = F.when(risks >= 2, 59).when(risks == 1, 69).when(~publishable, 79).otherwise(100)
    return F.greatest(F.lit(0), F.least(raw, cap) - 3 * unsupported)


def paired(judged: DataFrame, value: str) -> DataFrame:
    """(sample_id, condition, draft, final) of samples that have both stages."""
    side = lambda s: judged.filter(F.col("stage") == s).select("sample_id", "condition", F.col(value).alias(s))
    return side("draft").join(side("final"), ["sample_id", "condition"])


def paired_delta(judged: DataFrame, value: str) -> DataFrame:
    d = F.col("final") - F.col("draft")
    n = lambda c: F.sum(c.cast("long"))
    return paired(judged, value).groupBy("condition").agg(
        F.count("*").alias("n_pairs"), F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.percentile(d, F.lit(0.5)), 6).alias("median_delta"),
        n(d > 1e-12).alias("improved"), n(F.abs(d) <= 1e-12).alias("unchanged"), n(d < -1e-12).alias("worsened"),
    )


def publishability_transition(judged: DataFrame, triggered: Column) -> DataFrame:
    """Two-by-two transitions and their rates over the pairs whose revision was triggered; null where none was."""
    p = paired(judged, "publishable")
    n = lambda c: F.sum(c.cast("long"))
    a, b = F.col("draft"), F.col("final")
    t = p.groupBy("condition").agg(n(a & b).alias("kept"), n(~a & b).alias("rescued"), n(a & ~b).alias("harmed"), n(~a & ~b).alias("failed"), n(triggered).alias("triggered"))
    rate = lambda c: F.round(F.try_divide(F.col(c), F.col("triggered")), 6)
    return t.withColumn("rescue_efficiency", rate("rescued")).withColumn("harm_rate", rate("harmed"))


def pareto_frontier(rows: DataFrame, key: str, minimize: list[str], maximize: list[str], eps: float = 1e-12) -> DataFrame:
    """Rows of a table of conditions that no other row dominates. The table has one row a condition: a set that is small
    by meaning, broadcast only below Spark's own size bound."""
    o = rows.select(*[F.col(c).alias(f"o_{c}") for c in [key, *minimize, *maximize]])
    worse = [F.col(f"o_{c}") > F.col(c) + eps for c in minimize] + [F.col(f"o_{c}") < F.col(c) - eps for c in maximize]
    better = [F.col(f"o_{c}") < F.col(c) - eps for c in minimize] + [F.col(f"o_{c}") > F.col(c) + eps for c in maximize]
    any_ = lambda cs: __import__("functools").reduce(lambda x, y: x | y, cs)
    return rows.join(o, (F.col(f"o_{key}") != F.col(key)) & ~any_(worse) & any_(better), "left_anti")


def _stirling_rest(n: int) -> float:
    """ln n! less Stirling's (n + 1/2) ln n - n + ln(2 pi) / 2."""
    from math import lgamma, log, pi

    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n**2) / n**2) / n**2) / n**2) / n


def mcnemar(rescued: int, harmed: int) -> float:
    """Exact two-sided p of the discordant pairs.

    Up to 2,000 pairs in whole numbers. Beyond that the last term comes from Loader's expansion, true to some 1e-12 of
    itself, and the terms before it by their ratios until they no longer count, a few times the root of the pairs.
    """
    from math import comb, exp, log, log1p, pi, sqrt

    n, k = rescued + harmed, min(rescued, harmed)
    if n <= 2000:
        return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    if 2 * k == n:
        return 1.0
    if k == 0:
        return 2 * exp(-n * log(2))
    e = (n - 2 * k) / n  # how far k lies under the half
    away = n / 2 * ((log1p(-e) * (1 - e) + e) + (log1p(e) * (1 + e) - e))
    last = exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - away) * sqrt(n / (2 * pi * k * (n - k)))
    total = term = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < total * 1e-18:
            break
    return min(1.0, 2 * last * total)


def win_tie_loss(judged: DataFrame, value: str) -> DataFrame:
    """By condition: samples where its value is the only best, shares the best, or is under it."""
    best = judged.groupBy("sample_id").agg(F.max(value).alias("best"), F.count("*").alias("n"))
    at = judged.join(best, "sample_id").filter("n > 1")
    tops = at.filter(F.col(value) == F.col("best")).groupBy("sample_id").agg(F.count("*").alias("tops"))
    x = at.join(tops, "sample_id")
    n = lambda c: F.sum(c.cast("long"))
    top = F.col(value) == F.col("best")
    return x.groupBy("condition").agg(n(top & (F.col("tops") == 1)).alias("wins"), n(top & (F.col("tops") > 1)).alias("ties"), n(~top).alias("losses"))
