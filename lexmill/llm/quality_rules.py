"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document; the ledger keeps one failure bit a rule and the measurements behind it.
A policy is a versioned mask over those bits, so that verdicts of any policy, and what each rule alone costs
(ablations), come from bitwise operations on the ledger without reading a text again.

Null text counts as a text without words. A text without words fails `few_words`. Repeated rows are judged one by one.
Extra columns pass through `rule_ledger` only where named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Words of a window whose repetition counts.
WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"

#: Rule names; the position is the bit.
RULES = (
    "few_words",  # under 20 words
    "repeated_windows",  # over 30 % of the words lie in repeated 8-word windows
    "symbols",  # over 3 symbols in 10 words
    "repeated_lines",  # over half of four or more lines repeat an earlier line
    "shouting",  # over 6 in 10 letters are capitals, in 20 words or more
    "exclamations",  # over 3 exclamation marks in 10 words
    "long_words",  # over 15 characters a word on average
    "short_words",  # under 2 characters a word on average
    "stutter",  # over 3 in 10 words equal the word before
)
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version: the rules whose failure rejects.
POLICIES = {"base": BASE_MASK, "v1": BASE_MASK | BIT["symbols"] | BIT["repeated_lines"], "v2": (1 << len(RULES)) - 1}
POLICY = "v2"


def _words(text: Column) -> Column:
    return let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def _covered(starts: Column) -> Column:
    """Words under windows that start at these sorted positions."""
    steps = F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def _repeat_words(words: Column) -> Column:
    """Words in windows found twice or more. Distinct hashes prove that no window repeats; else windows are compared as texts."""
    last = F.size(words) - WINDOW
    at = lambda i: F.slice(words, i + 1, F.lit(WINDOW))

    def exact(hashes: Column) -> Column:
        keyed = F.zip_with(hashes, F.sequence(F.lit(0), last), lambda h, i: F.struct(h.alias("h"), F.array_join(at(i), " ").alias("k"), i.alias("i")))
        same = lambda a, b: (a["h"] == b["h"]) & (a["k"] == b["k"])
        ends = lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), F.coalesce(same(a, b), F.lit(False)).alias("eq")))
        hits = lambda p: F.flatten(F.transform(F.filter(p, lambda x: x["eq"]), lambda x: F.array(x["i"], x["j"])))
        return let(let(F.array_sort(keyed), lambda s: F.array_sort(F.array_distinct(hits(ends(s))))), _covered)

    hashed = let(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(at(i))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(h)))
    return F.when(last >= 1, hashed).otherwise(F.lit(0).cast("long"))


def _count(text: Column, pattern: str) -> Column:
    """Characters of a class."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def rule_ledger(docs: DataFrame, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Measurements and failure bits (`fail_bits`) of each document; no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    stutter = lambda w: F.size(F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b), lambda x: x))
    of_words = let(
        _words(text),
        lambda w: F.struct(stutter(w).cast("long").alias("n_stutter"), F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    measured = docs.select(
        *[F.col(c) for c in keep],
        of_words.alias("_w"),
        of_lines.alias("_l"),
        _count(text, r"[#*$%&|<>]").alias("n_symbols"),
        _count(text, "!").alias("n_exclamations"),
        _count(text, "[A-ZÀ-ÖØ-Þ]").alias("n_capitals"),
        (F.length(text).cast("long") - _count(text, "[^A-Za-zÀ-ÖØ-öø-ÿ]")).alias("n_letters"),
    ).select(*keep, "_w.*", "_l.*", "n_symbols", "n_exclamations", "n_capitals", "n_letters")
    n, c = F.col("n_words"), F.col
    fails = {
        "few_words": n < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * n,
        "symbols": 10 * c("n_symbols") > 3 * n,
        "repeated_lines": (c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines")),
        "shouting": (n >= 20) & (10 * c("n_capitals") > 6 * c("n_letters")),
        "exclamations": 10 * c("n_exclamations") > 3 * n,
        "long_words": c("word_chars") > 15 * n,
        "short_words": c("word_chars") < 2 * n,
        "stutter": 10 * c("n_stutter") > 3 * n,
    }
    bits = sum((F.when(fails[r], F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def failed(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0


def apply_policy(ledger: DataFrame, policy: str = POLICY) -> DataFrame:
    """`base_failed` and `kept` under a policy; the base rules always reject."""
    return ledger.withColumn("base_failed", failed(BASE_MASK)).withColumn("kept", ~failed(POLICIES[policy] | BASE_MASK))


def ablation(ledger: DataFrame, policy: str = POLICY) -> DataFrame:
    """One row a rule: documents that fail it, that fail it alone, and that the policy keeps with the rule left out. One pass, partial aggregation."""
    mask = POLICIES[policy]
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask))
    sums = [F.count("*").alias("n_docs"), F.sum((bits == 0).cast("long")).alias("n_kept")]
    for r in RULES:
        own = F.lit(BIT[r])
        sums += [
            F.sum((F.col("fail_bits").bitwiseAND(own) != 0).cast("long")).alias(f"{r}_failed"),
            F.sum((bits == own).cast("long")).alias(f"{r}_alone"),
            F.sum((bits.bitwiseAND(F.lit(mask & ~BIT[r])) == 0).cast("long")).alias(f"{r}_without"),
        ]
    row = ledger.agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(f"{r}_failed"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"{r}_alone"), F.lit(0)).alias("n_alone"), F.coalesce(F.col(f"{r}_without"), F.lit(0)).alias("n_kept_without")) for r in RULES]))
    return row.select("n_docs", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), each.alias("x")).select("x.*", "n_docs", "n_kept")


def passing(docs: DataFrame, policy: str = POLICY, text_col: str = "text") -> DataFrame:
    """docs without the rows that a policy rejects; all columns pass, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return apply_policy(rule_ledger(docs.select(row, F.col(text_col).alias("_text")), "_text", ("_row",)), policy).filter("kept").select("_row.*")
