"""TF-IDF, cosine and Naive-Bayes features as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tfidf(docs: DataFrame, id_col: str, terms: Column, min_df: int, max_df_ratio: float, max_features: int) -> DataFrame:
    """(id, term, weight): (1 + ln tf) * idf, L2-normalized; idf = ln((1 + n) / (1 + df)) + 1.

    Terms are kept by document frequency, then the first max_features by idf * ln(1 + cf), ties by term. The vocabulary
    is bounded by max_features, so its join needs no shuffle of its side.
    """
    n = F.broadcast(docs.agg(F.count("*").alias("n_docs")))
    tf = docs.select(id_col, F.explode(terms).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).join(n).filter((F.col("df") >= min_df) & (F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n_docs") * max_df_ratio))))
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    vocabulary = stats.select("term", idf.alias("idf"), (idf * F.log1p("cf")).alias("r")).orderBy(F.round("r", 9).desc(), "term").limit(max_features).select("term", "idf")
    raw = tf.join(vocabulary, "term").select(id_col, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Vectors of a block that is held against another, and weights of one part of a block's dense form.
BLOCK, DENSE = 8000, 1 << 22


def cosine_pairs(vectors: DataFrame, id_col: str, least: float) -> DataFrame:
    """(a, b, cosine) of sparse normalized vectors that share a term, at or over a bound above 0, exactly.

    Each pair of blocks of vectors is multiplied in one task: the work is that of all pairs, but no pair is moved, and a
    vector is moved once a block. Single precision only picks, with room for its error; products are summed anew in double.
    """
    import numpy as np
    import pyarrow as pa

    from ..sources.shared import cut
    from .similar import placed

    packed = cut(vectors.groupBy(F.col(id_col).alias("member")).agg(F.collect_list(F.xxhash64("term")).alias("t"), F.collect_list("weight").alias("w")))

    def run(t: pa.Table) -> pa.Table:
        ids, k = t["member"].to_numpy(), t["k"].to_numpy()
        term, weight = (t[c].combine_chunks() for c in ("t", "w"))
        n = np.diff(term.offsets.to_numpy()) if isinstance(term, pa.Array) else np.array([len(x) for x in t["t"].to_pylist()])
        weight = weight.flatten().to_numpy()
        vocabulary, place = np.unique(term.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(ids)), n)
        order = np.argsort(k, kind="stable")
        one = t["i"][0].as_py() == t["j"][0].as_py()
        left, right = (order, order) if one else (order[k[order] == t["i"][0].as_py()], order[k[order] == t["j"][0].as_py()])
        step = max(1, DENSE // max(1, len(vocabulary)))

        def dense(rows: np.ndarray, kind: type) -> np.ndarray:
            m = np.zeros((len(rows), len(vocabulary)), kind)
            at = np.full(len(ids), -1)
            at[rows] = np.arange(len(rows))
            own = at[row] >= 0
            m[at[row[own]], place[own]] = weight[own]
            return m

        out: list = []
        for x in range(0, len(left), step):
            p = dense(left[x : x + step], np.float32)
            for y in range(x if one else 0, len(right), step):
                q = dense(right[y : y + step], np.float32)
                u, v = np.nonzero(p @ q.T >= least - 1e-4)
                u, v = left[x + u], right[y + v]
                if one:
                    u, v = u[keep := (u != v) & ((x != y) | (ids[u] < ids[v]))], v[keep]
                for f, g in zip(u, v):
                    a, b = slice(ends[f] - n[f], ends[f]), slice(ends[g] - n[g], ends[g])
                    _, i, j = np.intersect1d(place[a], place[b], assume_unique=True, return_indices=True)
                    out.append((min(ids[f], ids[g]), max(ids[f], ids[g]), float(weight[a][i] @ weight[b][j])))
        cols = list(zip(*out)) or [[]] * 3
        return pa.table({"a": pa.array([int(i) for i in cols[0]], pa.int64()), "b": pa.array([int(i) for i in cols[1]], pa.int64()), "c": pa.array(cols[2], pa.float64())})

    members = packed.select(F.lit(0).cast("long").alias("leader"), "member", F.lit(1).alias("n"))
    found = placed(members, BLOCK, BLOCK).join(packed, "member").withColumn("member", F.col("member").cast("long")).groupBy("leader", "i", "j").applyInArrow(run, "a long, b long, c double")
    return found.filter(F.round("c", 6) >= least).select("a", "b", F.round("c", 6).alias("cosine"))


def naive_bayes(examples: DataFrame, id_col: str, label_col: str, features: Column) -> DataFrame:
    """(feature, pos, neg): document frequencies of a feature among positive and negative examples."""
    f = examples.select(id_col, label_col, F.explode(F.array_distinct(features)).alias("feature"))
    count = lambda v: F.sum((F.col(label_col) == v).cast("long"))
    return f.groupBy("feature").agg(count(1).alias("pos"), count(0).alias("neg"))


def naive_bayes_scores(docs: DataFrame, id_col: str, features: Column, model: DataFrame, totals: DataFrame) -> DataFrame:
    """(id, probability): 12 times the mean log-ratio of the features in the vocabulary, plus the prior, through a sigmoid.

    totals is one row (p, n): documents of either label. A text without a known feature has the prior alone.
    """
    p, n = F.col("p"), F.col("n")
    rate = F.log((F.col("pos") + 0.01 * p) / (p * 1.02)) - F.log((F.col("neg") + 0.01 * n) / (n * 1.02))
    rates = model.join(F.broadcast(totals)).select("feature", rate.alias("rate"))
    known = docs.select(id_col, F.explode(F.array_distinct(features)).alias("feature")).join(rates, "feature").groupBy(id_col).agg(F.avg("rate").alias("evidence"))
    logit = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.log(p / n) + 12 * F.coalesce("evidence", F.lit(0.0))))
    return docs.select(id_col).join(known, id_col, "left").join(F.broadcast(totals)).select(id_col, (1 / (1 + F.exp(-logit))).alias("probability"))


def decision_cascade(rows: DataFrame, p1: Column, p2: Column, flags: Column, length: Column, attachment: Column) -> DataFrame:
    """primary, second and judge decisions of each row, from two probabilities and the policy flags."""
    none = length == 0
    primary = F.when(none, "rejected").when(attachment, "borderline").when((p1 >= 0.72) & (F.size(flags) == 0), "eligible").when((p1 < 0.18) & ((F.size(flags) > 0) | (length < 180)), "rejected").otherwise("borderline")
    second = F.when(none | (p2 < 0.16), "rejected").when((p2 >= 0.67) & ~attachment, "eligible").otherwise("uncertain")
    mean = (p1 + p2) / 2
    rows = rows.withColumn("primary", primary).withColumn("second", second)
    judge = F.when(none | (attachment & (length < 120)), "reject").when((mean >= 0.52) & (F.col("second") != "rejected"), "accept").when((mean <= 0.30) & (F.col("second") == "rejected"), "reject").otherwise("quarantine")
    final = F.when(F.col("primary") == "eligible", "accept").when(F.col("primary") == "rejected", "reject").otherwise(judge)
    return rows.withColumn("final", final)


def top_terms(vectors: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k heaviest terms of each vector: a report of fixed length."""
    w = Window.partitionBy(id_col).orderBy(F.round("weight", 6).desc(), "term")
    return vectors.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(id_col, "rank", "term", F.round("weight", 6).alias("weight"))
