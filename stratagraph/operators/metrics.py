"""Ranking metrics, correlations and their aggregates. ranking(case, pos, item), pos from 1; truth(case, item, relevance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import materialise, running

METRICS = ["ndcg", "ndcg_5", "p_at_k", "p_at_5", "r_at_k", "r_at_5", "mrr", "ap"]


def _gain(at: str, n: int) -> Column:
    return F.sum(F.when(F.col(at) <= n, F.col("relevance") / F.log2(F.col(at) + 1)))


def ideal(truth: DataFrame, k: int = 10, fewer: int = 5, relevant: float = 0.0) -> DataFrame:
    """(case, idcg, idcg_5, relevant): what the best order of the truth gains."""
    t = truth.filter("relevance > 0").withColumn("rn", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("relevance"), "item")))
    return t.groupBy("case").agg(_gain("rn", k).alias("idcg"), _gain("rn", fewer).alias("idcg_5"), F.count_if(F.col("relevance") >= relevant).alias("relevant"))


def graded(ranked: DataFrame, best: DataFrame, by: list[str] = (), k: int = 10, fewer: int = 5, relevant: float = 0.0) -> DataFrame:
    """``evaluate`` of rankings(by..., case, pos, relevance) whose items have their relevance, against ``ideal``; cases that best alone
    has are left out."""
    group = [*by, "case"]
    hit = ((F.col("relevance") > 0) & (F.col("relevance") >= relevant)).cast("int")
    hits = ranked.withColumn("hit", F.coalesce(hit, F.lit(0)))
    hits = hits.withColumn("found", F.sum("hit").over(Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    top = lambda n: F.sum(F.when(F.col("pos") <= n, F.col("hit")))
    got = hits.groupBy(*group).agg(
        _gain("pos", k).alias("dcg"), _gain("pos", fewer).alias("dcg_5"), top(k).alias("top_hits"), top(fewer).alias("top_5"), F.count("*").alias("length"),
        F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first"), F.sum(F.when(F.col("hit") == 1, F.col("found") / F.col("pos"))).alias("precisions"),
    )
    return _parts(best.join(got, "case", "right"), group, k, fewer)


def _parts(both: DataFrame, group: list[str], k: int, fewer: int) -> DataFrame:
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))
    return both.select(
        *group, part("dcg", F.col("idcg")).alias("ndcg"), part("dcg_5", F.col("idcg_5")).alias("ndcg_5"), part("top_hits", F.least(F.lit(k), F.col("length"))).alias("p_at_k"),
        part("top_5", F.least(F.lit(fewer), F.col("length"))).alias("p_at_5"), part("top_hits", F.col("relevant")).alias("r_at_k"), part("top_5", F.col("relevant")).alias("r_at_5"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), part("precisions", F.col("relevant")).alias("ap"),
    )


def evaluate(ranking: DataFrame, truth: DataFrame, k: int = 10, fewer: int = 5, relevant: float = 0.0) -> DataFrame:
    """(case, ndcg, ndcg_5, p_at_k, p_at_5, r_at_k, r_at_5, mrr, ap), over the first k and, for the columns named 5, fewer items. Gains
    are relevances, discounted by log2(pos + 1), against the best order of the truth. Items of relevance 0, or less than asked for,
    are not relevant. Precision divides by the least of k and the ranking's length (0 for an empty one); the average precision by
    all relevant items. Cases come from either table."""
    t = truth.filter("relevance > 0")
    ranked = ranking.join(t.select("case", "item", "relevance"), ["case", "item"], "left")
    best = ideal(t, k, fewer, relevant)
    only = best.join(ranking.select("case").distinct(), "case", "left_anti")
    zeros = only.select("case", *(F.lit(0.0).alias(m) for m in METRICS))
    return graded(ranked, best, (), k, fewer, relevant).unionByName(zeros)


def weighted_mean(metrics: DataFrame, weight: str = "weight", by: list[str] = ()) -> DataFrame:
    """Means by weight; 0 where all weights are 0."""
    return metrics.groupBy(*by).agg(*(F.coalesce(F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(weight)), F.lit(0.0)).alias(m) for m in METRICS))


def summary(metrics: DataFrame) -> DataFrame:
    """Means, and sample deviations (0 below two cases)."""
    return metrics.agg(*(F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in METRICS), *(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"sd_{m}") for m in METRICS))


def population_variance(value: Column) -> Column:
    return F.coalesce(F.var_pop(value), F.lit(0.0))


def less(df: DataFrame, value: str) -> DataFrame:
    """df with less and same: how many rows have a smaller value, and the same one. Values are counted before they are put in order."""
    counts = df.groupBy(value).agg(F.count("*").alias("same"))
    counts = running(counts, [value], "same", "less").withColumnRenamed(value, "__value")
    return df.join(counts, F.col(value).eqNullSafe(F.col("__value"))).drop("__value")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the ascending rank of a value, from 1; equal values share their mean rank."""
    return less(df, value).withColumn(name, F.col("less") + (F.col("same") + 1) / 2).drop("less", "same")


def spearman(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row (n, rho) over the keys that both have; a and b hold a column value; null keys match. 0 below two keys."""
    match = None
    for k in on:
        match = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) if match is None else match & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    both = a.alias("l").join(b.alias("r"), match).select(F.col("l.value").alias("x"), F.col("r.value").alias("y"))
    both = average_rank(average_rank(materialise(both, "both"), "x", "rx"), "y", "ry")
    s = both.agg(F.count("*").alias("n"), F.sum(F.pow(F.col("rx") - F.col("ry"), F.lit(2))).alias("d"))
    n = F.col("n").cast("double")
    return s.select("n", F.when(F.col("n") < 2, 0.0).otherwise(1 - F.try_divide(6 * F.col("d"), n * (n * n - 1))).alias("rho"))


def percentile(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """df with the share of rows that have a smaller value."""
    total = df.agg(F.count("*").alias("__all"))
    return less(df, value).crossJoin(F.broadcast(total)).withColumn(name, F.col("less") / F.col("__all")).drop("less", "same", "__all")


def failures(metrics: DataFrame, threshold: float = 0.5, cases: int = 50, most: int = 10) -> DataFrame:
    """Of the first cases, those below the threshold: a report of limited length."""
    first = metrics.orderBy("case").limit(cases)
    return first.filter(F.col("ndcg") < threshold).orderBy("case").limit(most)


def explained(failed: DataFrame, ranking: DataFrame, truth: DataFrame, shown: int = 5) -> DataFrame:
    """The failed cases with the first items that were expected, by relevance, and those that came first instead."""
    cases = F.broadcast(failed.select("case"))  # a report of limited length
    want = truth.filter("relevance > 0").join(cases, "case").groupBy("case").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "item"))), 1, shown).alias("e"))
    came = ranking.filter(F.col("pos") <= shown).join(cases, "case").groupBy("case").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("a"))
    items = lambda c: F.coalesce(F.transform(c, lambda x: x["item"]), F.array())
    return failed.join(want, "case", "left").join(came, "case", "left").withColumns({"expected": items("e"), "actual": items("a")}).drop("e", "a")
