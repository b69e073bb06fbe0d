"""Commit history: file statistics, co-change, cases of training data, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, scores, text
from ..params import RankingConfig
from ..storage import materialise


def _micros(t: Column) -> Column:
    """Seconds are not cut to whole ones before they are compared."""
    return F.unix_micros(t.cast("timestamp"))


def file_stats(commit_files: DataFrame, now) -> DataFrame:
    """(file, last_modified_days, first_seen_days, commit_count, authors) of commit_files(sha, author, ts, file); whole days to now."""
    days = lambda t: F.floor((_micros(now) - _micros(t)) / 86_400_000_000)
    return commit_files.groupBy("file").agg(days(F.max("ts")).alias("last_modified_days"), days(F.min("ts")).alias("first_seen_days"), F.count("*").alias("commit_count"), F.countDistinct("author").alias("authors"))


def weighted_stats(stats: DataFrame, config: RankingConfig = RankingConfig()) -> DataFrame:
    """File statistics with recency, churn, their product, phase and badges."""
    s = stats.withColumn("recency", scores.recency(F.col("last_modified_days"), config)).withColumn("churn", scores.churn(F.col("commit_count"), config))
    s = s.withColumn("weight", F.col("recency") * F.col("churn")).withColumn("phase", scores.phase(F.col("last_modified_days"), F.col("first_seen_days"), F.col("commit_count"), config))
    return s.withColumn("badges", scores.badges(F.col("last_modified_days"), F.col("commit_count"), F.col("phase"), config))


def together(commit_files: DataFrame, most_files: int | None = 20) -> DataFrame:
    """(a, b, both, na, nb, jaccard) of files a < b that share a commit(sha, file). Commits of more files than that are left out,
    so the self-join stays near linear."""
    rows = commit_files.select("sha", "file").distinct()
    if most_files is not None:
        rows = rows.join(rows.groupBy("sha").agg(F.count("*").alias("n")).filter(F.col("n") <= most_files).select("sha"), "sha", "left_semi")
    size = rows.groupBy("file").agg(F.count("*").alias("n"))
    pairs = rows.select("sha", F.col("file").alias("a")).join(rows.select("sha", F.col("file").alias("b")), "sha").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = pairs.join(size.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    return pairs.withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))


def temporal_mates(commit_files: DataFrame, least: float = 0.3, most_files: int | None = None) -> DataFrame:
    """(file, mate, jaccard, rn): in both directions, the most similar first."""
    p = together(commit_files, most_files).filter(F.col("jaccard") >= least)
    both = p.select(F.col("a").alias("file"), F.col("b").alias("mate"), "jaccard").unionAll(p.select("b", "a", "jaccard"))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("jaccard"), "mate")))


def cases(commit_files: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """(sha, seed, related): each file of a commit of so many files with each other one."""
    rows = commit_files.select("sha", "file").distinct()
    fit = rows.groupBy("sha").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most)).select("sha")
    rows = rows.join(fit, "sha", "left_semi")
    return rows.select("sha", F.col("file").alias("seed")).join(rows.select("sha", F.col("file").alias("related")), "sha").filter("seed <> related")


def weighted_cases(case_rows: DataFrame, coupling: DataFrame, quality: DataFrame, unknown: float = 0.1) -> DataFrame:
    """(sha, seed, related, coupling, average, weight): a case's weight is its commit's quality times (0.5 + its mean coupling)."""
    known = coupling.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("jaccard").alias("coupling"))
    c = case_rows.withColumns({"x": F.least("seed", "related"), "y": F.greatest("seed", "related")}).join(known, ["x", "y"], "left").drop("x", "y")
    c = c.withColumn("coupling", F.coalesce("coupling", F.lit(unknown)))
    c = c.withColumn("average", F.avg("coupling").over(Window.partitionBy("sha", "seed")))
    return c.join(quality.select("sha", "quality"), "sha").withColumn("weight", F.col("quality") * (0.5 + F.col("average")))


def commit_quality(commits: DataFrame) -> DataFrame:
    """(sha, intent, quality) of commits(sha, message, files)."""
    f = F.col("files")
    n = lambda x: F.size(F.coalesce(x, F.array().cast("array<string>")))
    return commits.select("sha", text.intent(F.col("message")).alias("intent"), text.commit_quality(F.col("message"), n(f), n(F.array_distinct(F.transform(f, paths.parent))), n(F.filter(f, paths.is_source))).alias("quality"))


def sessions(rows: DataFrame, key: str, at: str, gap_seconds: int = 1800) -> DataFrame:
    """rows with session, counted from 0 in each key: a gap of more than so many seconds begins one."""
    w = Window.partitionBy(key).orderBy(at)
    gap = _micros(F.col(at)) - _micros(F.lag(at).over(w))
    return rows.withColumn("__new", F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0)).withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def couplings(files: DataFrame, least: float = 0.5) -> DataFrame:
    """(test, source, confidence) of files(path): tests and the files that bear their stem and are no tests themselves."""
    f = materialise(files.select("path"), "files")  # else Spark tests stems before it makes paths distinct
    f = f.select("path", paths.tested_stem(F.col("path")).alias("t"), paths.stem(F.col("path")).alias("own"), paths.extension(F.col("path")).alias("ext"))
    tests = f.filter("t IS NOT NULL").select(F.col("path").alias("test"), F.col("t.stem").alias("stem"), F.col("t.confidence").alias("base"))
    sources = f.filter("t IS NULL").select(F.col("path").alias("source"), F.col("own").alias("stem"))
    pairs = tests.join(sources, "stem")
    return pairs.select("test", "source", paths.proximity(F.col("test"), F.col("source"), F.col("base")).alias("confidence")).filter(F.col("confidence") >= least)
