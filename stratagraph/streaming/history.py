"""File statistics and sessions over streams of commits: the batch operators' definitions, kept up as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def running_stats(commit_files: DataFrame, late: str = "7 days") -> DataFrame:
    """(file, first, last, commit_count) of a stream of (sha, author, ts, file); use output mode update or complete."""
    return commit_files.withWatermark("ts", late).groupBy("file").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("commit_count"))


def closed_sessions(rows: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, last, n) of sessions that the watermark has closed; a gap equal to the limit begins a session."""
    s = F.session_window(at, gap)
    return rows.withWatermark(at, late).groupBy(s.alias("w"), key).agg(F.count("*").alias("n"), F.max(at).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")
