"""Commit logs as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

FORMAT = "%H%x1f%an%x1f%ae%x1f%aI%x1f%at%x1f%s"


def read_log(repo: str, most: int = 500, paths: list[str] = (), all_refs: bool = False) -> str:
    """The text of git log with a header line and file names for each commit."""
    command = ["git", "-C", repo, "log", f"--max-count={most}", f"--pretty=format:{FORMAT}", "--name-only", *(["--all"] if all_refs else []), *(["--", *paths] if paths else [])]
    return subprocess.run(command, capture_output=True, text=True, check=True).stdout


def parse_log(lines: DataFrame) -> DataFrame:
    """(sha, author, ts, message, files) of lines(n, value), the numbered lines of such a text; blank lines mean nothing.

    A file belongs to the last header above it. A commit without files has an empty array.
    """
    parts = F.split("value", "\x1f")
    header = F.when(F.size(parts) >= 6, F.struct(parts[0].alias("sha"), parts[2].alias("author"), F.timestamp_seconds(parts[4].cast("bigint")).alias("ts"), parts[5].alias("message")))
    rows = lines.filter("trim(value) <> ''").withColumn("header", header)
    rows = rows.withColumn("own", F.last("header", ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("own IS NOT NULL")
    return rows.groupBy("own").agg(F.collect_set(F.when(F.col("header").isNull(), F.col("value"))).alias("files"), F.min("n").alias("n")).select("own.sha", "own.author", "own.ts", "own.message", F.sort_array("files").alias("files"))


def commits(spark: SparkSession, repo: str, **how) -> DataFrame:
    text = read_log(repo, **how)
    return parse_log(spark.createDataFrame(list(enumerate(text.split("\n"))), "n bigint, value string"))


def commit_files(commits: DataFrame) -> DataFrame:
    """(sha, author, ts, file)."""
    return commits.select("sha", "author", "ts", F.explode("files").alias("file"))


def iso_timestamp(text):
    """A timestamp of ISO-8601 text with its zone; null of any other."""
    return F.try_to_timestamp(text)
