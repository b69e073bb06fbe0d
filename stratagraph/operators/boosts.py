"""Contextual boosts and the final rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..params import RankingConfig
from ..storage import running


def boosted(tags: DataFrame, file_ranks: DataFrame, symbol_ranks: DataFrame | None = None, git: DataFrame | None = None, callers: DataFrame | None = None, focus: DataFrame | None = None, chat: list[str] = (), files: list[str] = (), idents: list[str] = (), temporal: list[str] = (), config: RankingConfig = RankingConfig()) -> DataFrame:
    """Definitions (file, name, line) with their rank.

    The base is the symbol's rank, else its file's, else 0. Mentioned identifiers and files, chat files, temporal mates and
    focus multiply it; so do the file's git weight and, damped for hubs, its callers' weight (1 where unknown). References never
    come out. file_ranks(file, rank), symbol_ranks(file, name, rank), git(file, w), callers(file, w), focus(file, name, w).
    """
    d = tags.filter("kind = 'def'").join(file_ranks.select("file", F.col("rank").alias("file_rank")), "file", "left")
    none = F.lit(None).cast("double")
    d = d.join(symbol_ranks.select("file", "name", F.col("rank").alias("symbol_rank")), ["file", "name"], "left") if symbol_ranks is not None else d.withColumn("symbol_rank", none)
    for df, name, on in ((git, "git_w", ["file"]), (callers, "caller_w", ["file"]), (focus, "focus_w", ["file", "name"])):
        d = d.join(df.select(*on, F.col("w").alias(name)), on, "left") if df is not None else d.withColumn(name, none)
    flag = lambda c, values, b: F.when(F.col(c).isin(*values), b).otherwise(1.0) if values else F.lit(1.0)
    boost = flag("name", idents, config.boost_ident) * flag("file", files, config.boost_file) * flag("file", chat, config.boost_chat) * flag("file", temporal, config.boost_temporal)
    boost = boost * F.when(F.col("focus_w") > 0, config.boost_focus * F.col("focus_w")).otherwise(1.0)
    caller = F.greatest(F.lit(0.01), 1 + (F.coalesce("caller_w", F.lit(1.0)) - 1) * config.boost_caller * (1 - config.hub_damping))
    base = F.coalesce("symbol_rank", "file_rank", F.lit(0.0))
    return d.withColumn("rank", base * boost * F.coalesce("git_w", F.lit(1.0)) * caller).drop("file_rank", "symbol_rank", "git_w", "caller_w", "focus_w")


def file_order(ranked: DataFrame) -> DataFrame:
    """(file, best, symbols, place): files by their best rank."""
    f = ranked.groupBy("file").agg(F.max("rank").alias("best"), F.count("*").alias("symbols"))
    return running(f, [F.desc("best"), "file"], name="place").withColumn("place", F.col("place") + 1)


def first_by_name(ranked: DataFrame) -> DataFrame:
    """The best row of each name in a file."""
    w = Window.partitionBy("file", "name").orderBy(F.desc("rank"), "line")
    return ranked.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
