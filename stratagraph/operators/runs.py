"""Tables of training runs: series, movements, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def deltas(points: DataFrame, keys: list[str], order: str, names: list[str], least: float = 1e-6) -> DataFrame:
    """(keys, order, name, old, new, delta): what each parameter moves by from a step to the next."""
    long = points.unpivot([*keys, order], names, "name", "new")
    w = Window.partitionBy(*keys, "name").orderBy(order)
    d = long.withColumn("old", F.lag("new").over(w)).withColumn("delta", F.col("new") - F.col("old"))
    return d.filter(F.abs("delta") > least).select(*keys, order, "name", "old", "new", "delta")


def movement(moves: DataFrame, k: int = 5) -> DataFrame:
    """(name, total, moves): the k parameters that move most in all."""
    return moves.groupBy("name").agg(F.sum(F.abs("delta")).alias("total"), F.count("*").alias("moves")).orderBy(F.desc("total"), "name").limit(k)


def plateaus(series: DataFrame, key: str, order: str, value: str, n: int = 3, threshold: float = 0.01) -> DataFrame:
    """(key, steps, plateau, collapse): of the last n values, whether the last lies within the threshold of the first, or below it by
    more than that; false with fewer than n."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = series.withColumn("rn", F.row_number().over(w))
    a = last.groupBy(key).agg(F.count("*").alias("steps"), F.max(F.when(F.col("rn") == 1, F.col(value))).alias("end"), F.max(F.when(F.col("rn") == n, F.col(value))).alias("start"))
    enough, start, end = F.col("steps") >= n, F.col("start"), F.col("end")
    return a.select(key, "steps", F.coalesce(enough & (F.abs(end - start) < threshold), F.lit(False)).alias("plateau"), F.coalesce(enough & (end < start - threshold), F.lit(False)).alias("collapse"))


def oscillations(series: DataFrame, key: str, order: str, value: str, drop: float = 0.05) -> DataFrame:
    """(key, collapses, oscillations, final, variance, converged): falls beyond drop, changes of direction, and whether the series
    ends above 0.85 with a variance below 0.01."""
    w = Window.partitionBy(key).orderBy(order)
    s = series.withColumns({"before": F.lag(value).over(w), "after": F.lead(value).over(w), "rn": F.row_number().over(w.orderBy(F.desc(order)))})
    up, down = F.col(value) - F.col("before"), F.col("after") - F.col(value)
    a = s.groupBy(key).agg(F.count_if(-up > drop).alias("collapses"), F.count_if(up * down < 0).alias("oscillations"), F.max(F.when(F.col("rn") == 1, F.col(value))).alias("final"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("variance"))
    return a.withColumn("converged", (F.col("final") > 0.85) & (F.col("variance") < 0.01))


def trends(series: DataFrame, key: str, order: str, value: str, least: float = 0.01) -> DataFrame:
    """series with its trend against the value before: up, down or flat."""
    change = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return series.withColumn("trend", F.when(change > least, "up").when(change < -least, "down").otherwise("flat"))


def convergence(series: DataFrame, key: str, order: str, value: str, n: int = 3) -> DataFrame:
    """series with what the last n values up to each row say: spread, their mean squared distance from the latest, null with fewer
    than n; state: converged below 0.0001, stabilising below 0.001, else moving."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, Window.currentRow)
    last = F.collect_list(value).over(w)
    spread = F.when(F.size(last) == n, F.aggregate(last, F.lit(0.0), lambda a, x: a + F.pow(x - F.col(value), F.lit(2))) / n)
    s = series.withColumn("spread", spread)
    return s.withColumn("state", F.when(F.col("spread") < 0.0001, "converged").when(F.col("spread") < 0.001, "stabilising").otherwise("moving"))


def run_summary(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, first, last, best, worst, mean, sd, gain, gain_sd, plateau, trend)."""
    a = series.groupBy(key).agg(F.count("*").alias("n"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.max(value).alias("best"), F.min(value).alias("worst"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    gain = F.col("last") - F.col("first")
    sd = F.when(F.col("sd") > 1e-12, F.col("sd"))
    return a.withColumns({"gain": gain, "gain_sd": F.coalesce(gain / sd, F.lit(0.0)), "plateau": F.coalesce(F.abs(gain) / sd, F.lit(0.0)) < 0.5, "trend": F.when(gain > 0.01, "up").when(gain < -0.01, "down").otherwise("flat")})


def pivot(rows: DataFrame, items: str, step: str, k: int = 30, shown: int = 5) -> DataFrame:
    """(item, n, steps): the k items that occur in most rows, with the first steps of each."""
    each = rows.select(F.col(step).alias("step"), F.explode(items).alias("item"))
    return each.groupBy("item").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("step")), 1, shown).alias("steps")).orderBy(F.desc("n"), "item").limit(k)


def prompt_stats(episodes: DataFrame, prompt: str, step: str, value: str) -> DataFrame:
    return episodes.groupBy(prompt).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.max(value).alias("best"), F.min(value).alias("worst"), F.min(step).alias("first_step"), F.max(step).alias("last_step"))


def change_counts(changes: DataFrame, k: int = 10) -> DataFrame:
    """(change, n) of changes(name, direction): the k most frequent."""
    return changes.groupBy(F.concat_ws(":", "name", "direction").alias("change")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "change").limit(k)


def timing(calls: DataFrame, agent: str, seconds: str) -> DataFrame:
    """Total, mean, least and most of positive durations."""
    return calls.filter(F.col(seconds) > 0).groupBy(agent).agg(F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))


def diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): sections that are added, removed or changed."""
    b, a = before.select(key, F.col(content).alias("old")), after.select(key, F.col(content).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def pick(choices: DataFrame, key: str, runs: str, draw: float) -> DataFrame:
    """The choice that a draw in [0, 1) falls on when each weighs 1 / (runs + 1)."""
    c = choices.withColumn("w", 1 / (F.col(runs) + 1))
    c = c.withColumn("upto", F.sum("w").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))).crossJoin(F.broadcast(c.agg(F.sum("w").alias("all"))))
    return c.filter(F.col("upto") > F.col("all") * draw).orderBy(key).limit(1).select(key)
