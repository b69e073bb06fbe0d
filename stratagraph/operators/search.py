"""Parameter search and sensitivity, over tables of parameter points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scores
from ..params import PARAMETERS
from . import metrics


def parameters(spark: SparkSession) -> DataFrame:
    """(name, least, most, logarithmic, initial, neutral)."""
    return spark.createDataFrame([(k, *v) for k, v in PARAMETERS.items()], "name string, least double, most double, logarithmic boolean, initial double, neutral double")


def _decoded(name: str, x: Column) -> Column:
    least, most, logarithmic, _, _ = PARAMETERS[name]
    return scores.decode(x, F.lit(least), F.lit(most), F.lit(logarithmic))


def grid(spark: SparkSession, names: list[str], k: int) -> DataFrame:
    """(point, names...): all combinations of k values of each parameter, listed lazily: the point's digits to the base k."""
    points = spark.range(k ** len(names)).withColumnRenamed("id", "point")
    digit = lambda i: F.floor(F.col("point") / k**i) % k
    return points.select("point", *(_decoded(n, digit(i) / max(k - 1, 1)).alias(n) for i, n in enumerate(names)))


def latin_hypercube(spark: SparkSession, names: list[str], n: int, seed: int = 42) -> DataFrame:
    """(point, names...): each parameter takes each of n equal strata once; order and place in it are hashes of the point."""
    points = spark.range(n).withColumnRenamed("id", "point")
    for i, name in enumerate(names):
        stratum = F.row_number().over(Window.orderBy(scores.uniform(F.col("point"), seed + i), "point")) - 1
        points = points.withColumn(name, _decoded(name, (stratum + scores.uniform(F.col("point"), seed + 100 + i)) / n))
    return points


def random_points(spark: SparkSession, names: list[str], n: int, seed: int = 42) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "point").select("point", *(_decoded(name, scores.uniform(F.col("point"), seed + i)).alias(name) for i, name in enumerate(names)))


def distance(a: str, b: str, names: list[str]) -> Column:
    """Root mean square difference of encoded parameters of two structs."""
    enc = lambda s, n: scores.encode(F.col(f"{s}.{n}"), *(F.lit(v) for v in PARAMETERS[n][:3]))
    return F.sqrt(reduce(lambda x, y: x + y, [F.pow(enc(a, n) - enc(b, n), F.lit(2)) for n in names]) / len(names))


def next_sample(candidates: DataFrame, history: DataFrame, names: list[str]) -> DataFrame:
    """The candidate that lies furthest from the history (names..., score) plus 0.3 of its likeness to good points; with
    min_distance, similarity and acquisition of each. history is small and goes to every task."""
    c = candidates.select("point", F.struct(*names).alias("c"))
    h = history.select(F.struct(*names).alias("h"), "score")
    d = c.crossJoin(F.broadcast(h)).withColumn("d", distance("c", "h", names))
    s = d.groupBy("point").agg(F.min("d").alias("min_distance"), F.sum(F.col("score") / (1 + F.col("d"))).alias("near"), F.sum(1 / (1 + F.col("d"))).alias("norm"))
    s = s.withColumn("similarity", F.col("near") / F.col("norm"))
    return s.select("point", "min_distance", "similarity", (F.col("min_distance") + 0.3 * F.col("similarity")).alias("acquisition"))


def simulated_score(path: Column, coupling: Column, key: Column, p: dict[str, Column]) -> Column:
    """A file's score under a parameter point: coupling or a floor, depth, and hashed recency, churn and noise."""
    depth = F.regexp_count(path, F.lit("/"))
    mult = F.when(depth <= 2, p["depth_weight_root"]).when(depth <= 4, p["depth_weight_moderate"]).otherwise(p["depth_weight_deep"])
    real = coupling > 0
    base = F.when(real, coupling * mult).otherwise(0.05 * mult)
    u = lambda s: scores.uniform(key, s)
    recent = F.when(u(1) < F.when(real, 0.7).otherwise(0.2), 1 + (p["git_recency_max_boost"] - 1) * (1 - u(2) * 0.3)).otherwise(1.0)
    busy = F.when(u(3) < F.when(real, 0.4).otherwise(0.1), 1 + (p["git_churn_max_boost"] - 1) * 0.5).otherwise(1.0)
    return base * recent * busy * (0.85 + 0.3 * u(4))


def distractors(cases: DataFrame) -> DataFrame:
    """(case, item) of cases(case, n): three times n, but ten at least, synthetic paths of five patterns."""
    i = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(10), (3 * F.col("n")).cast("int")) - 1))
    d = cases.select("case", i.alias("i"))
    s = F.col("i").cast("string")
    path = F.when(F.col("i") % 5 == 0, F.concat(F.lit("src/distractor_"), s)).when(F.col("i") % 5 == 1, F.concat(F.lit("src/utils/helper_"), s)).when(F.col("i") % 5 == 2, F.concat(F.lit("src/core/internal/deep_"), s)).when(F.col("i") % 5 == 3, F.concat(F.lit("lib/mod_"), s)).otherwise(F.concat(F.lit("tests/test_"), s))
    return d.select("case", "i", F.concat(path, F.lit(".rs")).alias("item"))


#: Points that are sent to every task at most, and the relevance that counts.
MOST_POINTS, RELEVANT = 10_000, 0.1
#: Rows that a task sorts, about: they fit into its memory.
MOST_SORTED = 1 << 20


def by_case(items: DataFrame, points: DataFrame, case: str = "case") -> DataFrame:
    """items with each case in one partition; partitions are so many that about MOST_SORTED rows of items and points are sorted in one."""
    spark = items.sparkSession
    parts = -(-items.count() * points.count() // MOST_SORTED)
    return items.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts), case)


def evaluate(points: DataFrame, items: DataFrame, weights: DataFrame | None = None, by: str = "point") -> DataFrame:
    """(by, metrics...): what each of points(by, parameters...) scores over items(case, item, key, coupling).

    A case's items, its distractors (coupling 0) among them, are ranked by ``simulated_score``; the truth is the coupling. Means are
    weighted by weights(case, weight), 1 without. The best order of each case is found once, whatever the number of points, and items
    meet the points where their case is: they are moved once, not once a point.
    """
    if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points; evaluate them in parts")
    scored = by_case(items, points).join(F.broadcast(points))
    scored = scored.withColumn("score", F.round(simulated_score(F.col("item"), F.col("coupling"), F.col("key"), {k: F.col(k) for k in PARAMETERS}), 9))
    pos = F.row_number().over(Window.partitionBy(by, "case").orderBy(F.desc("score"), "item"))
    ranked = scored.select(by, "case", pos.alias("pos"), F.col("coupling").alias("relevance"))
    best = metrics.ideal(items.select("case", "item", F.col("coupling").alias("relevance")), relevant=RELEVANT)
    each = metrics.graded(ranked, best, [by], relevant=RELEVANT)
    each = each.join(weights, "case") if weights is not None else each.withColumn("weight", F.lit(1.0))
    return metrics.weighted_mean(each, by=[by])


def defaults() -> dict[str, Column]:
    return {k: F.lit(v[3]) for k, v in PARAMETERS.items()}


def ablations(spark: SparkSession) -> DataFrame:
    """(ablated, names...): the default point under 'baseline', and with each parameter at its neutral value in turn."""
    rows = [("baseline", *(v[3] for v in PARAMETERS.values()))]
    rows += [(k, *(v[4] if n == k else v[3] for n, v in PARAMETERS.items())) for k in PARAMETERS]
    return spark.createDataFrame(rows, "ablated string, " + ", ".join(f"{k} double" for k in PARAMETERS))


def applied(point: dict[str, float], changes: DataFrame) -> DataFrame:
    """(name, value) of a parameter point after changes(name, direction, size), each the first of its name: the value times its
    factor, held in the parameter's range; names that are no parameters are left out, a "pipeline." before a name is not."""
    bare = F.regexp_replace("name", r"^pipeline\.", "")
    rows = [(k, float(v), *PARAMETERS[k][:2]) for k, v in point.items()]
    base = changes.sparkSession.createDataFrame(rows, "name string, value double, least double, most double")
    moved = changes.select(bare.alias("name"), scores.change_factor(F.col("direction"), F.col("size")).alias("factor"), F.monotonically_increasing_id().alias("i"))
    moved = moved.groupBy("name").agg(F.min_by("factor", "i").alias("factor"))
    value = F.greatest(F.col("least"), F.least(F.col("most"), F.col("value") * F.coalesce("factor", F.lit(1.0))))
    return base.join(moved, "name", "left").select("name", value.alias("value"))


def importance(scored: DataFrame) -> DataFrame:
    """(ablated, score, importance, place) of scored(ablated, score): what the baseline loses without it, 0 at least."""
    base = scored.filter("ablated = 'baseline'").select(F.col("score").alias("base"))
    s = scored.filter("ablated <> 'baseline'").crossJoin(F.broadcast(base)).withColumn("importance", F.greatest(F.lit(0.0), F.round(F.col("base") - F.col("score"), 9)))
    return s.select("ablated", "score", "importance", F.row_number().over(Window.orderBy(F.desc("importance"), "ablated")).alias("place"))


def curves(spark: SparkSession, n: int = 7) -> DataFrame:
    """(name, step, value, names...): one parameter at a time over n values, the others at their defaults."""
    p = parameters(spark).select("name", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"), "least", "most", "logarithmic")
    p = p.withColumn("value", scores.decode(F.col("step") / (n - 1), F.col("least"), F.col("most"), F.col("logarithmic")))
    return p.select("name", "step", "value", *(F.when(F.col("name") == k, F.col("value")).otherwise(v[3]).alias(k) for k, v in PARAMETERS.items()))


def interactions(single: DataFrame, pairs: DataFrame, least: float = 0.01, top: int = 6) -> DataFrame:
    """(a, b, interaction) of single(name, importance) and pairs(a, b, effect): the joint effect less both alone, if it is large, of
    pairs among the most important names, ties by name."""
    one = single.select("name", "importance").orderBy(F.desc("importance"), "name").limit(top)
    p = pairs.join(one.select(F.col("name").alias("a"), F.col("importance").alias("ia")), "a").join(one.select(F.col("name").alias("b"), F.col("importance").alias("ib")), "b")
    return p.select("a", "b", (F.col("effect") - F.col("ia") - F.col("ib")).alias("interaction")).filter(F.abs("interaction") > least)
