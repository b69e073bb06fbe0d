"""Query sites: signals, scores, waves, and the pipeline that alternates lookups with ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, scores
from ..params import Coordinates, Policy, RankingConfig
from ..storage import materialise, running
from . import graph, metrics, resolve


def coherence(refs: DataFrame) -> DataFrame:
    """(receiver, n, coherence): log(1 + n) over log(1 + most), the divisor at least 1; held between 0 and 1."""
    n = refs.filter("receiver IS NOT NULL").groupBy("receiver").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    value = F.log(1 + F.col("n")) / F.greatest(F.log(1 + F.col("most")), F.lit(1.0))
    return n.crossJoin(F.broadcast(most)).select("receiver", "n", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("coherence"))


def bridges(degrees: DataFrame) -> DataFrame:
    """(node, bridge): in times out degree over the product of the greatest ones."""
    top = degrees.agg(F.max("in_degree").alias("mi"), F.max("out_degree").alias("mo"))
    product = F.col("mi") * F.col("mo")
    return degrees.crossJoin(F.broadcast(top)).select("node", F.when(product > 0, F.least(F.lit(1.0), F.col("in_degree") * F.col("out_degree") / F.when(product > 0, product))).otherwise(0.0).alias("bridge"))


def select_wave(candidates: DataFrame, p: Policy = Policy(), key: str = "site") -> DataFrame:
    """candidates(site, score) with boltzmann, place and chosen: the first share of them by score, and all whose weight passes the
    gate and the utility floor."""
    c = candidates.withColumn("boltzmann", scores.boltzmann(F.col("score"), p))
    c = running(c, [F.desc("boltzmann"), key], name="place").withColumn("place", F.col("place") + 1)
    n = c.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(p.exploration_floor) - 1e-9)).alias("explore"))
    c = c.crossJoin(F.broadcast(n))
    return c.withColumn("chosen", (F.col("place") <= F.col("explore")) | ((F.col("boltzmann") >= p.gate) & (F.col("boltzmann") >= p.utility_floor))).drop("explore")


def signals(tags: DataFrame, ranks: DataFrame, confidence: DataFrame, degrees: DataFrame) -> DataFrame:
    """A query site for each reference, with the signals of its enclosing function. ranks and degrees have node as
    ``function_id`` gives it."""
    sites = resolve.enclosing(tags).join(resolve.references(tags).select("file", "name", "line", "seq", "receiver"), ["file", "name", "line", "seq"])
    sites = sites.withColumn("node", function_id("file", "caller", "caller_line", "caller_parent"))
    r = metrics.percentile(ranks.select("node", "rank"), "rank")
    out = sites.join(r, "node", "left").join(confidence, ["file", "line"], "left").join(coherence(sites).select("receiver", "coherence"), "receiver", "left").join(bridges(degrees), "node", "left")
    return out.select("file", "name", "line", "seq", "receiver", F.coalesce("rank", F.lit(0.0)).alias("centrality"), F.coalesce("percentile", F.lit(0.0)).alias("percentile"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("coherence", F.lit(0.5)).alias("coherence"), F.coalesce("bridge", F.lit(0.0)).alias("bridge"), F.lit(False).alias("is_root"))


def function_id(file: str, name: str, line: str, parent: str) -> Column:
    """A function is known by file, name, line and parent; null without a name."""
    return F.when(F.col(name).isNotNull(), F.concat_ws("::", file, name, F.col(line).cast("string"), F.coalesce(parent, F.lit(""))))


def function_nodes(tags: DataFrame) -> DataFrame:
    """(node, file) of every function that is defined."""
    return resolve.definitions(tags).select(function_id("t_file", "t_name", "t_line", "t_parent").alias("node"), F.col("t_file").alias("file")).distinct()


def function_edges(calls: DataFrame) -> DataFrame:
    e = calls.select(function_id("src_file", "src_name", "src_line", "src_parent").alias("src"), function_id("dst_file", "dst_name", "dst_line", "dst_parent").alias("dst"), "confidence")
    return e.withColumn("w", F.lit(1).cast("bigint"))


def function_ranks(tags: DataFrame, calls: DataFrame, config: RankingConfig = RankingConfig(), **how) -> DataFrame:
    """Functions ranked over calls; the teleport weighs them by the depth of their files."""
    nodes = function_nodes(tags).select("node", paths.depth_weight(F.col("file"), config).alias("p"))
    return graph.pagerank(nodes, function_edges(calls), config, **how)


def bicameral(tags: DataFrame, heuristics: DataFrame, lookup: DataFrame, p: Policy = Policy(), waves: int = 5, iterations: int = 20) -> DataFrame:
    """One row (waves, queried, resolved, shadow_edges, final_edges, correlation).

    A shadow graph of the heuristics' candidates (``resolve.leading`` ones are enough) is ranked; waves of query sites, the best by policy, are looked up in
    lookup(file, line, type_name) until a wave yields too little, and a file leaves the pool once it has an answer; then the final
    graph holds typed candidates too, and the two rankings are correlated. Each wave is cut by a written table.
    """
    tags, heuristics = materialise(tags, "tags"), materialise(heuristics, "heuristics")
    defs, refs = resolve.definitions(tags), resolve.references(tags)
    shadow = materialise(resolve.call_graph(tags, heuristics, Coordinates.shadow()), "shadow")
    ranks = materialise(function_ranks(tags, shadow, iterations=iterations, tolerance=0.0), "before")
    pool = signals(tags, ranks, resolve.confidences(tags, heuristics, Coordinates.shadow()), graph.degrees(function_edges(shadow)))
    score = scores.site_score(F.col("centrality"), F.col("percentile"), F.col("confidence"), F.col("coherence"), F.col("is_root"), F.col("bridge"), p)
    pool = materialise(pool.withColumn("score", score).withColumn("site", F.concat_ws(":", "file", "line", "name", "seq")), "pool")
    answers, queried, resolved, done = None, 0, 0, 0
    for wave in range(waves):
        chosen = materialise(select_wave(pool, p).filter("chosen").join(lookup.select("file", "line", "type_name"), ["file", "line"], "left"), "wave")
        n, hits = chosen.agg(F.count("*"), F.count("type_name")).first()
        if not n:
            break
        queried, resolved, done = queried + n, resolved + hits, done + 1
        found = chosen.filter("type_name IS NOT NULL").select("file", "line", "type_name")
        answers = found if answers is None else answers.unionByName(found)
        pool = materialise(pool.join(chosen.select("site"), "site", "left_anti").join(found.select("file").distinct(), "file", "left_anti"), "pool")
        if not scores.should_continue(hits / n, wave, p):
            break
    candidates = heuristics
    if answers is not None:
        cache = answers.distinct().select(F.col("file").alias("c_file"), (F.col("line") - 1).alias("c_line"), F.lit(0).alias("c_col"), "type_name")
        # The call graph takes the best candidate, which is of the first method of that name and type.
        candidates = heuristics.unionByName(resolve.cached_type(refs, resolve.first_definitions(defs, ["t_name", "t_parent"]), cache))
    final = materialise(resolve.call_graph(tags, candidates, Coordinates.final()), "final")
    after = function_ranks(tags, final, iterations=iterations, tolerance=0.0)
    rho = metrics.spearman(ranks.select("node", F.round("rank", 12).alias("value")), after.select("node", F.round("rank", 12).alias("value")), ["node"])
    count = lambda df, name: df.agg(F.count("*").alias(name))
    lit = lambda v: F.lit(v).cast("bigint")
    return count(shadow, "shadow_edges").crossJoin(count(final, "final_edges")).crossJoin(rho).select(lit(done).alias("waves"), lit(queried).alias("queried"), lit(resolved).alias("resolved"), "shadow_edges", "final_edges", F.col("rho").alias("correlation"))


def neighbour_mix(structural: Column, semantic: Column, spatial: Column) -> Column:
    return scores.softmax(F.array(structural, semantic, spatial))
