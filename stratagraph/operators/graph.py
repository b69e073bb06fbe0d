"""File and function graphs: edges, PageRank, breadth-first expansion, degrees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..params import RankingConfig
from ..storage import bucketed, materialise

CUT_EVERY = 5
#: Nodes and edges, together, that one task ranks by itself (about 100 MB of arrays).
SMALL = 1 << 20
MOST_TARGETS = 1000
#: Files in a block, and pairs of files that a task lists, about.
BLOCK, MOST_PAIRS = 1 << 11, 1 << 21


def file_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst, w) of defs(file, name) and refs(file, name): each reference to a name that another file defines is an edge.

    References are counted by (file, name) before the join, so a popular name meets each file once. Pairs are as many as the rows in
    the worst case times themselves, so they aren't moved: files are put into blocks, and what a pair of blocks shares is listed
    and summed by the task that has that pair.
    """
    counted = materialise(refs.groupBy("file", "name").agg(F.count("*").alias("w")).select(F.col("file").alias("src"), "name", "w"), "counted")
    targets = materialise(defs.select(F.col("file").alias("dst"), "name").distinct(), "targets")
    size = counted.groupBy("name").agg(F.count("*").alias("l")).join(targets.groupBy("name").agg(F.count("*").alias("r")), "name")
    files = counted.agg(F.countDistinct("src")).crossJoin(targets.agg(F.countDistinct("dst"))).first()
    pairs = size.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0
    named = size.select("name")

    def blocks(rows: DataFrame, file: str, n: int, at: str) -> DataFrame:
        block = F.pmod(F.xxhash64(file), F.lit(max(1, -(-n // BLOCK)))).alias(at)
        return rows.join(named, "name", "left_semi").groupBy("name", block).agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "name"))).alias(f"{at}_rows"))

    cells = blocks(counted, "src", files[0], "left").join(blocks(targets, "dst", files[1], "right"), "name").repartition(max(1, -(-int(pairs) // MOST_PAIRS)), "left", "right")
    each = cells.select("left", "right", F.explode("left_rows").alias("s"), "right_rows").select("left", "right", "s", F.explode("right_rows").alias("d"))
    return each.select("left", "right", "s.src", "d.dst", "s.w").filter("src <> dst").groupBy("left", "right", "src", "dst").agg(F.sum("w").alias("w")).select("src", "dst", "w")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree); w counts parallel edges."""
    ends = edges.select(F.col("src").alias("node"), F.col("w").alias("o"), F.lit(0).cast("bigint").alias("i"))
    ends = ends.unionAll(edges.select(F.col("dst").alias("node"), F.lit(0).cast("bigint").alias("o"), F.col("w").alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _shared(defs: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file_edges`` by their names: a file's references (file, name, w, d, own) to a name that d files define, it itself or not (own
    1 or 0); and the definitions (file, name, all, w) of names that occur ``all`` times, w of them in the file itself."""
    counted = refs.groupBy("file", "name").agg(F.count("*").alias("w"))
    targets = defs.select("file", "name").distinct()
    from_files = counted.join(targets.groupBy("name").agg(F.count("*").alias("d")), "name").join(targets.withColumn("own", F.lit(1)), ["file", "name"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    to_files = targets.join(counted.groupBy("name").agg(F.sum("w").alias("all")), "name").join(counted, ["file", "name"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    return from_files, to_files


def shared_degrees(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """``degrees`` of ``file_edges``, which aren't listed: a name that many files use and many define is an edge for each pair."""
    from_files, to_files = _shared(defs, refs)
    none = F.lit(0).cast("bigint")
    ends = from_files.select(F.col("file").alias("node"), (F.col("w") * (F.col("d") - F.col("own"))).alias("o"), none.alias("i"))
    ends = ends.unionAll(to_files.select("file", none, F.col("all") - F.col("w")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).filter("out_degree > 0 OR in_degree > 0")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, density, average_degree); 0 where a quotient has no meaning. edges: w counts parallel ones."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("edges"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(e).select(
        "nodes", "edges", F.when(F.col("nodes") > 1, F.col("edges") / F.when(pairs > 0, pairs)).otherwise(0.0).alias("density"),
        F.when(F.col("nodes") > 0, F.col("edges") / F.when(F.col("nodes") > 0, F.col("nodes"))).otherwise(0.0).alias("average_degree"),
    )


def pagerank(nodes: DataFrame, edges: DataFrame, config: RankingConfig = RankingConfig(), iterations: int | None = None, tolerance: float | None = None, small: int = SMALL) -> DataFrame:
    """(node, rank) of nodes(node, p) and edges(src, dst, w[, confidence]).

    p: unnormalised teleport weights. A rank follows each edge in proportion to w of all that leave its node; where edges carry
    a confidence, that share is multiplied by it and the rest is lost. The rank of nodes without edges out is spread like p.
    Stops after so many iterations, or once no rank moves by the tolerance in CUT_EVERY of them. Edges from or to what is no node
    don't count.

    A graph of at most so many nodes and edges is ranked by one task, over arrays. A larger one is joined: its edges are put into
    buckets by source once, so a step shuffles nothing but the flows, summed by map task; a block of CUT_EVERY iterations is one
    plan. What dangling nodes hold is a number a step, and all is linear in it, so a block runs without it and adds it at the end.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    share = F.col("w") / F.col("out") * (F.col("confidence") if "confidence" in edges.columns else F.lit(1.0))
    links = edges.join(out, "src").groupBy(F.col("src").alias("node"), "dst").agg(F.sum(share).alias("share"))
    # A row from each node to itself brings its columns along, so that a step reads the one before it once.
    steps = _links(links, 0).unionByName(_own(nodes, F.lit(0.0), 0))
    return _ranked(steps, 1, config, iterations, tolerance, small)


def shared_pagerank(nodes: DataFrame, defs: DataFrame, refs: DataFrame, config: RankingConfig = RankingConfig(), iterations: int | None = None, tolerance: float | None = None, small: int = SMALL) -> DataFrame:
    """``pagerank`` over ``file_edges`` of nodes, which aren't listed: rank goes from a file to the names it refers to and from each name
    to all files that define it, less what the file itself sent there. A step is two, and both grow with the input."""
    known = nodes.select(F.col("node").alias("file"))
    from_files, to_files = _shared(defs.join(known, "file", "left_semi"), refs.join(known, "file", "left_semi"))
    out = F.sum(F.col("w") * (F.col("d") - F.col("own"))).over(Window.partitionBy("file"))
    links = materialise(from_files.withColumn("out", out).filter("out > 0").select(F.col("file").alias("node"), "name", (F.col("w") / F.col("out")).alias("share"), "own"), "links")
    kept = links.groupBy("node").agg(F.sum(F.col("share") * F.col("own")).alias("kept"))
    hub = F.concat(F.lit("\0"), "name")  # no path begins like this
    steps = _links(links.withColumn("dst", hub), 0).unionByName(_own(nodes.join(kept, "node", "left"), -F.coalesce("kept", F.lit(0.0)), 0))
    steps = steps.unionByName(_links(to_files.select(hub.alias("node"), F.col("file").alias("dst"), F.lit(1.0).alias("share")), 1)).unionByName(_own(nodes, F.lit(1.0), 1))
    return _ranked(steps, 2, config, iterations, tolerance, small)


def _links(links: DataFrame, part: int) -> DataFrame:
    return links.select("node", "dst", "share", F.lit(False).alias("own"), F.lit(None).cast("double").alias("p"), F.lit(part).alias("part"))


def _own(nodes: DataFrame, share: Column, part: int) -> DataFrame:
    return nodes.select("node", F.col("node").alias("dst"), share.alias("share"), F.lit(True).alias("own"), F.col("p").cast("double").alias("p"), F.lit(part).alias("part"))


def _ranked(steps: DataFrame, parts: int, config: RankingConfig, iterations: int | None, tolerance: float | None, small: int) -> DataFrame:
    limit, epsilon, alpha = iterations or config.max_iterations, config.epsilon if tolerance is None else tolerance, config.alpha
    steps = materialise(steps, "steps")
    if steps.limit(small + 1).count() <= small:
        return _ranked_in_one_task(steps, parts, limit, epsilon, alpha)
    return _ranked_by_joins(steps, parts, limit, epsilon, alpha)


def _ranked_in_one_task(steps: DataFrame, parts: int, limit: int, epsilon: float, alpha: float) -> DataFrame:
    kind = steps.schema["node"].dataType.simpleString()

    def rank(table: pa.Table) -> pa.Table:
        own, part = table.column("own").to_numpy(zero_copy_only=False).astype(bool), table.column("part").to_numpy()
        first = own & (part == 0)
        names = table.column("node").filter(pa.array(first)).combine_chunks()
        p = table.column("p").to_numpy(zero_copy_only=False)[first]
        n, p = len(p), p / p.sum()
        # What lies between files comes after them; in a graph of one part that is what is no node.
        between = pc.unique(table.column("dst").filter(pa.array(part == 0)))
        between = between.filter(pc.invert(pc.is_in(between, value_set=names))) if parts > 1 else between.slice(0, 0)
        every = pa.concat_arrays([names, between])
        links, share = [], table.column("share").to_numpy(zero_copy_only=False)
        ends = [pc.index_in(table.column(k), value_set=every) for k in ("node", "dst")]
        known = pc.and_(ends[0].is_valid(), ends[1].is_valid()).to_numpy(zero_copy_only=False).astype(bool)
        src, dst = (pc.fill_null(x, 0).to_numpy() for x in ends)
        for i in range(parts):
            at = known & (part == i)
            links.append((src[at], dst[at], share[at]))
        dangling = np.bincount(src[known & ~own & (part == 0)], minlength=len(every))[:n] == 0
        r = before = np.full(n, 1.0 / max(n, 1))
        for step in range(1, limit + 1):
            flow = np.concatenate([r, np.zeros(len(every) - n)])
            for a, b, w in links:
                flow = np.bincount(b, flow[a] * w, len(every))
            r = (1 - alpha) * p + alpha * (flow[:n] + r[dangling].sum() * p)
            if step % min(CUT_EVERY, limit) == 0:
                if epsilon > 0 and np.abs(r - before).max() < epsilon:
                    break
                before = r
        return pa.table([names, pa.array(r)], names=["node", "rank"])

    return steps.groupBy(F.lit(1).alias("all")).applyInArrow(rank, f"node {kind}, rank double")


def _ranked_by_joins(steps: DataFrame, parts: int, limit: int, epsilon: float, alpha: float) -> DataFrame:
    known = steps.filter("own AND part = 0").select("node")
    if parts == 1:
        steps = steps.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").join(known, "node", "left_semi")
    way = [bucketed(steps.filter(F.col("part") == i).select("node", "dst", "share", "own", "p"), "steps", "node") for i in range(parts)]
    total, n = way[0].filter("own").agg(F.sum("p"), F.count("*")).first()
    start = way[0].groupBy("node").agg((F.max("p") / F.lit(total)).alias("p"), (F.count_if(~F.col("own")) == 0).alias("dangling"))
    start = bucketed(start, "nodes", "node")
    way, block = [x.drop("p") for x in way], min(CUT_EVERY, limit)

    def spread(table: DataFrame, base: Column) -> DataFrame:
        """table with y replaced by base + alpha times what flows in along the edges."""
        kept = [c for c in table.columns if c not in ("node", "y")]
        for one in way:
            table = one.join(table, "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("y") * F.col("share")).alias("y"), *(F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in kept))
        return table.withColumn("y", base + alpha * F.col("y"))

    # What a unit of rank that leaves dangling nodes becomes after 0, 1, .. steps: z0, z1, ..
    state = start.withColumn("y", alpha * F.col("p")).withColumn("z0", F.col("y"))
    for i in range(1, block):
        state = spread(state, F.lit(0.0)).withColumn(f"z{i}", F.col("y"))
    units = bucketed(state.select("node", "dangling", *(f"z{i}" for i in range(block))), "units", "node")
    held = F.col("dangling").cast("double")
    lost_z = units.agg(*(F.coalesce(F.sum(held * F.col(f"z{i}")), F.lit(0.0)) for i in range(block))).first()
    state = start.withColumn("rank", F.lit(1.0 / n))
    for begin in range(0, limit, block):
        k = min(block, limit - begin)
        run = state.withColumn("y", F.col("rank"))
        for i in range(k):
            run = spread(run.withColumn(f"y{i}", F.col("y")), (1 - alpha) * F.col("p"))
        run = bucketed(run.join(units.drop("dangling"), "node"), "ranks", "node")
        lost_y = run.agg(*(F.sum(held * F.col(f"y{i}")) for i in range(k))).first()
        loose: list[float] = []  # by step: the rank that dangling nodes hold, which the block left out so far
        for i in range(k):
            loose.append(lost_y[i] + sum(loose[j] * lost_z[i - 1 - j] for j in range(i)))
        after = F.col("y")
        for j in range(k):
            after = after + F.lit(loose[j]) * F.col(f"z{k - 1 - j}")
        moved = run.withColumn("old", F.col("rank")).withColumn("rank", after)
        state = moved.select("node", "p", "dangling", "rank")
        if epsilon > 0 and begin + k < limit and moved.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] < epsilon:
            break
    return state.select("node", "rank")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """(file, sym, weight) of symbol edges (from_file, from_sym, to_file, to_sym) and seeds(sym): decay to the power of the least
    number of edges, in either direction, from a symbol whose name is a seed. Symbols without an edge don't occur."""
    there = edges.select(F.struct(F.col("from_file").alias("file"), F.col("from_sym").alias("sym")).alias("a"), F.struct(F.col("to_file").alias("file"), F.col("to_sym").alias("sym")).alias("b"))
    both = materialise(there.union(there.select("b", "a")).distinct(), "links")
    reached = both.select("a").distinct().join(seeds.select(F.col("sym").alias("s")).distinct(), F.col("a.sym") == F.col("s")).select("a", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        reached = materialise(reached, "reached")
        near = both.join(reached.filter(F.col("hop") == hop - 1).select("a"), "a", "left_semi").select(F.col("b").alias("a")).distinct()
        reached = reached.unionAll(near.join(reached, "a", "left_anti").select("a", F.lit(hop).alias("hop")))
    return reached.select("a.file", "a.sym", F.pow(F.lit(decay), F.col("hop")).alias("weight"))


def expand_shared(edges: DataFrame, tags: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """``expand`` over symbol edges and, unlisted, those from each reference of tags(file, name, kind) to each definition of its name
    in another file. Of what a hop starts from, a name passes on how many files refer to it and define it, and which if it is one:
    that file's own symbol isn't reached."""
    both = edges.select(F.struct(F.col("from_file").alias("file"), F.col("from_sym").alias("sym")).alias("a"), F.struct(F.col("to_file").alias("file"), F.col("to_sym").alias("sym")).alias("b"))
    both = materialise(both.union(both.select("b", "a")).distinct(), "links")
    side = lambda kind: F.bool_or(F.col("kind") == kind)
    nodes = materialise(tags.select("file", F.col("name").alias("sym"), "kind").filter("kind IN ('ref', 'def')").groupBy("file", "sym").agg(side("ref").alias("refers"), side("def").alias("defines")), "symbols")
    by_name = lambda rows: rows.groupBy("sym").agg(*(f(F.when(F.col(c), F.col("file"))).alias(f"{n}_{c}") for c in ("refers", "defines") for n, f in (("n", F.count), ("one", F.min))))

    def reached_from(rows: DataFrame) -> DataFrame:
        met = lambda c: (F.col(f"n_{c}") > 1) | ((F.col(f"n_{c}") == 1) & (F.col(f"one_{c}") != F.col("file")))
        there = nodes.join(by_name(rows), "sym").filter((F.col("defines") & met("refers")) | (F.col("refers") & met("defines")))
        return there.select(F.struct("file", "sym").alias("a"))

    known = both.select("a").union(reached_from(nodes.join(seeds.select("sym").distinct(), "sym", "left_semi"))).distinct()
    reached = known.join(seeds.select(F.col("sym").alias("s")).distinct(), F.col("a.sym") == F.col("s")).select("a", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        reached = materialise(reached, "reached")
        last = reached.filter(F.col("hop") == hop - 1)
        named = nodes.join(last.select("a.file", "a.sym"), ["file", "sym"], "left_semi")
        near = both.join(last.select("a"), "a", "left_semi").select(F.col("b").alias("a")).union(reached_from(named)).distinct()
        reached = reached.unionAll(near.join(reached, "a", "left_anti").select("a", F.lit(hop).alias("hop")))
    return reached.select("a.file", "a.sym", F.pow(F.lit(decay), F.col("hop")).alias("weight"))


def focus(targets: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, names) that targets(target) mean: a target is cut at commas and trimmed, and blank parts are left out.

    A part with a slash or a dot is first a path: of the files that end with it, or hold it after a slash, the least is meant. What is
    no such path matches names, as ``text.matches_query`` does; what matches nothing is left out. A part meets distinct files
    and distinct names only; targets are few and typed by hand, so they are broadcast, up to MOST_TARGETS of them.
    """
    parts = targets.select(F.explode(F.split("target", ",")).alias("target")).select(F.trim("target").alias("target")).filter("target <> ''").distinct()
    if parts.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    target, file = F.col("target"), F.col("file")
    like_path = (target.contains("/") | target.contains(".")) & (file.endswith(target) | file.contains(F.concat(F.lit("/"), target)))
    found = materialise(tags.select("file").distinct().join(F.broadcast(parts), like_path).groupBy("target").agg(F.min("file").alias("file")), "paths")
    rest = parts.join(F.broadcast(found), "target", "left_anti")
    names = tags.select("name").distinct().join(F.broadcast(rest), text.matches_query(F.col("name"), target)).select("name").distinct()
    return found.select("file").distinct(), names


def caller_weights(edges: DataFrame) -> DataFrame:
    """(file, name, callers): edges into each function; nodes that differ by line alone give the most."""
    return edges.groupBy("dst_file", "dst_name", "dst_line").agg(F.count("*").alias("n")).groupBy(F.col("dst_file").alias("file"), F.col("dst_name").alias("name")).agg(F.max("n").alias("callers"))


def file_caller_weights(callers: DataFrame) -> DataFrame:
    s = F.sum("callers")
    return callers.groupBy("file").agg(s.alias("callers"), (1 + F.greatest(F.log(s), F.lit(0.0))).alias("weight"))


def calls(edges: DataFrame, file: str | None, name: str, direction: str = "from") -> DataFrame:
    """Edges that leave (from) or enter (to) a function; without a file, all functions of that name."""
    side = "src" if direction == "from" else "dst"
    named = edges.filter(F.col(f"{side}_name") == name)
    return named.filter(F.col(f"{side}_file") == file) if file is not None else named


def top_links(edges: DataFrame, k: int = 5) -> DataFrame:
    """(src, dst, w, rn): the k heaviest links of each node."""
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return edges.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def merge(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Graphs in one: nodes once, edges as often as they occur."""
    n, e = nodes[0], edges[0]
    for x, y in zip(nodes[1:], edges[1:]):
        n, e = n.unionByName(x), e.unionByName(y)
    return n.distinct(), e


def symbol_edges(couplings: DataFrame) -> DataFrame:
    """Edges in both directions between the whole files of (test, source)."""
    one = couplings.select(F.col("test").alias("from_file"), F.lit("__file__").alias("from_sym"), F.col("source").alias("to_file"), F.lit("__file__").alias("to_sym"))
    return one.unionByName(one.select(F.col("to_file").alias("from_file"), F.col("to_sym").alias("from_sym"), F.col("from_file").alias("to_file"), F.col("from_sym").alias("to_sym")))
