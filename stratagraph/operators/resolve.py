"""Call resolution: enclosing functions, candidates of five strategies, gated choice, call graph and statistics.

tags: file, name, line, kind ('def' or 'ref'), node_type, parent, receiver, seq (order within the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, scores
from ..params import STRATEGIES, Coordinates
from ..storage import materialise

_CALL = ["file", "name", "line", "seq"]
#: Rows of one key in a block, and pairs that a task lists, about.
CELL, MOST_PAIRS = 1 << 10, 1 << 22


def definitions(tags: DataFrame) -> DataFrame:
    return tags.filter((F.col("kind") == "def") & paths.is_function(F.col("node_type"))).select(F.col("file").alias("t_file"), F.col("name").alias("t_name"), F.col("line").alias("t_line"), F.col("parent").alias("t_parent"))


def references(tags: DataFrame) -> DataFrame:
    return tags.filter(F.col("kind") == "ref").select(*_CALL, "receiver")


def enclosing(tags: DataFrame) -> DataFrame:
    """References with the last function defined at or above their line in the file: one sort a file, no join."""
    w = Window.partitionBy("file").orderBy("line", (F.col("kind") == "ref"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_def = (F.col("kind") == "def") & paths.is_function(F.col("node_type"))
    f = F.last(F.when(is_def, F.struct("name", "line", "parent")), ignorenulls=True).over(w)
    return tags.filter(is_def | (F.col("kind") == "ref")).withColumn("f", f).filter("kind = 'ref'").select(*_CALL, F.col("f.name").alias("caller"), F.col("f.line").alias("caller_line"), F.col("f.parent").alias("caller_parent"))


def _candidates(df: DataFrame, strategy: str, confidence: Column, hint: Column | None = None) -> DataFrame:
    return df.select(*_CALL, F.lit(strategy).alias("strategy"), F.lit(STRATEGIES[strategy][1]).alias("ordinal"), confidence.alias("confidence"), "t_file", "t_name", "t_line", "t_parent", (hint if hint is not None else F.lit(None).cast("string")).alias("type_hint"))


def _paired(refs: DataFrame, defs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """refs joined with defs where keys (column of refs: column of defs) are equal, for keys that many of both have.

    A popular key's pairs are far more than its rows, so a task has them by cells: of the rows of a key in each table, about
    CELL go into a block by their hash, and each pair of blocks is listed by a task of its own. What is moved are blocks.
    """
    sized = [rows.groupBy(*(F.col(c).alias(f"k{i}") for i, c in enumerate(names))).agg(F.count("*").alias(n)) for rows, names, n in ((refs, keys, "nl"), (defs, keys.values(), "nr"))]
    on = [f"k{i}" for i in range(len(keys))]
    size = materialise(sized[0].join(sized[1], on), "sizes")
    pairs = size.agg(F.sum(F.col("nl") * F.col("nr"))).first()[0] or 0

    def blocks(rows: DataFrame, names: list[str], n: str, at: str) -> DataFrame:
        every = F.struct(*rows.columns)
        keyed = rows.select(*(F.col(c).alias(k) for c, k in zip(names, on)), every.alias("row")).join(size.select(*on, n), on)
        return keyed.groupBy(*on, F.pmod(F.xxhash64("row"), F.ceil(F.col(n) / CELL)).alias(at)).agg(F.collect_list("row").alias(f"{at}_rows"))

    cells = blocks(refs, list(keys), "nl", "left").join(blocks(defs, list(keys.values()), "nr", "right"), on)
    cells = cells.repartition(max(1, -(-int(pairs) // MOST_PAIRS)), *on, "left", "right")
    return cells.select(F.explode("left_rows").alias("l"), "right_rows").select("l", F.explode("right_rows").alias("r")).select("l.*", "r.*")


def same_file(refs: DataFrame, defs: DataFrame) -> DataFrame:
    return _candidates(refs.join(defs, (F.col("name") == F.col("t_name")) & (F.col("file") == F.col("t_file"))), "same_file", F.lit(0.9))


def name_match(refs: DataFrame, defs: DataFrame) -> DataFrame:
    pair = _paired(refs.withColumn("dir", paths.parent(F.col("file"))), defs.withColumn("t_dir", paths.parent(F.col("t_file"))), {"name": "t_name"})
    return _candidates(pair, "name_match", F.when(F.col("dir") == F.col("t_dir"), 0.6).otherwise(0.5))


def type_hint(refs: DataFrame, defs: DataFrame, types: DataFrame) -> DataFrame:
    """types: (t_of, type_name), the type of each variable."""
    typed = refs.join(types, F.col("receiver") == F.col("t_of"))
    return _candidates(_paired(typed, defs, {"name": "t_name", "type_name": "t_parent"}), "type_hint", F.lit(0.85), F.col("type_name"))


def _brought(defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(alias, t_...): the definitions that each import brings in."""
    inside = F.col("t_file").contains(F.regexp_replace("module", r"\.", "/"))
    return imports.join(defs, (F.col("original") == F.col("t_name")) & inside).select("alias", "t_file", "t_name", "t_line", "t_parent")


def imported(refs: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """imports: (alias, module, original). Imports meet the definitions first, so the path test is made once for each of those."""
    return _candidates(_paired(refs, _brought(defs, imports), {"name": "alias"}), "import", F.lit(0.8))


def _typed(refs: DataFrame, cache: DataFrame) -> DataFrame:
    return refs.filter("receiver IS NOT NULL").join(cache, (F.col("file") == F.col("c_file")) & (F.col("line") - 1 == F.col("c_line")) & (F.col("c_col") == 0))


def cached_type(refs: DataFrame, defs: DataFrame, cache: DataFrame) -> DataFrame:
    """cache: (c_file, c_line, c_col, type_name), counted from 0."""
    return _candidates(_paired(_typed(refs, cache), defs, {"name": "t_name", "type_name": "t_parent"}), "lsp", F.lit(0.95), F.concat_ws(": ", "receiver", "type_name"))


def heuristics(refs: DataFrame, defs: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """The candidates of ``same_file``, ``name_match``, ``type_hint`` and ``imported`` together."""
    return same_file(refs, defs).unionByName(name_match(refs, defs)).unionByName(type_hint(refs, defs, types)).unionByName(imported(refs, defs, imports))


def heuristics_of(pair: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """``heuristics`` among pairs of a reference and a definition."""
    named, near = pair.filter("name = t_name"), paths.parent(F.col("file")) == paths.parent(F.col("t_file"))
    inside = F.col("t_file").contains(F.regexp_replace("module", r"\.", "/"))
    brought = pair.join(imports, (F.col("name") == F.col("alias")) & (F.col("original") == F.col("t_name")) & inside)
    typed = named.join(types, (F.col("receiver") == F.col("t_of")) & (F.col("t_parent") == F.col("type_name")))
    out = _candidates(named.filter("file = t_file"), "same_file", F.lit(0.9)).unionByName(_candidates(named, "name_match", F.when(near, 0.6).otherwise(0.5)))
    return out.unionByName(_candidates(typed, "type_hint", F.lit(0.85), F.col("type_name"))).unionByName(_candidates(brought, "import", F.lit(0.8)))


_DEF = ["t_file", "t_line", "t_name", "t_parent"]


def first_definitions(defs: DataFrame, keys: list[str], k: int = 1, last: bool = False) -> DataFrame:
    """Of the rows that share the keys, the first (or last) k definitions by file and line. Each task cuts its own rows before they
    are moved."""
    order = [F.desc(c) if last else F.asc(c) for c in _DEF]
    return defs.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= k).drop("n")


def leading(refs: DataFrame, defs: DataFrame, types: DataFrame, imports: DataFrame, k: int = 1) -> DataFrame:
    """Of the candidates of ``heuristics``, those that may come among the first k of their reference in the order of ``ranked``.

    A strategy gives one confidence to all definitions of its key, so the key's first k stand for all of them with any weights, and
    no reference meets each definition of its name. name_match has two confidences and keeps the first k of the directory and of
    all. With k above 1 it also gives the targets that other strategies keep, so that ``statistics`` sees which are agreed on.
    """

    def firsts(rows: DataFrame, keys: list[str], name: str, hint: Column | None = None) -> DataFrame:
        one = F.struct(*_DEF, (hint if hint is not None else F.lit(None).cast("string")).alias("hint"))
        return first_definitions(rows, keys, k).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias(name))

    placed = defs.select("*", F.col("t_name").alias("name"), F.col("t_file").alias("file"), paths.parent(F.col("t_file")).alias("dir"))
    typed = refs.select("name", "receiver").distinct().join(types, F.col("receiver") == F.col("t_of"))
    typed = typed.join(first_definitions(defs, ["t_name", "t_parent"], k), (F.col("name") == F.col("t_name")) & (F.col("type_name") == F.col("t_parent")))
    brought = _brought(defs, imports).withColumnRenamed("alias", "name")
    r = refs.withColumn("dir", paths.parent(F.col("file"))).join(firsts(placed, ["name", "file"], "own"), ["name", "file"], "left").join(firsts(placed, ["name", "dir"], "near"), ["name", "dir"], "left")
    r = r.join(firsts(placed, ["name"], "all"), "name", "left").join(firsts(typed, ["name", "receiver"], "typed", F.col("type_name")), ["name", "receiver"], "left").join(firsts(brought, ["name"], "brought"), "name", "left")
    close = lambda x: paths.parent(x["t_file"]) == F.col("dir")
    target = lambda x: F.struct(*(x[c].alias(c) for c in _DEF), F.lit(None).cast("string").alias("hint"))
    none = F.array().cast(r.schema["all"].dataType)
    kept = {c: F.coalesce(c, none) for c in ("own", "near", "all", "typed", "brought")}
    by_name = F.concat(kept["near"], F.filter(kept["all"], lambda x: ~close(x)))
    if k > 1:
        others = F.filter(F.concat(kept["own"], kept["typed"], kept["brought"]), lambda x: x["t_name"] == F.col("name"))
        by_name = F.concat(by_name, F.array_except(F.transform(others, target), by_name))

    def rows(found: Column, strategy: str, confidence) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(strategy).alias("strategy"), F.lit(STRATEGIES[strategy][1]).alias("ordinal"), confidence(x).alias("confidence"), *(x[c].alias(c) for c in ("t_file", "t_name", "t_line", "t_parent")), x["hint"].alias("type_hint")))

    each = F.concat(
        rows(kept["own"], "same_file", lambda x: F.lit(0.9)), rows(kept["typed"], "type_hint", lambda x: F.lit(0.85)), rows(kept["brought"], "import", lambda x: F.lit(0.8)),
        rows(by_name, "name_match", lambda x: F.when(close(x), 0.6).otherwise(0.5)),
    )
    return r.select(*_CALL, F.explode(each).alias("c")).select(*_CALL, "c.*")


def scaled(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A strategy's confidence times its weight, held between 0 and 1; one of 0.01 or less is left out."""
    held = {k: min(1.0, max(0.0, w)) for k, w in weights.items()}
    gone = [k for k, w in held.items() if w <= 0.01]
    factor = F.lit(1.0)
    for k, w in held.items():
        factor = F.when(F.col("strategy") == k, w).otherwise(factor)
    return candidates.filter(~F.col("strategy").isin(*gone) if gone else F.lit(True)).withColumn("confidence", F.col("confidence") * factor)


def weighed(candidates: DataFrame, c: Coordinates = Coordinates()) -> DataFrame:
    """Candidates with their weighted confidence."""
    return candidates.withColumn("weighted", scores.weighted(F.col("strategy"), F.col("confidence"), c))


def ranked(candidates: DataFrame, c: Coordinates = Coordinates()) -> DataFrame:
    """``weighed`` with the rank in the call, by confidence, strategy, file and line."""
    w = Window.partitionBy(*_CALL).orderBy(F.desc("weighted"), F.desc("ordinal"), "t_file", "t_line")
    return weighed(candidates, c).withColumn("rn", F.row_number().over(w))


def call_graph(tags: DataFrame, candidates: DataFrame, c: Coordinates = Coordinates(), dangling: bool = False) -> DataFrame:
    """Call edges: the best candidate of each reference that has an enclosing function, if the gate takes it. dangling: a
    reference without a candidate leads to the function ('?', its name, 0)."""
    callers = enclosing(tags).filter("caller IS NOT NULL")
    best = ranked(candidates, c).filter("rn = 1")
    took = callers.join(best.filter(scores.accepted(F.col("weighted"), c)), _CALL)
    edges = took.select(F.col("file").alias("src_file"), F.col("caller").alias("src_name"), F.col("caller_line").alias("src_line"), F.col("caller_parent").alias("src_parent"), F.col("t_file").alias("dst_file"), F.col("t_name").alias("dst_name"), F.col("t_line").alias("dst_line"), F.col("t_parent").alias("dst_parent"), F.col("weighted").alias("confidence"), "strategy", F.col("line").alias("call_site"), "type_hint")
    if dangling:
        none = callers.join(best, _CALL, "left_anti")
        edges = edges.unionByName(none.select(F.col("file").alias("src_file"), F.col("caller").alias("src_name"), F.col("caller_line").alias("src_line"), F.col("caller_parent").alias("src_parent"), F.lit("?").alias("dst_file"), F.col("name").alias("dst_name"), F.lit(0).alias("dst_line"), F.lit(None).cast("string").alias("dst_parent"), F.lit(0.0).alias("confidence"), F.lit("unresolved").alias("strategy"), F.col("line").alias("call_site"), F.lit(None).cast("string").alias("type_hint")))
    return edges


def confidences(tags: DataFrame, candidates: DataFrame, c: Coordinates = Coordinates()) -> DataFrame:
    """(file, line, confidence): the best weighted confidence at each reference's line; 0 without a candidate."""
    best = ranked(candidates, c).filter("rn = 1").select(*_CALL, "weighted")
    return references(tags).join(best, _CALL, "left").groupBy("file", "line").agg(F.max(F.coalesce("weighted", F.lit(0.0))).alias("confidence"))


def statistics(refs: DataFrame, candidates: DataFrame, c: Coordinates = Coordinates(), least: float | None = None, gated: bool = True) -> DataFrame:
    """One row about all references; confidences aren't weighted.

    The best candidate is accepted if its confidence is at least ``least``, if given; else, with the gate, if it is above the bias;
    else always. unresolved: references without a candidate, and those dropped, whose best isn't accepted. Of all references
    with two candidates or more, competition counts those whose best two lie less than 0.1 apart, agreement those where another
    candidate has the best one's target. near_misses sums what the best of dropped ones lack to the threshold (``least``, 0.5 with
    the gate, else 0), if no more than 0.2. by_*: accepted ones by strategy; b0 to b4: accepted confidences by fifths.
    """
    w = Window.partitionBy(*_CALL).orderBy(F.desc("confidence"), F.desc("ordinal"), "t_file", "t_line")
    target = F.struct("t_file", "t_name", "t_line", "t_parent")
    r = candidates.withColumns({"rn": F.row_number().over(w), "top": F.first(target).over(w)})
    one = F.col("rn") == 1
    calls = r.groupBy(*_CALL).agg(
        F.max(F.when(one, F.col("confidence"))).alias("best"), F.max(F.when(one, F.col("strategy"))).alias("strategy"), F.max(F.when(F.col("rn") == 2, F.col("confidence"))).alias("second"),
        F.bool_or(~one & (target == F.col("top"))).alias("agrees"),
    )
    best = F.col("best")
    threshold = least if least is not None else 0.5 if gated else 0.0
    took = best >= least if least is not None else best > c.bias if gated else best.isNotNull()
    dropped = best.isNotNull() & ~took
    calls = refs.select(*_CALL).join(calls, _CALL, "left")
    hit = [F.count_if(took & (F.least(F.floor(best * 5), F.lit(4)) == k)).alias(f"b{k}") for k in range(5)]
    by = [F.count_if(took & (F.col("strategy") == s)).alias(f"by_{s}") for s in STRATEGIES]
    missed = F.sum(F.when(dropped & (best >= threshold - 0.2), threshold - best))
    return calls.agg(
        F.count("*").alias("calls"), F.count_if(best.isNull() | dropped).alias("unresolved"), F.count_if(dropped).alias("dropped"), *by, *hit,
        F.count_if(best - F.col("second") < 0.1).alias("competition"), F.count_if("agrees").alias("agreement"), F.coalesce(missed, F.lit(0.0)).alias("near_misses"),
    )


def typed_lookups(tags: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row (queries, resolved, agreements, conflicts) of the type oracle: queries are references inside a function, resolved its
    candidates for them, the rest is ``oracle_agreement`` over them."""
    inside = enclosing(tags).filter("caller IS NOT NULL").select(*_CALL)
    own = candidates.join(inside.distinct(), _CALL, "left_semi")
    resolved = own.agg(F.count_if(F.col("strategy") == "lsp").alias("resolved"))
    return inside.agg(F.count("*").alias("queries")).crossJoin(resolved).crossJoin(oracle_agreement(own))


def counted_lookups(tags: DataFrame, types: DataFrame, imports: DataFrame, cache: DataFrame) -> DataFrame:
    """``typed_lookups`` of all candidates, which are counted by key and not listed."""
    inside = enclosing(tags).filter("caller IS NOT NULL").select(*_CALL)
    defs, own = definitions(tags), references(tags).join(inside.distinct(), _CALL, "left_semi")
    methods = defs.groupBy("t_name", "t_parent").agg(F.count("*").alias("n"))
    resolved = _typed(own, cache).join(methods, (F.col("name") == F.col("t_name")) & (F.col("type_name") == F.col("t_parent"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("resolved"))
    return inside.agg(F.count("*").alias("queries")).crossJoin(resolved).crossJoin(counted_agreement(own, defs, types, imports, cache))


def rates(stats: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row (resolution_rate, rejection_rate, competition_rate, lsp_utilisation, lsp_conflict_rate) of ``statistics`` and
    ``typed_lookups``; 0 where a divisor is 0, but 1 for the resolution of no calls."""
    part = lambda a, b, none=0.0: F.when(b == 0, none).otherwise(a / F.when(b != 0, b))
    c = F.col
    taken, met = c("calls") - c("unresolved"), c("conflicts") + c("agreements")
    return stats.crossJoin(lookups).select(
        part(taken, c("calls"), 1.0).alias("resolution_rate"), part(c("dropped"), c("calls")).alias("rejection_rate"), part(c("competition"), taken).alias("competition_rate"),
        part(c("resolved"), c("queries")).alias("lsp_utilisation"), part(c("conflicts"), met).alias("lsp_conflict_rate"),
    )


def functions_named(calls: DataFrame, name: str | None = None, file: str | None = None) -> DataFrame:
    """(file, name, line, parent): functions of a call graph by name, or of a file."""
    ends = [calls.select(*(F.col(f"{e}_{k}").alias(k) for k in ("file", "name", "line", "parent"))) for e in ("src", "dst")]
    nodes = ends[0].union(ends[1]).distinct()
    nodes = nodes.filter(F.col("name") == name) if name is not None else nodes
    return nodes.filter(F.col("file") == file) if file is not None else nodes


#: Languages in which a strategy is of use; the others work in all.
SUPPORTED = {"type_hint": ("python", "typescript", "tsx")}


def supported(candidates: DataFrame, language: str | None) -> DataFrame:
    """Candidates of the strategies that support the language; all without one."""
    gone = [s for s, known in SUPPORTED.items() if language is not None and language not in known]
    return candidates.filter(~F.col("strategy").isin(*gone)) if gone else candidates


def oracle_agreement(candidates: DataFrame) -> DataFrame:
    """One row (agreements, conflicts): the last typed candidate of a call against each heuristic one."""
    w = Window.partitionBy(*_CALL).orderBy(F.desc("t_file"), F.desc("t_line"))
    typed = candidates.filter("strategy = 'lsp'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(*_CALL, F.struct("t_file", "t_name", "t_line").alias("typed"))
    other = candidates.filter("strategy <> 'lsp'").select(*_CALL, F.struct("t_file", "t_name", "t_line").alias("guess"))
    same = F.col("typed") == F.col("guess")
    return typed.join(other, _CALL).agg(F.count_if(same).alias("agreements"), F.count_if(~same).alias("conflicts"))


def counted_agreement(refs: DataFrame, defs: DataFrame, types: DataFrame, imports: DataFrame, cache: DataFrame) -> DataFrame:
    """``oracle_agreement`` of all candidates: typed ones against those of ``heuristics``. A call's candidates are counted by key; only
    those of the typed definition are listed."""
    last = cached_type(refs, first_definitions(defs, ["t_name", "t_parent"], last=True), cache)
    w = Window.partitionBy(*_CALL).orderBy(F.desc("t_file"), F.desc("t_line"))
    typed = last.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(*_CALL, F.col("t_file").alias("d_file"), F.col("t_name").alias("d_name"), F.col("t_line").alias("d_line"))
    asked = refs.join(typed, _CALL)
    same = heuristics_of(asked.join(defs, (F.col("d_file") == F.col("t_file")) & (F.col("d_name") == F.col("t_name")) & (F.col("d_line") == F.col("t_line"))), types, imports)
    n = lambda rows, *keys: rows.groupBy(*keys).agg(F.count("*").alias("n"))
    methods = asked.select("name", "receiver").distinct().join(types, F.col("receiver") == F.col("t_of")).join(n(defs, "t_name", "t_parent"), (F.col("name") == F.col("t_name")) & (F.col("type_name") == F.col("t_parent")))
    named = defs.select(F.col("t_name").alias("name"), F.col("t_file").alias("file"))
    counts = [(n(named, "name", "file"), ["name", "file"]), (n(named, "name"), ["name"]), (methods.groupBy("name", "receiver").agg(F.sum("n").alias("n")), ["name", "receiver"]), (n(_brought(defs, imports), "alias").withColumnRenamed("alias", "name"), ["name"])]
    every = asked
    for i, (c, keys) in enumerate(counts):
        every = every.join(c.withColumnRenamed("n", f"n{i}"), keys, "left")
    total = every.agg(F.coalesce(F.sum(sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(len(counts))), F.lit(0))), F.lit(0)).alias("n"))
    return same.agg(F.count("*").alias("agreements")).crossJoin(total).select("agreements", (F.col("n") - F.col("agreements")).alias("conflicts"))
