"""Line dedup: an exact set-similarity join of lines; later matches are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common, setjoin

#: A line is the set of its words; four fifths in common make two lines alike.
SPEC = setjoin.SetSpec(shingle=1, by_line=True, threshold=0.8, slack=0.05, sketch_bits=22, parity=True)


@common.any_id("doc_id")
def removed_lines(docs: DataFrame, spec: setjoin.SetSpec = SPEC) -> DataFrame:
    """(doc_id, row_key, line): the lines, numbered from 0, that are similar to an earlier line.

    Earlier is by (doc_id, xxhash64 of the text, line number). An earlier line counts whether or not it is removed itself.
    Equal lines (the same set of words) match one another too.
    """
    occ, classes, similar = setjoin.search(docs, spec)
    at = F.struct("doc_id", "row_key", "line")
    near = similar.groupBy("set_id", "rest").agg(F.min(F.struct(F.col("near_doc").alias("doc_id"), F.col("near_key").alias("row_key"), F.col("near_line").alias("line"))).alias("near"))
    cut = classes.select("set_id", "rest", "n", at.alias("first")).join(near, ["set_id", "rest"], "left").filter("n > 1 OR near < first")
    cut = cut.select("set_id", "rest", F.least("first", "near").alias("least"))
    return common.materialise(occ.join(cut, ["set_id", "rest"]).filter(at > F.col("least")).select("doc_id", "row_key", "line"), "later_lines")


def _without(lines: Column, gone: Column) -> Column:
    """lines less those at the sorted places gone: the runs between them, in one pass over both."""

    def kept(x: Column) -> Column:  # bound once, not once a run
        begins = F.concat(F.array(F.lit(0)), F.transform(x["gone"], lambda i: i + 1))
        ends = F.concat(x["gone"], F.array(F.size(x["lines"])))
        runs = F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda r: r["a"] < r["b"])
        return F.flatten(F.transform(runs, lambda r: F.slice(x["lines"], r["a"] + 1, r["b"] - r["a"])))

    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), kept), F.lit(0))


@common.any_id("doc_id")
def line_dedup(docs: DataFrame, spec: setjoin.SetSpec = SPEC) -> DataFrame:
    """docs, all columns, their text without the lines that are similar (Jaccard of word sets >= 0.8) to an earlier line.

    Lines end at line feeds. Lines without a word are never removed, nor is a line of a row whose doc_id or text is null: such
    rows come back as they are. A document that loses all its lines but blank ones is dropped, as nothing of it is left; one
    that was blank before stays. Rows that repeat both doc_id and text keep the same lines. n_chars, if there, is counted anew
    for the documents that change. Other columns, whatever their names, are passed on. Ids may be of any type; no rows give no rows.
    """
    gone = removed_lines(docs, spec)
    buckets = common.id_buckets(gone, "doc_id")
    d, k, g, t = (common.free(docs, x) for x in ("gone_doc", "gone_key", "gone_lines", "kept_text"))
    change = gone.groupBy(F.col("doc_id").alias(d), F.col("row_key").alias(k)).agg(F.sort_array(F.collect_set("line")).alias(g))
    some = common.possibly(docs, "doc_id", buckets)
    some = some.join(change, (F.col("doc_id") == F.col(d)) & (F.expr("xxhash64(text)") == F.col(k)), "left")
    kept = F.array_join(_without(F.split("text", "\n", -1), F.col(g)), "\n")
    some = some.withColumn(t, F.when(F.col(g).isNull(), F.col("text")).otherwise(kept))
    some = some.filter(F.col(g).isNull() | F.col(t).rlike(r"\S"))
    cols = {"text": F.col(t)}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length(t).cast(docs.schema["n_chars"].dataType))
    some = some.select(*(cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns))
    return common.surely_not(docs, "doc_id", buckets).unionByName(some)
