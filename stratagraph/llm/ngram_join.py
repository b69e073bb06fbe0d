"""N-gram Jaccard join of documents, with set-relation skipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common, setjoin

#: Runs of three words; pairs of which three fifths of the runs are common.
SPEC = setjoin.SetSpec(shingle=3, by_line=False, threshold=0.6, slack=0.1)


@common.any_id("doc_id")
def ngram_classes(docs: DataFrame, spec: setjoin.SetSpec = SPEC) -> DataFrame:
    """(doc_id, class_id, copy_of, n_shingles, n_links): every document with its class under similarity.

    Two documents are linked if their shingle sets have that Jaccard; a class is connected by links, and class_id is the least
    doc_id in it. copy_of is the least doc_id with the same set, n_links the number of other documents that the document is linked
    to, copies included. So a row for each document, however many pairs there are.

    docs needs doc_id and text; other columns aren't read. Rows whose doc_id or text is null, or whose text has no word, take no
    part and give no row; a text of fewer words than a shingle counts as one shingle; repeated rows count once, and a doc_id with
    several texts has a row for each different set. Ids may be of any type. No rows give no rows.
    """
    own, classes, similar = setjoin.search(docs, spec, by_document=True)
    links = similar.groupBy("set_id", "rest").agg(F.sum("links").alias("links"))
    group = common.components(similar.filter("low <> set_id").select(F.col("set_id").alias("v"), F.col("low").alias("u")))
    key = ["set_id", "rest"]
    near = common.materialise(classes.join(links, key).join(group, F.col("set_id") == F.col("v")).select(*key, "comp", "doc_id", "links"), "near")
    least = near.groupBy("comp").agg(F.min("doc_id").alias("least"))
    near = near.join(least, "comp").select(*key, "least", "links")
    known = classes.join(near, key, "left").select(*key, F.coalesce("least", "doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return own.join(known, key).select("doc_id", "class_id", "copy_of", F.col("size").cast("bigint").alias("n_shingles"), "n_links")


@common.any_id("doc_id")
def ngram_jaccard_join(docs: DataFrame, spec: setjoin.SetSpec = SPEC) -> DataFrame:
    """(doc_a, doc_b, overlap, jaccard): the documents whose shingle sets are similar, doc_a < doc_b.

    Documents with equal sets stand for one another: similar sets give one pair, of their least doc_ids, and every other
    document of a set gives one pair with the least, of Jaccard 1. So all similar pairs follow from the result. It grows with
    the square of the different sets that are similar to each other; ``ngram_classes`` doesn't. Rows that take part are the same.
    """
    own, classes, pairs = setjoin.search(docs, spec, by_document=True, pairs=True)
    copies = own.join(classes.select("set_id", "rest", F.col("doc_id").alias("doc_a")), ["set_id", "rest"]).filter("doc_id > doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.col("size").cast("bigint").alias("overlap"), F.lit(1.0).alias("jaccard"))
    near = pairs.filter("doc_a <> doc_b").select(
        F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), F.col("overlap").cast("bigint").alias("overlap"),
        F.round(F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")), 6).alias("jaccard"),
    )
    return near.unionByName(copies)


def later_copies(docs: DataFrame, spec: setjoin.SetSpec = SPEC) -> DataFrame:
    """(doc_id) of every document but the least of its class, as ``ngram_classes`` has them; no rows give no rows."""
    return common.materialise(ngram_classes(docs, spec).filter("doc_id > class_id").select("doc_id").distinct(), "copies")


@common.any_id("doc_id")
def drop_near_copies(docs: DataFrame, spec: setjoin.SetSpec = SPEC) -> DataFrame:
    """docs, all columns, with the least doc_id of each class of similar documents. Rows without doc_id, text or words stay."""
    return common.without_ids(docs, later_copies(docs, spec))
