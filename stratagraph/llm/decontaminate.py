"""Benchmark decontamination: a prefix-filtered containment join of documents with benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import common, textkernel as tk

#: Words in a shingle, and the share of an item's shingles that makes a window a leak of it.
SHINGLE, CONTAINMENT = 5, 0.5
#: The benchmark's shingles are sent to every task up to this many; a larger benchmark is joined by shuffle instead.
MOST_SENT = 4 << 20
#: Bits by which the shingles of documents are sorted out before that join: a table of fixed size.
MASK = 1 << 24


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.expr("xxhash64(text)").alias("row_key"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")


def _in_order(texts: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, place in the text, shingles of the text) of every shingle, by slices."""
    for lo, part in tk.slices(texts):
        row, h = tk.shingles(tk.hash_words(*tk.lowered(part)), shingle)
        units = np.bincount(row, minlength=len(part))
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
        yield row + lo, h, np.arange(len(row)) - (np.cumsum(units) - units)[row], units[row]


def _known(h: np.ndarray, vocabulary: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h of hashes that the sorted vocabulary has, and their places in it. may: by the hash's low bits."""
    at = np.flatnonzero(may[(h & tk.U(len(may) - 1)).astype(np.int64)])
    if not len(vocabulary):
        return at[:0], at[:0]
    spot = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
    same = vocabulary[spot] == h[at]
    return at[same], spot[same]


def _mask(tokens: np.ndarray, size: int) -> np.ndarray:
    may = np.zeros(size, bool)
    may[(tokens & tk.U(size - 1)).astype(np.int64)] = True
    return may


def _shingled(df: DataFrame, key: str, shingle: int, only: np.ndarray | None = None) -> DataFrame:
    """(id, row_key, units, pos, token): the shingles of each text in order; units: how many it has. only: a mask of low bits."""
    sent = None if only is None else df.sparkSession.sparkContext.broadcast(only)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, pos, units in _in_order(batch.column(2), shingle):
                if sent is not None:
                    at = np.flatnonzero(sent.value[(h & tk.U(len(sent.value) - 1)).astype(np.int64)])
                    row, h, pos, units = row[at], h[at], pos[at], units[at]
                r = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(r), batch.column(1).take(r), pa.array(units), pa.array(pos), pa.array(h.view(np.int64))], names=["id", "row_key", "units", "pos", "token"])

    return _texts(df, key).mapInArrow(scan, f"id {df.schema[key].dataType.simpleString()}, row_key bigint, units bigint, pos bigint, token bigint")


def _frequency(docs: DataFrame, shingle: int, vocabulary: np.ndarray) -> DataFrame:
    """(token, df) by task: how many texts hold each token of the vocabulary. A row for each token that the task has seen."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        may, total = _mask(known, 1 << 20), np.zeros(len(known), np.int64)
        for batch in batches:
            for row, h, _, _ in _in_order(batch.column(2), shingle):
                at, spot = _known(h, known, may)
                total += np.bincount(np.unique(row[at] * max(1, len(known)) + spot) % max(1, len(known)), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["token", "df"])

    return _texts(docs, "doc_id").mapInArrow(scan, "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df"))


def _hits(docs: DataFrame, shingle: int, vocabulary: np.ndarray, prefix: np.ndarray) -> DataFrame:
    """``_shingled`` for the vocabulary's tokens, of those texts only that hold a token of a prefix."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, prefix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = sent.value
        may, rare = _mask(known, 1 << 20), np.isin(known, first)
        for batch in batches:
            for row, h, pos, units in _in_order(batch.column(2), shingle):
                at, spot = _known(h, known, may)
                at = at[np.isin(row[at], row[at][rare[spot]])]
                r = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(r), batch.column(1).take(r), pa.array(units[at]), pa.array(pos[at]), pa.array(h[at].view(np.int64))], names=["id", "row_key", "units", "pos", "token"])

    return _texts(docs, "doc_id").mapInArrow(scan, f"id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, units bigint, pos bigint, token bigint")


@F.pandas_udf(T.LongType())
def _best_window(hits: pd.Series, units: pd.Series) -> pd.Series:
    """Most distinct tokens among the hits in any window of so many positions. A best window begins at a hit."""
    return pd.Series([best_window(np.array([x["pos"] for x in h]), np.array([x["token"] for x in h]), n) for h, n in zip(hits, units)], dtype="int64")


def best_window(pos: np.ndarray, token: np.ndarray, units: int) -> int:
    order = np.argsort(pos, kind="stable")
    pos, token = pos[order].tolist(), token[order].tolist()
    inside: dict[int, int] = {}
    best = begin = 0
    for p, t in zip(pos, token):
        inside[t] = inside.get(t, 0) + 1
        while pos[begin] <= p - units:
            u = token[begin]
            inside[u] -= 1
            if not inside[u]:
                del inside[u]
            begin += 1
        best = max(best, len(inside))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, matched, shingles, containment): documents that hold at least that share of an item's distinct shingles
    within one window as long as the item.

    The item's shingles are ordered by rarity over all documents, counted in a first pass; a document that shares `need` =
    ceil(share * m) of the m shingles shares one of the m - need + 1 rarest. A second pass gives the hits of those documents only
    that hold such a prefix shingle. A document of fewer shingles than need is no candidate; that need shingles are left from the
    first joined rank on is the prefix's own condition, so no further position bound acts. Windows of candidates are then
    counted exactly.

    docs needs doc_id and text, benchmark item_id and text; other columns aren't read. Ids may be of any type. Rows with a null
    there take no part; a text of fewer words than a shingle is one shingle of all its words, so such an item is found only where
    it is a whole document. Repeated doc_ids or item_ids give one row, of their best window. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = common.materialise(_shingled(benchmark, "item_id", shingle), "items")
    item = ["item_id", "item_key"]
    tokens = items.select(F.col("id").alias("item_id"), F.col("row_key").alias("item_key"), "units", "token").distinct()
    vocabulary = tokens.select("token").distinct()
    sent = vocabulary.limit(most_sent + 1).count() <= most_sent
    as_array = lambda x: np.sort(x.toArrow().column("token").to_numpy().view(np.uint64))
    if sent:
        only = as_array(vocabulary)
        frequency = _frequency(docs, shingle, only)
    else:
        low = vocabulary.select(F.expr(f"token & {MASK - 1}").alias("token")).distinct()  # MASK rows at most
        every = common.materialise(_shingled(docs, "doc_id", shingle, _mask(as_array(low), MASK)).join(vocabulary, "token", "left_semi"), "hits")
        frequency = every.select("id", "row_key", "token").distinct().groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(frequency, "token", "left").withColumns({
        "rank": F.row_number().over(Window.partitionBy(*item).orderBy(F.coalesce("df", F.lit(0)), "token")),
        "m": F.count("*").over(Window.partitionBy(*item)),
    }).withColumn("need", F.ceil(F.col("m") * F.lit(containment) - F.lit(1e-9)))
    ranked = common.materialise(ranked.drop("df"), "ranked")
    prefix = ranked.filter("rank <= m - need + 1")
    hits = common.materialise(_hits(docs, shingle, only, as_array(prefix.select("token").distinct())), "hits") if sent else every
    hits = hits.withColumnsRenamed({"id": "doc_id", "units": "doc_units"})
    pair = ["doc_id", "row_key", *item]
    joined = hits.join(prefix, "token").filter("doc_units >= need").select(*pair).distinct()
    found = hits.join(ranked, "token").join(joined, pair, "left_semi")
    found = found.withColumn("held", F.size(F.collect_set("token").over(Window.partitionBy(*pair)))).filter("held >= need")
    here = found.select(*pair, "units", "m", "need", "pos", "token").groupBy(*pair, "units", "m", "need").agg(F.collect_list(F.struct("pos", "token")).alias("hits"))
    here = here.withColumn("matched", _best_window("hits", "units")).filter("matched >= need")
    return here.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("matched") / F.col("m")).alias("share"), F.col("matched"), F.col("m"))).alias("b")).select("doc_id", "item_id", F.col("b.matched").cast("bigint").alias("matched"), F.col("b.m").cast("bigint").alias("shingles"), F.round("b.share", 6).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs, all columns, without the documents that ``contaminated`` finds. Rows without doc_id or text stay; all rows of a doc_id
    go where one of its texts is found; empty tables leave docs as it is."""
    return common.without_ids(docs, contaminated(docs, benchmark, **how).select("doc_id"))
