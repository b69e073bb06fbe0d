"""Best-fit packing of documents into fixed-length sequences, by exact-complement hashing."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common, tokenizer

CAPACITY = 2048


class _Index:
    """The lengths that are available, and which sums singles, pairs and triples of them reach."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.left[0] = 0
        self.capacity = len(counts) - 1
        self._reindex()

    def _reindex(self) -> None:
        self.lengths = np.flatnonzero(self.left)
        self.singles, self.pairs, self.triples = (np.zeros(self.capacity + 1, bool) for _ in range(3))
        self.singles[self.lengths] = True
        for longer, sums in ((self.singles, self.pairs), (self.pairs, self.triples)):
            for a in self.lengths.tolist():
                sums[a + 1 :] |= longer[1 : self.capacity + 1 - a]
        self.gone = 0

    def times(self, pattern: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // n for x, n in Counter(pattern).items())

    def take(self, pattern: tuple[int, ...], n: int) -> None:
        for x in pattern:
            self.left[x] -= n
            self.gone += not self.left[x]
        if self.gone > 64:
            self._reindex()

    def _pair(self, anchor: tuple[int, ...], total: int) -> tuple[int, ...] | None:
        if total < 2 or not self.pairs[total]:
            return None
        a = self.lengths[np.searchsorted(self.lengths, (total + 1) // 2) : np.searchsorted(self.lengths, total)]
        a = a[(self.left[a] > 0) & (self.left[total - a] > 0)]
        for x in a[::-1].tolist():
            if self.times((*anchor, x, total - x)):
                return (*anchor, x, total - x)
        return None

    def exact(self, length: int) -> tuple[int, ...] | None:
        """length and none, one, two or three others that fill a sequence exactly; fewer others, then longer ones, first."""
        gap = self.capacity - length
        if not gap:
            return (length,)
        if self.left[gap] and self.times((length, gap)):
            return (length, gap)
        if found := self._pair((length,), gap):
            return found
        if not self.triples[gap]:
            return None
        a = self.lengths[: np.searchsorted(self.lengths, gap)]
        a = a[(self.left[a] > 0) & self.pairs[gap - a]]
        for x in a[::-1].tolist():
            if self.times((length, x)) and (found := self._pair((length, x), gap - x)):
                return found
        return None


def plan(counts: np.ndarray) -> np.ndarray:
    """Rows (length, first rank, items, first bin, offset): where the items of each length go, by rank within the length.

    counts: items by length, index 0 unused; the last index is the capacity. The plan's size depends on the capacity, not on the
    number of items, as each step uses up a length.
    """
    index, used, rows, bins = _Index(counts), np.zeros(len(counts), np.int64), [], 0

    def place(pattern: tuple[int, ...], n: int) -> None:
        nonlocal bins
        offset = 0
        for x in pattern:
            rows.append((x, used[x], n, bins, offset))
            used[x] += n
            offset += x
        bins += n
        index.take(pattern, n)

    for length in range(len(counts) - 1, 0, -1):
        while index.left[length] and (found := index.exact(length)):
            place(found, index.times(found))
    lengths = np.flatnonzero(index.left).tolist()
    while lengths:
        pattern, gap = [lengths[-1]], len(counts) - 1 - lengths[-1]
        at = bisect_right(lengths, gap)
        while at:
            x = lengths[at - 1]
            fits = min(gap // x, int(index.left[x]) - pattern.count(x))
            pattern += [x] * max(fits, 0)
            gap -= x * max(fits, 0)
            at = bisect_right(lengths, gap, 0, at - 1)
        place(tuple(pattern), index.times(tuple(pattern)))
        lengths = [x for x in lengths if index.left[x]]
    return np.array(rows, np.int64).reshape(-1, 5)


def token_counts(docs: DataFrame, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each row with a doc_id, of any type, and a text; an empty text has 0; no rows give no rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.load(vocabulary).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return texts.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


@common.any_id("doc_id")
def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, length, bin, offset): where each piece of each row of lengths(doc_id, n_tokens) goes.

    A document longer than the capacity is cut into pieces of it and a rest. Sequences are first filled exactly: an item's
    complement is looked up among the sums of one, two and three available lengths. What is left is packed best fit: the
    longest item opens a sequence, and each gap takes the longest item that fits. Items of one length are interchangeable; they
    are taken in order of (hash bucket of the item, doc_id, piece). Lengths that are null or below 1 give no row; repeated rows
    are packed each; no rows give no rows.
    """
    spark = lengths.sparkSession
    salts = common.partitions(spark)
    pieces = lengths.filter("doc_id IS NOT NULL AND n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {capacity})")).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("length"))
    pieces = common.materialise(pieces.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, piece), {salts})")), "pieces")
    salted = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = common.materialise(salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "salted")
    counts = np.zeros(capacity + 1, np.int64)
    for r in salted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    rows = plan(counts)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key = (rows[:, 0] << 48) + rows[:, 1]
    sent = spark.sparkContext.broadcast((key, rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, piece, length, rank = (batch.column(k).to_numpy() for k in range(4))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(piece), pa.array(length), pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], names=["doc_id", "piece", "length", "bin", "offset"])

    ranked = pieces.join(salted.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    return ranked.select("doc_id", "piece", "length", "rank").mapInArrow(place, "doc_id bigint, piece bigint, length bigint, bin bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """``pack`` of docs(doc_id, text) by token counts; rows without doc_id or text, and empty texts, give no row."""
    return pack(common.materialise(token_counts(docs, vocabulary), "lengths"), capacity)
