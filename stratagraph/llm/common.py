"""Session, storage and join helpers shared by the training-data operators."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..storage import materialise

__all__ = ["any_id", "components", "id_buckets", "materialise", "partitions", "possibly", "read_table", "surely_not", "without_ids"]

#: Buckets of the id filter that is broadcast: at most this many BIGINTs (8 MB), whatever the size of the data.
ID_BUCKETS = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, name: str) -> str:
    """name, or name and underscores, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bucket(column: str):
    return F.expr(f"xxhash64(cast(`{column}` as string)) & {ID_BUCKETS - 1}")


def id_buckets(ids: DataFrame, column: str) -> DataFrame:
    """(bucket) that ids fall into: at most ID_BUCKETS rows, so it can be broadcast at any scale."""
    return ids.select(_bucket(column).alias("bucket")).distinct()


def _in_buckets(df: DataFrame, column: str, buckets: DataFrame, how: str) -> DataFrame:
    name = free(df, "bucket")
    few = F.broadcast(buckets.select(F.col("bucket").alias(name)))  # ID_BUCKETS rows at most
    return df.join(few, _bucket(column) == F.col(name), how)


def possibly(df: DataFrame, column: str, buckets: DataFrame) -> DataFrame:
    """Rows that may carry one of the ids: all that do and a few others. No shuffle of df."""
    return _in_buckets(df, column, buckets, "left_semi")


def surely_not(df: DataFrame, column: str, buckets: DataFrame) -> DataFrame:
    """The rest: rows that carry none of the ids, nulls included."""
    return _in_buckets(df, column, buckets, "left_anti")


def without_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """df less the rows whose id is in ids. Only rows in the ids' buckets are shuffled; the others stay where they were read."""
    name = free(df, "id")
    ids = ids.select(F.col(column).alias(name)).filter(F.col(name).isNotNull()).distinct()
    buckets = id_buckets(ids, name)
    left = possibly(df, column, buckets).join(ids, F.col(column) == F.col(name), "left_anti")
    return surely_not(df, column, buckets).unionByName(left)


#: Columns of results that hold ids of the input.
IDS = ("doc_id", "class_id", "copy_of", "doc_a", "doc_b", "page_id", "partner_id")


def any_id(column: str):
    """Lets an operator whose first argument has BIGINT ids in this column take ids of any type that has an order.

    Ids that aren't integers are numbered in their order, the operator works on the numbers, and its result has the ids again. Integers
    are passed as they are.
    """

    def wrap(f):
        @functools.wraps(f)
        def run(df: DataFrame, *args, **how):
            if isinstance(df.schema[column].dataType, T.IntegralType):
                return f(df, *args, **how)
            own, number = free(df, "own_id"), free(df, "id_number")
            ids = df.select(F.col(column).alias(own)).filter(F.col(own).isNotNull()).distinct()
            ids = ids.repartitionByRange(partitions(df.sparkSession), own).sortWithinPartitions(own)
            ids = materialise(ids.select(own, F.monotonically_increasing_id().alias(number)), "ids")
            numbered = df.join(ids, F.col(column) == F.col(own), "left").select(*(F.col(number).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns))
            out = f(materialise(numbered, "numbered"), *args, **how)
            for c in (c for c in out.columns if c in IDS):
                name = free(out, "id_number")
                named = ids.select(F.col(own).alias(free(out, "own_id")), F.col(number).alias(name))
                out = out.join(named, F.col(c) == F.col(name), "left").select(*(F.col(named.columns[0]).alias(x) if x == c else F.col(f"`{x}`") for x in out.columns))
            return out

        return run

    return wrap


def stars(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges (v, least vertex that v reaches) in place of the edges (a, b): as connected, and at most one a vertex."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = lowest(len(ids), at[: len(a)], at[len(a) :])
    v = np.flatnonzero(low != np.arange(len(ids)))
    for k in range(0, len(v), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[v[k : k + (1 << 16)]]), pa.array(ids[low[v[k : k + (1 << 16)]]])], names=["v", "u"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        yield from stars(*(np.concatenate(x) for x in zip(*held)))


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By vertex of 0 .. n - 1: the least one of its component under the edges (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


#: Stars, at most one a vertex and task, that one task puts together by itself (16 MB).
SMALL = 1 << 20


def _labels(table: pa.Table) -> pa.Table:
    v, u = (table.column(k).to_numpy() for k in ("v", "u"))
    ids, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    return pa.table([ids, ids[lowest(len(ids), at[: len(v)], at[len(v) :])]], names=["v", "comp"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(v, comp): each vertex of the undirected edges (v, u) with the least vertex of its connected component.

    First every partition replaces its edges by stars, so that a dense group is carried on by its vertices rather than its pairs.
    At most so many stars are put together by one task. Of more, least labels spread with pointer jumping; each round is cut by a
    written table, and their number grows with the logarithm of the longest path. An empty edge table gives an empty result; self loops and repeated edges change nothing.
    """
    few = materialise(edges.repartition(partitions(edges.sparkSession), "u").mapInArrow(_stars, "v bigint, u bigint"), "stars")
    if few.limit(small + 1).count() <= small:
        return few.groupBy(F.lit(1).alias("all")).applyInArrow(_labels, "v bigint, comp bigint")
    both = materialise(few.union(few.select("u", "v")).distinct(), "edges")
    label = materialise(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("u"), F.col("comp").alias("c")), "u").groupBy("v").agg(F.min("c").alias("c"))
        step = label.join(near, "v").select("v", "comp", F.least("comp", "c").alias("new"))
        jump = label.select(F.col("v").alias("new"), F.col("comp").alias("far"))
        step = materialise(step.join(jump, "new").select("v", F.least("new", "far").alias("comp"), (F.least("new", "far") < F.col("comp")).alias("moved")), "labels")
        label = step.select("v", "comp")
        if not step.filter("moved").limit(1).count():
            return label
