"""Token ids in training order: a keyed permutation gives every sequence a global slot; shards have a fixed stride.

Documents follow one another in an order of their content, an end id after each, and this stream of ids is cut into sequences. So
sequences are full, and neither they nor their slots depend on the layout of the input or on the cluster.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import shared_folder
from . import common, tokenizer

#: Tokens in a sequence, sequences in a shard, and the permutation's key.
LENGTH, SHARD, KEY = 2048, 512, 0x5DEECE66D
ROUNDS = 6
#: Of zstd, for ids that are kept or moved.
LEVEL = 6


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The images of x under a keyed permutation of 0 .. n - 1.

    A balanced Feistel network permutes the least power of four that holds n; an image beyond n is sent through it again
    until it falls below n (cycle-walking), which takes under four passes on average and always ends.
    """
    half = max(1, (max(int(n) - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for r in range(ROUNDS):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * (2 * r + 1) + r * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(x).astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def stream(docs: DataFrame, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """The written table (part, at, doc_id, n_tokens, tokens): each text's ids and an end id, in the order of the stream.

    Documents are sorted by a hash of doc_id and text; rows that agree in both may stand in any order. at: ids before the document
    in its part; parts are ranges of the order. tokens: little-endian ids of 2 or 4 bytes, as the vocabulary needs.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, done = tokenizer.load(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            data = [np.append(t.ids(x.as_py()), t.dtype.type(t.end)) for x in batch.column("text")]
            count = np.array([len(x) for x in data], np.int64)
            at = done + np.cumsum(count) - count
            done += int(count.sum())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int32()), pa.array(at), batch.column("doc_id"), pa.array(count), pa.array([x.tobytes() for x in data], pa.binary())], names=["part", "at", "doc_id", "n_tokens", "tokens"])

    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("h"), F.xxhash64(text, F.lit(1)).alias("k")).filter("text IS NOT NULL")
    order = ["h", "k", "doc_id", "salt"]  # the salt spreads rows that repeat each other over ranges
    ranges = keyed.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(common.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return common.materialise(ranges.select("doc_id", "text").mapInArrow(scan, f"part int, at bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, tokens binary"), "stream", LEVEL)


_PLACES = ["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens"]


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in _PLACES)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", LEVEL)


def _order(docs: DataFrame, length: int, shard: int, key: int, vocabulary: str) -> DataFrame:
    """``training_order`` with packed in place of tokens: ids are moved compressed, as they are most of what is moved."""
    spark = docs.sparkSession
    table = stream(docs, vocabulary)
    counts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote the stream
    counts = common.materialise(counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "bases")
    n = -(-(counts.agg(F.sum("n")).first()[0] or 0) // length)
    parts, shards, size = common.partitions(spark), -(-n // shard) or 1, tokenizer.load(vocabulary).dtype.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec()
        for batch in batches:
            if not batch.num_rows:
                continue
            begin, count = (batch.column(k).to_numpy() for k in ("begin", "n_tokens"))
            first = begin // length
            pieces = (begin + count - 1) // length - first + 1
            row = np.repeat(np.arange(len(begin)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] + piece
            lo = np.maximum(begin[row], seq * length)
            hi = np.minimum((begin + count)[row], (seq + 1) * length)
            slot = feistel(seq, n, key)
            whole = batch.column("tokens")
            packed = [codec.compress(whole[r].as_buffer()[a * size : b * size], asbytes=True) for r, a, b in zip(row.tolist(), (lo - begin[row]).tolist(), (hi - begin[row]).tolist())]
            place = (slot % shard * length + lo - seq * length) * size
            cols = [pa.array(slot), pa.array(slot // shard), pa.array(place), batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*_PLACES, "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = table.join(counts.select("part", "base"), "part").select((F.col("base") + F.col("at")).alias("begin"), "doc_id", "n_tokens", "tokens")
    placed = placed.mapInArrow(cut, f"slot bigint, shard bigint, byte_offset bigint, doc_id {kind}, piece int, n_tokens int, packed binary")
    return placed.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("shard", "byte_offset")


def training_order(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, key: int = KEY, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, piece, n_tokens, tokens): every document's pieces in their places of the training order.

    The stream of all documents is cut every length ids into sequences; sequence i has slot feistel(i). Slots are 0 .. n - 1, each
    once, and depend on the documents, length and the key only. piece numbers a document's pieces; byte_offset is a piece's place
    in the shard, whose stride is length ids. Only the stream's last sequence may be short. Partitions hold whole shards in the
    order of their places. A null text gives no row, an empty one its end id; null and repeated doc_ids, of any type, are kept
    as they are, as are very long texts; no rows give no rows. Other columns aren't read.
    """
    size = tokenizer.load(vocabulary).dtype.itemsize

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec()
        for batch in batches:
            whole = [codec.decompress(x.as_buffer(), n * size, asbytes=True) for x, n in zip(batch.column("packed"), batch.column("n_tokens").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["packed"]).columns, pa.array(whole, pa.binary())], names=[*_PLACES, "tokens"])

    ordered = _order(docs, length, shard, key, vocabulary)
    return ordered.mapInArrow(unpack, f"{_kinds(ordered)}, tokens binary")


def write_shards(ordered: DataFrame, folder: str, length: int = LENGTH, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """Writes folder/shard-NNNNNNNN.bin, each piece at its byte_offset and the last sequence filled up with the end id; folder must
    be shared. Gives (shard, sequences, sha256); no rows write nothing.

    A shard is written beside its place and renamed, so a reader never sees half of one, and one that is written again after a
    loss is the same.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, sequences, _, sha256 in _written(batches, folder, length, vocabulary):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([sequences], pa.int64()), pa.array([sha256])], names=["shard", "sequences", "sha256"])

    return ordered.select("shard", "byte_offset", "tokens").mapInArrow(write, "shard bigint, sequences bigint, sha256 string")


def _written(batches: Iterator[pa.RecordBatch], folder: str, length: int, vocabulary: str) -> Iterator[tuple[int, pa.Table, int, str, str]]:
    """(shard, its rows but for the last column, sequences, path, sha256) of each shard once it is written; its rows come one after
    another. The last column is tokens, or packed."""
    t = tokenizer.load(vocabulary)
    stride = length * t.dtype.itemsize
    os.makedirs(folder, exist_ok=True)
    now, data, rows = None, [], []

    def close() -> tuple[int, pa.Table, int, str, str]:
        whole = b"".join(data)
        whole += np.full(-len(whole) % stride // t.dtype.itemsize, t.end, t.dtype).tobytes()
        final = f"{folder}/shard-{now:08d}.bin"
        with open(part := f"{final}.{uuid.uuid4().hex}", "wb") as f:
            f.write(whole)
        os.replace(part, final)
        return now, pa.Table.from_batches(rows), len(whole) // stride, final, hashlib.sha256(whole).hexdigest()

    codec = _codec()
    for batch in batches:
        of, at, rest, lo = batch.column("shard").to_pylist(), batch.column("byte_offset").to_pylist(), batch.drop_columns([held := batch.schema.names[-1]]), 0
        many = batch.column("n_tokens").to_pylist() if held == "packed" else of
        for k, (s, place, tokens, n) in enumerate(zip(of, at, batch.column(held), many)):
            if s != now:
                if k > lo:
                    rows.append(rest.slice(lo, k - lo))
                if data:
                    yield close()
                now, data, rows, lo, size = s, [], [], k, 0
            if place > size:  # behind the stream's last sequence
                data.append(np.full((place - size) // t.dtype.itemsize, t.end, t.dtype).tobytes())
            data.append(codec.decompress(tokens.as_buffer(), n * t.dtype.itemsize, asbytes=True) if held == "packed" else tokens.as_py())
            size = place + len(data[-1])
        if len(of) > lo:
            rows.append(rest.slice(lo))
    if data:
        yield close()


def training_shards(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, key: int = KEY, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, piece, n_tokens, path, sha256): ``training_order`` with its shards written.

    The shards lie in a new folder of the shared folder when this returns: shard's file is path, sha256 is of its bytes, and a
    piece's tokens are the n_tokens ids at byte_offset. The rows are a written table, so reading them writes nothing again.
    The shared folder must be mounted as files, as shards are mapped by their readers.
    """
    folder = shared_folder(docs.sparkSession, "shards")
    ordered = _order(docs, length, shard, key, vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, _, path, sha256 in _written(batches, folder, length, vocabulary):
            rows = rows.combine_chunks().append_column("path", pa.array([path] * rows.num_rows)).append_column("sha256", pa.array([sha256] * rows.num_rows))
            yield from rows.to_batches()

    return common.materialise(ordered.mapInArrow(write, f"{_kinds(ordered)}, path string, sha256 string"), "slots")


def read_shard(path: str, first: int = 0, length: int = LENGTH, vocabulary: str = tokenizer.VOCABULARY) -> np.ndarray:
    """Sequences of a shard from number first on, mapped rather than read: training resumes at any slot. No sequence from there on
    gives an empty array; an empty file can't be mapped, but none is written."""
    dtype = tokenizer.load(vocabulary).dtype
    return np.memmap(path, dtype, "r").reshape(-1, length)[first:]
