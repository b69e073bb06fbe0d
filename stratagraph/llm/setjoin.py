"""Exact set-similarity self-join by prefix filtering, shared by line dedup and the n-gram Jaccard join.

Sets are the distinct word shingles of a text unit (a line, or a whole document). The steps:

1. ``profile``: one scan writes, for every unit, its set's id and size, and a fixed-size count sketch of the tokens.
2. ``candidates``: tokens are ordered by rarity (sketch count, then hash: any total order keeps the join exact, a rarer-first
   one makes it fast). Units emit their prefix tokens into token buckets; a bucket joins its lists, a part of its tokens at a
   time, under length and positional bounds. A pair is a candidate if it shares enough tokens.
3. ``verified``: candidates are put into blocks of bounded size beside their neighbours. Two blocks with a candidate pair between
   them are a cell, which gets those of their sets that have one; the exact Jaccard is counted within cells.

Prefix. Let alpha = ceil(t / (1 + t) * (|x| + |y|)) be the overlap that similarity t needs, and |x| <= |y|. With
l = 1 + floor(slack * |x|), similar sets share at least l tokens among the first |x| - alpha + l of x and the first
|y| - alpha + l of y: of the shared tokens, those beyond one of these prefixes lie in one suffix of alpha - l tokens. l = 1 is
the usual prefix filter; slack > 0 asks for more shared tokens in slightly longer prefixes and leaves far fewer candidates.

A class is the units of equal sets, known by the 128 bits of (set_id, rest). It has one posting, so a group of thousands of copies
costs no more than its distinct sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common, textkernel as tk

#: Postings that a map task holds before it hands them on, pairs that a list join looks at together, and pairs that it holds.
#: They bound a worker's memory and leave nothing out.
FLUSH, PAIRS, HELD_PAIRS = 1 << 19, 1 << 18, 1 << 19
#: Parts of a bucket, by token, that are read one after the other (a longer list is one step).
PARTS = 8
#: Shared postings of a bucket that are joined together, at least; most shares of their pairs; postings of which one is tried to count them.
HELD_POSTINGS, SHARES, TRIED = 1 << 21, 256, 64
#: Counters in a piece of the sketch, and pieces that one task adds up.
CHUNK, FAN = 1 << 16, 64
#: Sets and tokens in a block, about. A cell has two blocks at most.
BLOCK_SETS, BLOCK_TOKENS = 1 << 10, 1 << 20
#: Shares that a label of several blocks is joined in, so that no task has all of its sets.
SALTS = 64


@dataclass(frozen=True)
class SetSpec:
    """shingle: words in a token. by_line: units are lines, else whole texts. sketch_bits: log2 of the sketch's counters,
    which fixes its size (4 bytes each) whatever the corpus. parity: filter pairs by 64 parities too, for small sets."""

    shingle: int
    by_line: bool
    threshold: float
    slack: float
    sketch_bits: int = 20
    parity: bool = False

    def alpha(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self.threshold
        return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)

    def least_shared(self, smaller: np.ndarray) -> np.ndarray:
        return 1 + np.floor(self.slack * smaller + 1e-9).astype(np.int64)

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Long enough for any partner."""
        least = np.ceil(self.threshold * size - 1e-9).astype(np.int64)
        return np.minimum(size, size - least + self.least_shared(least) + 1)


def units(batch: pa.RecordBatch, spec: SetSpec, may: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices: document and row key, line number, and shingles' unit and hash. Columns of batch: doc_id, row_key, text.
    may: units whose bit isn't set are left out before their words are hashed."""
    doc, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    text = batch.column(2)
    if spec.by_line:
        lists = pa.compute.split_pattern(text, "\n")
        parent = pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        starts = lists.offsets.to_numpy(zero_copy_only=False)
        line = np.arange(len(parent)) - (starts[:-1] - starts[0])[parent]
        text = pa.compute.list_flatten(lists)
    else:
        parent, line = np.arange(len(text)), np.zeros(len(text), np.int64)
    if may is not None:
        some = may[(key[parent] ^ line) & (len(may) - 1)]
        parent, line, text = parent[some], line[some], text.filter(pa.array(some))
    for lo, part in tk.slices(text):
        mine = parent[lo : lo + len(part)]
        row, h = tk.shingles(tk.hash_words(*tk.lowered(part)), spec.shingle)
        yield doc[mine], key[mine], line[lo : lo + len(part)], row, h


def _source(docs: DataFrame) -> DataFrame:
    """row_key tells apart rows that repeat a doc_id. Rows without doc_id or text take no part."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr("xxhash64(text)").alias("row_key"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


_UNITS = {"doc_id": pa.int64(), "row_key": pa.int64(), "line": pa.int32(), "set_id": pa.int64(), "rest": pa.int64(), "size": pa.int32()}


def profile(docs: DataFrame, spec: SetSpec) -> DataFrame:
    """The written table (chunk, part, counts, and arrays of _UNITS): sketch chunks by map task, and units' sets."""
    names = ["chunk", "part", "counts", *_UNITS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << spec.sketch_bits, np.uint32)
        low, seen, n, part = tk.U(len(counts) - 1), [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc, key, line, row, h in units(batch, spec):
                s = tk.token_sets(row, h, len(doc))
                seen.append((s.low & low).astype(np.uint32))
                n += len(s.low)
                if n > FLUSH:
                    counts += np.bincount(np.concatenate(seen), minlength=len(counts)).astype(np.uint32)
                    seen, n = [], 0
                some = s.size > 0
                cols = [pa.array([x[some].astype(t.to_pandas_dtype())], pa.list_(t)) for x, t in zip((doc, key, line, *tk.set_ids(s), s.size), _UNITS.values())]
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([None], pa.binary()), *cols], names=names)
        if seen:
            counts += np.bincount(np.concatenate(seen), minlength=len(counts)).astype(np.uint32)
        for k in range(0, len(counts), CHUNK):
            if counts[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([part], pa.int32()), pa.array([counts[k : k + CHUNK].tobytes()]), *(pa.nulls(1, pa.list_(t)) for t in _UNITS.values())], names=names)

    kinds = ", ".join(f"{k} array<{'bigint' if t == pa.int64() else 'int'}>" for k, t in _UNITS.items())
    return common.materialise(_source(docs).mapInArrow(scan, f"chunk int, part int, counts binary, {kinds}"), "profile")


def occurrences(table: DataFrame) -> DataFrame:
    """(doc_id, row_key, line, set_id, rest, size) of every unit that has a token."""
    return table.filter("set_id IS NOT NULL").select(F.explode(F.arrays_zip(*_UNITS)).alias("z")).select("z.*")


def rarity(table: DataFrame, spec: SetSpec) -> np.ndarray:
    """6-bit logarithms of the sketch's counts; 0 where a token occurs in one unit at most.

    Pieces are added up FAN tasks' at a time, so that what one task holds doesn't depend on their number.
    """

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
        return pa.table({"chunk": group.column("chunk")[:1], "part": group.column("part")[:1], "counts": [np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()]}, pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())]))

    pieces = table.filter("chunk IS NOT NULL").select("chunk", "part", "counts")
    n = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:
        pieces, n = pieces.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("chunk", "part").applyInArrow(add, "chunk int, part int, counts binary"), -(-n // FAN)
        if n > 1:
            pieces = common.materialise(pieces, "sketch")
    out = np.zeros(1 << spec.sketch_bits, np.uint8)
    for r in pieces.collect():  # the sketch, of fixed size
        total = np.frombuffer(r.counts, np.uint32)
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.minimum(63, np.floor(2.5 * np.log2(np.maximum(total, 1))))[: len(out)]
    return out


def _lists(cols: list[np.ndarray], order: np.ndarray, edges: np.ndarray, kinds: list) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(c[order], k)) for c, k in zip(cols, kinds)]


_POSTING = "bucket int, part int, token array<bigint>, set_id array<bigint>, size array<int>, pos array<int>, parity array<bigint>"


def _postings(docs: DataFrame, spec: SetSpec, level, buckets: int) -> DataFrame:
    """Prefix tokens of every unit, by token bucket. A token that occurs in one unit only can't be shared and is left out."""
    names = ["bucket", "part", "token", "set_id", "size", "pos", "parity"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        token, ids, size, pos, bits = (np.concatenate(x) for x in zip(*held))
        b = (tk.mix(token) % tk.U(buckets * PARTS)).astype(np.int64)
        order = np.lexsort((ids, token.view(np.int64), b)) if len(b) else np.zeros(0, np.int64)
        same = np.zeros(len(order), bool)
        same[1:] = (token[order][1:] == token[order][:-1]) & (ids[order][1:] == ids[order][:-1])
        order = order[~same]
        which, at = np.unique(b[order], return_index=True)
        edges = np.append(at, len(order))
        empty = [np.zeros(0, np.int64)] if not spec.parity else []
        cols = _lists([token.view(np.int64), ids, size, pos, *([bits] if spec.parity else [])], order, edges, kinds)
        if empty:
            cols.append(pa.nulls(len(which), pa.list_(pa.int64())))
        whole = pa.RecordBatch.from_arrays([pa.array(which // PARTS, pa.int32()), pa.array(which % PARTS, pa.int32()), *cols], names=names)
        for k in range(0, len(which), 64):
            yield whole.slice(k, 64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, table = [], 0, level.value
        for batch in batches:
            for doc, _, _, row, h in units(batch, spec):
                s = tk.token_sets(row, h, len(doc), table)
                pos = np.arange(len(s.row)) - s.first[s.row]
                keep = (pos < spec.prefix(s.size)[s.row]) & (s.token >> tk.U(tk.HASH_BITS) > 0)
                r = s.row[keep]
                bits = tk.parity_bits(s)[r] if spec.parity else np.zeros(0, np.int64)
                held.append((s.token[keep], tk.set_ids(s)[0][r], s.size[r].astype(np.int32), pos[keep].astype(np.int32), bits))
                n += len(r)
                if n > FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)

    return _source(docs).mapInArrow(scan, _POSTING)


class Lists(NamedTuple):
    """Postings of tokens that several sets have, by token, block of positions, size and id."""

    ids: np.ndarray
    size: np.ndarray
    pos: np.ndarray
    run: np.ndarray  # number of the token
    where: np.ndarray  # (run, block, size) in one number, ascending
    span: int  # beyond the sizes
    blocks: list[int]
    bits: np.ndarray


def _shared(spec: SetSpec, token, ids, size, pos, bits) -> Lists | None:
    """The lists of postings' tokens; None if no two sets share a token."""
    block = np.where(pos > 0, np.floor(np.log2(np.maximum(pos, 1))).astype(np.int64) + 1, 0)
    order = np.lexsort((ids, size, block, token))
    token, ids, size, pos, block = token[order], ids[order], size[order], pos[order], block[order]
    bits = bits[order] if spec.parity else bits
    if len(token):
        fresh = np.ones(len(token), bool)  # equal sets, one posting
        fresh[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])
        token, ids, size, pos, block = (x[fresh] for x in (token, ids, size, pos, block))
        bits = bits[fresh] if spec.parity else bits
    run = np.zeros(len(token), np.int64)
    run[1:] = np.cumsum(token[1:] != token[:-1])
    alone = np.bincount(run)[run] < 2 if len(run) else np.zeros(0, bool)
    ids, size, pos, block, run = (x[~alone] for x in (ids, size, pos, block, run))
    bits = bits[~alone] if spec.parity else bits[:0]
    if not len(ids):
        return None
    span = int(size.max()) + 2
    if (int(run[-1]) + 1) * 64 * span >= 1 << 62:
        raise ValueError("a token bucket is too large; raise spark.sql.shuffle.partitions")
    return Lists(ids, size, pos, run.astype(np.int32), (run * 64 + block) * span + size, span, np.unique(block).tolist(), bits)


def _partners(spec: SetSpec, x: Lists, only: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By block: the postings among only that may have partners in it, and their partners' begin and number.

    A token's list is cut into blocks by position; a block is sorted by size. Given a posting (size s, position p) and a block
    whose least position is P, the bounds on positions are bounds on the partner's size, so the partners are one run of the
    block, found by binary search, and a block whose run is empty is skipped whole.
    """
    t, beta = spec.threshold, spec.threshold / (1 + spec.threshold)
    size, pos, run = (v[only].astype(np.int64) for v in (x.size, x.pos, x.run))
    ell = spec.least_shared(size) - 1
    high = np.minimum(np.floor(size / t + 1e-6), np.floor((size + ell - pos) / beta - size + 1e-6 + 1)).astype(np.int64)
    for k in x.blocks:
        least = 0 if k == 0 else 1 << (k - 1)
        low = np.maximum(size, np.ceil((1 + t) * (beta * size - ell + least) - 1e-6 - 1).astype(np.int64))
        base = (run * 64 + k) * x.span
        lo = np.searchsorted(x.where, base + np.minimum(low, x.span - 1), side="left")
        hi = np.searchsorted(x.where, base + np.clip(high, -1, x.span - 1), side="right")
        many = np.where(high >= low, np.maximum(hi - lo, 0), 0)
        some = np.flatnonzero(many)
        yield only[some], lo[some], many[some]


def _joined(spec: SetSpec, x: Lists, only: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of the postings among only with any, (a, b, size of a, tokens shared), a before b by (size, id)."""
    ids, size, pos, bits = x.ids, x.size, x.pos, x.bits
    for mine_all, lo, many in _partners(spec, x, only):
        ends = np.cumsum(many)
        first = 0
        while first < len(many):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            mine, n, begin = mine_all[first:last], many[first:last], lo[first:last]
            first = last
            i = np.repeat(mine, n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            ok = (size[j] > size[i]) | (ids[j] > ids[i])
            i, j = i[ok], j[ok]
            alpha, shared = spec.alpha(size[i], size[j]), spec.least_shared(size[i])
            ok = (pos[i] <= size[i] - alpha + shared - 1) & (pos[j] <= size[j] - alpha + shared - 1)
            if spec.parity:
                ok &= np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)) <= size[i] + size[j] - 2 * alpha
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            a, b = ids[i], ids[j]
            o = np.lexsort((b, a))
            new = np.ones(len(o), bool)
            new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
            at = np.flatnonzero(new)
            yield a[o][at], b[o][at], size[i][o][at], np.diff(np.append(at, len(o)))


def _met(spec: SetSpec, lists: list[Lists]) -> Iterator[pa.RecordBatch]:
    """The pairs of these lists together, each once with all its tokens, by shares of their first sets.

    Near copies meet in most of their tokens, so pairs that leave token by token are moved many times. A share's pairs are as many as
    a worker holds, by an estimate from every TRIED-th posting; beyond, they leave in pieces, which ``candidates`` adds up.
    """
    about = TRIED * sum(len(found[0]) for x in lists for found in _joined(spec, x, np.arange(0, len(x.ids), TRIED)))
    shares = min(SHARES, max(1, round(about / (2 * HELD_PAIRS))))
    share = [(tk.mix(x.ids.view(np.uint64)) % tk.U(shares)).astype(np.uint8) for x in lists]
    for k in range(shares):
        some, n = [], 0
        for x, of in zip(lists, share):
            for found in _joined(spec, x, np.flatnonzero(of == k)):
                some.append(found)
                n += len(found[0])
                if n > HELD_PAIRS:
                    some = [_summed(some)]
                    n = len(some[0][0])
                    if n > HELD_PAIRS // 2:
                        yield from _by_first(*some[0])
                        some, n = [], 0
        if some:
            yield from _by_first(*_summed(some))


def candidates(docs: DataFrame, spec: SetSpec, level: np.ndarray) -> DataFrame:
    """The written table (a, b[], v[], low[]): b are the set ids that may be similar to a, every similar one among them, each pair
    with one of the two; low: the least one beside v in a part of the pairs."""
    spark = docs.sparkSession
    buckets = max(1, common.partitions(spark) // 3)  # a pair is counted once in each bucket that it shares a token in
    postings = _postings(docs, spec, spark.sparkContext.broadcast(level), buckets)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for table in grouped(batches, "part"):
            for lo, hi in zip(*_runs(table.column("part").to_numpy())):
                part = table.slice(lo, hi - lo)
                lists = _shared(spec, *(pa.compute.list_flatten(part.column(k).combine_chunks()).to_numpy(zero_copy_only=False) for k in range(2, 7)))
                if lists:
                    held.append(lists)
                    n += len(lists.ids)
                if n > HELD_POSTINGS:
                    yield from _met(spec, held)
                    held, n = [], 0
        yield from _met(spec, held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "a"):
            b, shared = (part.column(k).combine_chunks() for k in (2, 3))
            n = pa.compute.list_value_length(b).to_numpy(zero_copy_only=False)
            a, size = (np.repeat(part.column(k).to_numpy(), n) for k in (0, 1))
            a, b, size, shared = _summed([(a, pa.compute.list_flatten(b).to_numpy(), size, pa.compute.list_flatten(shared).to_numpy())])
            enough = shared >= spec.least_shared(size)
            a, b = a[enough], b[enough]
            if len(a):
                at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(a)), pa.int32()), pa.array(b))
                v, low = least_beside(a, b)
                for k in range(0, len(at), 1 << 12):
                    here = lists.slice(k, 1 << 12)
                    yield pa.RecordBatch.from_arrays([pa.array(a[at[k : k + (1 << 12)]]), here, *(pa.nulls(len(here), pa.list_(pa.int64())) for _ in range(2))], names=["a", "b", "v", "low"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([v], pa.list_(pa.int64())), pa.array([low], pa.list_(pa.int64()))], names=["a", "b", "v", "low"])

    parts = postings.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("part")
    pairs = parts.mapInArrow(join, "a bigint, size int, b array<bigint>, shared array<int>")
    return common.materialise(pairs.repartition(common.partitions(spark), "a").sortWithinPartitions("a").mapInArrow(count, "a bigint, b array<bigint>, v array<bigint>, low array<bigint>"), "candidates")


def least_beside(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, low): each vertex of the edges (a, b) and the least of it and its neighbours."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(v))
    i, j = at[: len(a)], at[len(a) :]
    np.minimum.at(low, i, j)
    np.minimum.at(low, j, i)
    return v, v[low]


def _summed(some: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a, b, size of a, tokens shared), each pair once, by a and b."""
    a, b, size, shared = (np.concatenate(x) for x in zip(*some))
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.ones(len(o), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], size[o][at].astype(np.int64), np.add.reduceat(shared[o].astype(np.int64), at) if len(at) else shared


def _by_first(a: np.ndarray, b: np.ndarray, size: np.ndarray, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each a, with its partners in lists: half the bytes of a row for each pair."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
    edges = pa.array(np.append(at, len(a)), pa.int32())
    whole = pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(size[at], pa.int32()), pa.ListArray.from_arrays(edges, pa.array(b)), pa.ListArray.from_arrays(edges, pa.array(shared, pa.int32()))], names=["a", "size", "b", "shared"])
    for k in range(0, len(at), 1 << 14):
        yield whole.slice(k, 1 << 14)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if held and (cut or held[-1].column(key)[-1].as_py() != k[0]):
            if held[-1].column(key)[-1].as_py() != k[0]:
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _slices_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


#: Sets whose answers are kept so that a similar set can start from them.
KEPT_ANSWERS = 64


def similar_pairs(flat: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap) of all pairs i < j of the sets (concatenated, distinct tokens) with Jaccard >= threshold.

    A set's answer is its overlap with every set. The first is counted from the tokens' lists. A later set starts from the
    answer of the most similar one of the last KEPT_ANSWERS sets, if they differ in fewer tokens than the set has: it takes off
    the lists of the tokens that only the other has and adds those of the tokens that only it has.
    """
    m, first = len(size), np.cumsum(size) - size
    owner = np.repeat(np.arange(m), size)
    _, local = np.unique(flat, return_inverse=True)
    order = np.argsort(local, kind="stable")
    begin = np.searchsorted(local[order], np.arange((local.max() + 2) if len(local) else 1))
    by_token = owner[order]
    kept: dict[int, np.ndarray] = {}
    out: list[tuple[np.ndarray, ...]] = []

    def count(tokens: np.ndarray) -> np.ndarray:
        total = np.zeros(m, np.int64)
        n = np.cumsum(begin[tokens + 1] - begin[tokens])
        lo = 0
        while lo < len(tokens):  # lists of PAIRS entries together, or one list
            hi = max(lo + 1, int(np.searchsorted(n, (n[lo - 1] if lo else 0) + PAIRS, side="right")))
            part = tokens[lo:hi]
            total += np.bincount(by_token[_slices_of(begin[part], begin[part + 1])], minlength=m)
            lo = hi
        return total

    for k in range(m):
        mine = local[first[k] : first[k] + size[k]]
        near = max(kept, key=lambda x: (kept[x][k], x), default=None)
        if near is not None and size[near] + size[k] - 2 * kept[near][k] < size[k]:
            other = local[first[near] : first[near] + size[near]]
            answer = kept[near] - count(np.setdiff1d(other, mine, True)) + count(np.setdiff1d(mine, other, True))
        else:
            answer = count(mine)
        if len(kept) == KEPT_ANSWERS:
            kept.pop(next(iter(kept)))
        kept[k] = answer
        j = np.arange(k + 1, m)
        ov = answer[k + 1 :]
        j = j[ov >= np.ceil(threshold * (size[k] + size[k + 1 :] - ov) - 1e-9)]
        j = j[answer[j] > 0]
        if len(j):
            out.append((np.full(len(j), k), j, answer[j]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _cells(table: DataFrame, classes: DataFrame) -> DataFrame:
    """The written table (lo, hi, block, set_id, rest, doc_id, row_key, line, n, size): the classes to compare, by cell (lo, hi).

    A set's label is the least of it and its candidate partners, so that a dense group shares one. A label of more sets or tokens
    than a block may have is cut into blocks by hash.
    """
    label = table.filter("v IS NOT NULL").select(F.explode(F.arrays_zip("v", "low")).alias("z")).groupBy(F.col("z.v").alias("v")).agg(F.min("z.low").alias("label"))
    wanted = classes.join(label, classes.set_id == label.v).drop("v")
    wanted = common.materialise(wanted.withColumn("salt", F.expr(f"pmod(xxhash64(set_id), {SALTS})")), "wanted")
    weight = wanted.groupBy("label").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)).alias("blocks")).filter("blocks > 1")
    weight = weight.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    wanted = wanted.join(weight, ["label", "salt"], "left").withColumn("block", F.expr("xxhash64(label, pmod(xxhash64(set_id, 7), coalesce(blocks, 1)))"))
    wanted = common.materialise(wanted.drop("label", "salt", "blocks"), "blocks")
    block = wanted.select("set_id", "block").distinct()
    pairs = table.filter("a IS NOT NULL").select("a", "b").join(block.toDF("a", "block_a"), "a").select("a", "block_a", F.explode("b").alias("b"))
    pairs = pairs.join(block.toDF("b", "block_b"), "b").select(F.least("block_a", "block_b").alias("lo"), F.greatest("block_a", "block_b").alias("hi"), F.array("a", "b").alias("ab"))
    cells = pairs.select("lo", "hi", F.explode("ab").alias("set_id")).distinct()
    return common.materialise(cells.join(wanted, "set_id"), "cells")


#: Sets in a cell up to which cells are counted together rather than one by one.
FEW_SETS = 12


def similar_in_cells(flat: np.ndarray, size: np.ndarray, cell: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``similar_pairs`` within each cell; cell: ascending, by set. Sets of small cells meet in lists by (cell, token), all at once."""
    begin, end = (np.array(x) for x in _runs(cell)) if len(cell) else (np.zeros(0, np.int64),) * 2
    first, out = np.cumsum(size) - size, []
    many = end - begin > FEW_SETS
    for lo, hi in zip(begin[many].tolist(), end[many].tolist()):
        i, j, ov = similar_pairs(flat[first[lo] : first[hi - 1] + size[hi - 1]], size[lo:hi], threshold)
        out.append((i + lo, j + lo, ov))
    small = np.repeat(~many, end - begin)
    of = np.repeat(np.cumsum(np.concatenate([[0], (end - begin)[:-1]])) if len(begin) else begin, end - begin)  # a set's cell by its first set
    whole = np.flatnonzero(small)
    done = 0
    while done < len(whole):  # whole cells of PAIRS tokens together, or one
        upto = np.cumsum(size[whole[done:]])
        last = whole[min(done + int(np.searchsorted(upto, PAIRS, side="left")), len(whole) - 1)]
        cut = int(np.searchsorted(whole, end[np.searchsorted(begin, of[last])], side="left"))
        mine, done = whole[done:cut], cut
        owner = np.repeat(mine, size[mine])
        token = flat[_slices_of(first[mine], first[mine] + size[mine])]
        order = np.lexsort((owner, token, of[owner]))
        owner, token = owner[order], token[order]
        for step in range(1, FEW_SETS):  # neighbours at this distance in a list
            i, j = owner[:-step], owner[step:]
            same = (token[:-step] == token[step:]) & (of[i] == of[j])
            if not same.any():
                break
            out.append((i[same], j[same], None))
        pairs = [(i, j) for i, j, ov in out if ov is None]
        out = [x for x in out if x[2] is not None]
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            key, ov = np.unique(i * (len(size) + 1) + j, return_counts=True)
            i, j = key // (len(size) + 1), key % (len(size) + 1)
            ok = ov >= np.ceil(threshold * (size[i] + size[j] - ov) - 1e-9)
            out.append((i[ok], j[ok], ov[ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


_VERIFIED = "set_id bigint, rest bigint, links bigint, near_doc bigint, near_key bigint, near_line int, low bigint"
_PAIRS = "a bigint, b bigint, doc_a bigint, doc_b bigint, size_a int, size_b int, overlap int"


def verified(docs: DataFrame, spec: SetSpec, classes: DataFrame, table: DataFrame, pairs: bool = False) -> DataFrame:
    """The written table (set_id, rest, links, near_*, low), a row for each cell in which a class has similar ones: links: their units
    by n; near: the least first unit of theirs; low: the least set id that the class reaches by similarity within the cell.
    With pairs instead (a, b, doc_a, doc_b, size_a, size_b, overlap): each pair of similar sets.

    classes: (set_id, rest, doc_id, row_key, line, n, size), the first unit of each class and a number of its units. Only the
    documents of candidates are scanned again. A pair is counted in one cell: where both its blocks are.
    """
    cells = _cells(table, classes)
    source = _source(common.possibly(docs, "doc_id", common.id_buckets(cells, "doc_id")))
    mask = docs.sparkSession.sparkContext.broadcast(_unit_mask(cells))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = mask.value
        for batch in batches:
            for doc, key, line, row, h in units(batch, spec, may):
                ids, rest = tk.set_ids(tk.token_sets(row, h, len(doc)))
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                edges = np.searchsorted(row[new], np.arange(len(doc) + 1))
                tokens = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rest), pa.array(doc), pa.array(key), pa.array(line.astype(np.int32)), tokens], names=["f_set", "f_rest", "f_doc", "f_key", "f_line", "tokens"])

    found = source.mapInArrow(fetch, "f_set bigint, f_rest bigint, f_doc bigint, f_key bigint, f_line int, tokens array<bigint>")
    here = (found.f_set == cells.set_id) & (found.f_rest == cells.rest) & (found.f_doc == cells.doc_id) & (found.f_key == cells.row_key) & (found.f_line == cells.line)
    sets = found.join(cells, here).select(F.xxhash64("lo", "hi").alias("cell"), "lo", "hi", "block", "set_id", "rest", "doc_id", "row_key", "line", "n", "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "cell"):
            part = part.combine_chunks()
            at = _runs(*(part.column(k).to_numpy() for k in ("lo", "hi", "set_id", "rest")))[0]  # without rows that repeat a document
            part = part if len(at) == part.num_rows else part.take(pa.array(at))
            lo, hi, ids, rest, doc, key, line, n, block = (part.column(k).to_numpy() for k in ("lo", "hi", "set_id", "rest", "doc_id", "row_key", "line", "n", "block"))
            lists = part.column("tokens").combine_chunks()
            size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            begin, end = _runs(lo, hi)
            cell = np.repeat(np.arange(len(begin)), np.array(end) - np.array(begin))
            i, j, ov = similar_in_cells(pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False), size, cell, spec.threshold)
            own = (lo[i] == hi[i]) | (block[i] != block[j])
            i, j, ov = i[own], j[own], ov[own]
            if pairs:
                for k in range(0, len(i), 1 << 18):
                    x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(doc[x]), pa.array(doc[y]), pa.array(size[x].astype(np.int32)), pa.array(size[y].astype(np.int32)), pa.array(ov[k : k + (1 << 18)].astype(np.int32))], names=["a", "b", "doc_a", "doc_b", "size_a", "size_b", "overlap"])
            elif len(i):
                m, order = len(ids), np.lexsort((line, key, doc))
                place = np.empty(m, np.int64)
                place[order] = np.arange(m)
                links = np.bincount(i, n[j], m) + np.bincount(j, n[i], m)
                near = np.full(m, m)
                np.minimum.at(near, i, place[j])
                np.minimum.at(near, j, place[i])
                k = np.flatnonzero(near < m)
                first = order[near[k]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[k], rest[k], links[k].astype(np.int64), doc[first], key[first], line[first], ids[common.lowest(m, i, j)[k]])], names=["set_id", "rest", "links", "near_doc", "near_key", "near_line", "low"])

    sets = sets.repartition(common.partitions(docs.sparkSession), "cell").sortWithinPartitions("cell", "lo", "hi", "set_id", "rest")
    return common.materialise(sets.mapInArrow(verify, _PAIRS if pairs else _VERIFIED), "verified")


def _runs(*keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new).tolist()
    return at, [*at[1:], len(new)]


MASK = 1 << 22


def _unit_mask(cells: DataFrame) -> np.ndarray:
    """Bits of the wanted units: MASK of them, whatever the data."""
    out = np.zeros(MASK, bool)
    table = cells.select(F.expr(f"(row_key ^ line) & {MASK - 1}").cast("int").alias("x")).distinct().toArrow()
    out[table.column("x").to_numpy()] = True
    return out


def search(docs: DataFrame, spec: SetSpec, by_document: bool = False, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, classes, ``verified``) of the units of docs(doc_id, text). by_document: a class's n counts its doc_ids, and
    occurrences are (set_id, rest, doc_id, size) without repeats."""
    table = profile(docs, spec)
    occ = occurrences(table)
    if by_document:
        occ = occ.groupBy("set_id", "rest", "doc_id", "size").agg(F.min(F.struct("row_key", "line")).alias("u")).select("set_id", "rest", "doc_id", "size", "u.*")
        occ = common.materialise(occ, "sets")
    classes = occ.groupBy("set_id", "rest").agg(F.min(F.struct("doc_id", "row_key", "line")).alias("f"), F.count("*").alias("n"), F.max("size").alias("size"))
    classes = common.materialise(classes.select("set_id", "rest", "f.*", "n", "size"), "classes")
    return occ, classes, verified(docs, spec, classes, candidates(docs, spec, rarity(table, spec)), pairs)
