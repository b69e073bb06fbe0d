"""HTML extraction by nearest-URL page differencing: lines that a page shares with its neighbour on the site are boilerplate."""

from __future__ import annotations

import html
import os.path
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template|head)\b.*?</\1\s*>", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|footer|header|main|aside|blockquote|pre|d[dlt]|form|hr|figure|figcaption|option|title|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def text_lines(page: str) -> list[str]:
    """Lines of visible text: block tags end a line, other tags vanish, entities are resolved, blank lines are left out."""
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub("\n", page))))
    return [line for raw in text.split("\n") if (line := " ".join(raw.split()))]


#: Equal pairs of lines, as a multiple of the lines, up to which chains of matches are followed.
FEW = 4


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices in a of a longest common subsequence of a and b.

    Common ends are taken off first. Where few pairs of lines are equal, chains of matches are followed (Hunt and Szymanski); else,
    as on pages whose lines repeat, rows of the table are bit vectors (Crochemore and others), a line at a time.
    """
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < top - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    out = {*range(lo), *range(len(a) - end, len(a))}
    places: dict[str, list[int]] = defaultdict(list)
    for j in range(len(b) - end - 1, lo - 1, -1):
        places[b[j]].append(j)
    mine = [i for i in range(lo, len(a) - end) if a[i] in places]
    if sum(len(places[a[i]]) for i in mine) <= FEW * (len(a) + len(b)):
        return out | _by_chains([(i, places[a[i]]) for i in mine])
    known = {*(a[i] for i in mine)}
    return out | {mine[i] for i in _by_bits([a[i] for i in mine], [x for x in b[lo : len(b) - end] if x in known])}


def _by_chains(matches: list[tuple[int, list[int]]]) -> set[int]:
    tails: list[int] = []
    chains: list[tuple] = []
    for i, at in matches:
        for j in at:
            k = bisect_left(tails, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(link)
            elif j < tails[k]:
                tails[k], chains[k] = j, link
    out, link = set(), chains[-1] if chains else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _by_bits(a: list[str], b: list[str]) -> set[int]:
    """Bit j of row i is 0 where a[: i + 1] has a longer subsequence in common with b[: j + 1] than with b[:j]. Every step-th row is
    kept and those between are made again on the way back: memory for 2 sqrt(len(a)) rows."""
    at: dict[str, bytearray] = defaultdict(lambda: bytearray(len(b) // 8 + 1))
    for j, x in enumerate(b):
        at[x][j >> 3] |= 1 << (j & 7)
    bits = {x: int.from_bytes(v, "little") for x, v in at.items()}
    full, size, step = (1 << len(b)) - 1, len(b) // 8 + 1, max(1, isqrt(len(a)))

    def rows(row: int, lines: list[str]) -> Iterator[int]:
        for x in lines:
            u = row & bits.get(x, 0)
            row = ((row + u) | (row - u)) & full
            yield row

    kept, row = [], full
    for i in range(0, len(a), step):
        kept.append(row)
        for row in rows(row, a[i : i + step]):
            pass
    out, j = set(), len(b) - 1
    for k in range(len(kept) - 1, -1, -1):
        own = [kept[k].to_bytes(size, "little"), *(r.to_bytes(size, "little") for r in rows(kept[k], a[k * step : (k + 1) * step]))]
        i = len(own) - 1
        while i > 0 and j >= 0:
            if own[i][j >> 3] >> (j & 7) & 1:
                j -= 1
            else:
                i -= 1
                if own[i][j >> 3] >> (j & 7) & 1:
                    out.add(k * step + i)
                    j -= 1
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.rtrim(F.regexp_extract(url, _URL, 2), F.lit("/")), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit(""))


def _near(path: str, other: str) -> int:
    return len(os.path.commonprefix([path, other]))


@common.any_id("page_id")
def page_differences(pages: DataFrame) -> DataFrame:
    """(page_id, partner_id, n_lines, n_shared, text) of pages(page_id, url, html).

    A page's partner is the page of the same host whose path (without query, fragment and slashes at its end) is next to its own
    in the sorted paths of the host: of the one before and the one after, that which shares the longer beginning; the one before
    in a tie. Pages of one path are versions of a page and never each other's partner; the least page_id stands for them (null
    before others). Where a host has a single path, its pages are told apart by their query string instead, by the same rules. The
    lines on a longest common subsequence of both pages are deleted. A page without a partner, as the only path and query of its
    host, or without a host in its URL, keeps its lines, and partner_id is null; a null html gives an empty text.
    Every row gives a row, repeated ones too; a page may be of any length and ids of any type; no rows give no rows. Other columns
    aren't read.

    One light pass over the URLs finds bounds of equal ranges of (host, path); then each page's lines are sent once, to its
    range, and the pages at a range's ends also to the range beside it.
    """
    spark = pages.sparkSession
    n = common.partitions(spark)
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"), F.col("html").cast("string").alias("html"))
    ranges = keyed.select("host", "path").repartitionByRange(n, "host", "path")
    ranges = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("host", "path")).alias("least"), F.max(F.struct("host", "path")).alias("most"))
    ends = sorted((tuple(r.least), tuple(r.most)) for r in ranges.collect())  # a row for each range
    sent = spark.sparkContext.broadcast(([e[1] for e in ends], [e[0] for e in ends]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, least = sent.value
        for batch in batches:
            out: list[tuple] = []
            for page_id, host, path, query, page in zip(*(batch.column(k).to_pylist() for k in range(5))):
                lines = "\n".join(text_lines(page or ""))
                own = bisect_left(most, (host, path))
                out.append((own, False, host, path, query, page_id, lines))
                if own and least[own] == (host, path):
                    out.append((own - 1, True, host, path, query, page_id, lines))
                if own + 1 < len(most) and most[own] == (host, path):
                    out.append((own + 1, True, host, path, query, page_id, lines))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["range", "beside", "host", "path", "query", "page_id", "lines"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None  # (key, id and lines of the first, rows to give)

        def by_query(rows) -> dict[str, tuple | None]:
            first: dict[str, tuple] = {}
            for page_id, lines, query in rows:
                first.setdefault(query, (query, page_id, lines))
            order = sorted(first)
            beside = {q: order[max(k - 1, 0) : k] + order[k + 1 : k + 2] for k, q in enumerate(order)}
            return {q: first[max(near, key=lambda x: _near(q, x))] if near else None for q, near in beside.items()}

        def result(before, now, after) -> pa.RecordBatch | None:
            rows = now[3]
            host, path = now[0]
            beside = [x for x in (before, after) if host and x and x[0][0] == host]
            partner = max(beside, key=lambda x: _near(path, x[0][1])) if beside else None
            of = by_query(rows) if host and not beside else {}  # no path beside it: the only one of its host
            out = []
            for page_id, lines, query in rows:
                if of:
                    partner = of[query]
                own = lines.split("\n") if lines else []
                gone = shared_lines(own, partner[2].split("\n") if partner[2] else []) if partner else ()
                out.append((page_id, partner[1] if partner else None, len(own), len(gone), "\n".join(x for i, x in enumerate(own) if i not in gone)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["page_id", "partner_id", "n_lines", "n_shared", "text"]) if out else None

        for batch in batches:
            for beside, host, path, query, page_id, lines in zip(*(batch.column(k).to_pylist() for k in range(1, 7))):
                if now is None or now[0] != (host, path):
                    after = ((host, path), page_id, lines, [])
                    if now is not None and (got := result(before, now, after)) is not None:
                        yield got
                    before, now = now, after
                if not beside:
                    now[3].append((page_id, lines, query))
        if now is not None and (got := result(before, now, None)) is not None:
            yield got

    lines = keyed.mapInArrow(scan, "range int, beside boolean, host string, path string, query string, page_id bigint, lines string")
    placed = lines.repartitionById(n, F.col("range")).sortWithinPartitions("host", "path", "page_id", "lines")
    return placed.mapInArrow(differ, "page_id bigint, partner_id bigint, n_lines bigint, n_shared bigint, text string")
