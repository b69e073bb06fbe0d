"""Word, shingle and token-set hashing over whole Arrow string columns, without a Python loop per word.

A word is a maximal run of letters, digits and underscores of the lower-cased text. Words are hashed to 64 bits by a
polynomial over their bytes (one multiplication a byte, one segmented sum), then mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What no word holds, but for ASCII, which the kernel tells apart by itself.
NOT_WORD = re.compile(r"[^\w\x00-\x7f]")
U = np.uint64
#: Bytes of text hashed at once: bounds the work arrays, not the texts (a longer text is one slice).
SLICE_BYTES = 1 << 20
#: Rows in a slice; row, rarity and hash share one 64-bit sort key.
SLICE_ROWS = 1 << 14
HASH_BITS, LOW_BITS = 44, 50

_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.zeros(256, np.uint8)
for _b in b"0123456789abcdefghijklmnopqrstuvwxyz_":
    _IS_WORD[_b] = 1
_IS_WORD[0x80:] = 1
# Lead bytes of which every character is a letter of two bytes (U+00C0 to U+017F, but for three) need no regex.
_ODD = np.zeros(256, bool)
_ODD[0xC0:] = True
_ODD[[0xC3, 0xC4, 0xC5]] = False
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(NamedTuple):
    hash: np.ndarray  # of every word, in order
    count: np.ndarray  # of words, by row
    first: np.ndarray  # index of each row's first word


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return off - off[0], data


def _odd(data: np.ndarray) -> np.ndarray:
    odd = _ODD[data]
    if len(data) > 1 and (data > 0xC2).any():
        a, b = data[:-1], data[1:]
        odd[:-1] |= ((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) | ((a == 0xC4) & (b == 0xB0))
    return odd


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the lower-cased texts, ready for _IS_WORD; ASCII punctuation stays, other characters of no word are blanks."""
    off, data = buffers(texts)
    where = np.flatnonzero(_odd(data))
    if len(where):
        rows = np.unique(np.searchsorted(off, where, side="right") - 1)
        plain = texts.to_pylist()
        for r in rows.tolist():
            plain[r] = NOT_WORD.sub(" ", plain[r].lower())
        texts = pa.array(plain, pa.large_string())
    return buffers(pc.utf8_lower(texts))


def hash_words(off: np.ndarray, data: np.ndarray, is_word: np.ndarray = _IS_WORD) -> Words:
    rows = len(off) - 1
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= 1 - inside[:-1]
    at = off[:-1][off[:-1] < len(data)]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, U), np.zeros(rows, np.int64), np.zeros(rows, np.int64))
    power, inverse = _power_tables(len(data) + 1)
    value = (data * inside).astype(U)
    value *= power[: len(data)]
    h = np.add.reduceat(value, starts) * inverse[starts]
    edge = np.searchsorted(starts, off)
    return Words(mix(h), np.diff(edge), edge[:-1])


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) so that a part has at most SLICE_BYTES, or one row, and at most SLICE_ROWS."""
    off, _ = buffers(texts)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS, n)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words; a row of fewer words, but at least one, has a single shingle of all of them."""
    row = np.repeat(np.arange(len(w.count)), w.count)
    if n == 1:
        return row, w.hash
    step = U(0xD6E8FEB86659FD93)
    total = len(w.hash)
    out_row, out_hash = [], []
    if total >= n:
        h = w.hash[: total - n + 1].copy()
        for j in range(1, n):
            h *= step
            h += w.hash[j : total - n + 1 + j]
        whole = row[: total - n + 1] == row[n - 1 :]
        out_row.append(row[: total - n + 1][whole])
        out_hash.append(mix(h[whole]))
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        h = np.zeros(len(short), U)
        for j in range(n - 1):
            more = w.count[short] > j
            at = np.minimum(w.first[short] + j, total - 1)
            h = np.where(more, h * step + w.hash[at], h)
        out_row.append(short)
        out_hash.append(mix(h + w.count[short].astype(U)))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(out_row), np.concatenate(out_hash)


class Sets(NamedTuple):
    row: np.ndarray  # of each distinct token, ascending
    token: np.ndarray  # rarity << HASH_BITS | hash, ascending within a row
    size: np.ndarray  # by row
    first: np.ndarray  # index of each row's first token
    top: np.ndarray  # each token's upper HASH_BITS bits, by row
    low: np.ndarray  # each token's lower LOW_BITS bits, by row


def _distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    return key[keep]


def token_sets(row: np.ndarray, h: np.ndarray, rows: int, rarity: np.ndarray | None = None) -> Sets:
    """Distinct tokens of each row in the global order (rarity, hash). rarity: by the hash's low bits, at most 63.

    One sort has the tokens' upper bits in order, another counts them by their lower bits: a row whose counts differ holds two
    tokens that agree in the upper bits. Then whole hashes are sorted, and the second of such tokens goes by another number, the
    same in every row, so that both are shared by sets that hold both.
    """
    token, shift = h >> U(64 - HASH_BITS), U(HASH_BITS + 6)
    level = np.zeros(len(h), U) if rarity is None else rarity[h & U(len(rarity) - 1)].astype(U)
    mask, at = U((1 << HASH_BITS) - 1), row.astype(U) << shift
    key, low = _distinct(at | (level << U(HASH_BITS)) | token), _distinct(at | (h & U((1 << LOW_BITS) - 1)))
    size, other = (np.bincount((x >> shift).astype(np.int64), minlength=rows) for x in (key, low))
    top = key & mask
    if (size < other).any():
        order = np.lexsort((h, at | (level << U(HASH_BITS)) | token))
        new = np.ones(len(order), bool)
        new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
        order = order[new]
        key = (at | (level << U(HASH_BITS)) | token)[order]
        top, again = key & mask, np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        key[again] = (key[again] & ~mask) | (mix(key[again] & mask) & mask)
        size = np.bincount((key >> shift).astype(np.int64), minlength=rows)
    where = (key >> shift).astype(np.int64)
    return Sets(where, key & ((U(1) << shift) - U(1)), size, np.cumsum(size) - size, top, low)


def _sums(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    total, end = np.concatenate([np.zeros(1, U), np.cumsum(m)]), np.cumsum(size)
    return (total[end] - total[end - size]).view(np.int64)


def set_ids(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """An order-free id of each row's set, of two times 64 bits, from all bits of its tokens; zeros for the empty set."""
    if not len(s.token):
        return np.zeros(len(s.size), np.int64), np.zeros(len(s.size), np.int64)
    shift = U(HASH_BITS + 6)
    rest = np.bincount((s.low >> shift).astype(np.int64), minlength=len(s.size))
    low = s.low & U((1 << LOW_BITS) - 1)
    return _sums(mix(s.top * U(_BASE) + U(1)), s.size), _sums(mix(low * U(0xD1B54A32D192ED03) + U(5)), rest)


def parity_bits(s: Sets) -> np.ndarray:
    """64 parities of each row's tokens: sets that differ in d tokens differ in at most d bits."""
    if not len(s.token):
        return np.zeros(len(s.size), np.int64)
    m = U(1) << (mix((s.token & U((1 << HASH_BITS) - 1)) + U(7)) & U(63))
    total = np.concatenate([np.zeros(1, U), np.bitwise_xor.accumulate(m)])
    return (total[s.first + s.size] ^ total[s.first]).view(np.int64)
