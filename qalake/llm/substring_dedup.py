"""Substring dedup of words by recompression.

Rounds name runs and pairs of symbols, beginning with the words: a pair of equal neighbours that stands alone becomes one
symbol, and then each left symbol followed by a right one, where a bit of the symbol's name says left or right. A name
is a hash of what it stands for, so that names agree over all tasks without a dictionary, and equal word sequences
have the same symbols but near their ends. How far a symbol looks to each side is carried along; in every window of 50
words the symbols that look at its words only are the same wherever the window stands. The longest of them (by hash, if
several) is the window's anchor. Shared anchors reveal repeats (see repeats.py): segments that are equal as a whole, by
two 64-bit hashes, repeat without a comparison, as most do; where an anchor has several contents, the words are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .repeats import HOT, PART, without_repeats
from .shared import PLAIN, SLICE_BYTES, hash_words, mix, ranges, raw, read, runs, slices, words

WIDTH, ROUNDS = 50, 3
PLACE_BITS = 21
PLACES = np.uint64((1 << PLACE_BITS) - 1)
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix(a * C1 + (b ^ (b >> np.uint64(31))) * C2 + np.uint64(salt))


def _spans(h: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of 1, 2, 4, ... 32 words from each place on."""
    out, k = {1: h}, 1
    while k < 32:
        x = out[k]
        out[2 * k] = _join(x[: max(len(x) - k, 0)], x[k:])
        k *= 2
    return out


def _fold(symbols: tuple, lead: np.ndarray, salt: int, reach: int, edges: tuple) -> tuple:
    """Symbols after each one of lead (which marks all but seconds) took its second; they look reach symbols further on both sides."""
    name, begin, low, high, row = symbols
    first = np.flatnonzero(lead)
    last = np.append(first[1:], len(name)) - 1
    merged = last > first
    new = name[first].copy()
    new[merged] = _join(name[first[merged]], name[last[merged]], salt)
    a, b = first - reach, last + reach
    start, end = edges
    own = row[first]
    inside = (a >= 0) & (row[np.maximum(a, 0)] == own)
    low = np.where(inside, low[np.maximum(a, 0)], start[own] - 1)
    top = np.minimum(b, len(name) - 1)
    inside = (b < len(name)) & (row[top] == own)
    high = np.where(inside, high[top], end[own] + 1)
    return new, begin[first], low, high, own


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple:
    """(name, begin, low, high, row) of each symbol: its first word, and the words that it depends on, low to high.

    A dependence that leaves the row goes beyond every window."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(h))
    symbols, edges = (h, place, place, place + 1, row), (first[:-1], first[1:])
    for r in range(rounds):
        name, row = symbols[0], symbols[4]
        same = np.zeros(len(name) + 1, bool)  # same[i]: i - 1 and i are equal neighbours
        same[1:-1] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
        before = np.concatenate([[False], same[:-1]])
        after = np.concatenate([same[1:], [False]])
        second = (same & ~before & ~after)[:-1]
        symbols = _fold(symbols, ~second, 2 * r + 1, 2, edges)
        name, row = symbols[0], symbols[4]
        right = (name >> np.uint64(7 + r)) & np.uint64(1) == 1
        second = np.zeros(len(name), bool)
        second[1:] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
        symbols = _fold(symbols, ~second, 2 * r + 2, 1, edges)
    return symbols


def _least(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of key[low:high] (high > low), by overlapping powers of two."""
    out, table, k = np.empty(len(low), np.uint64), key, 1
    span = high - low
    while len(low):
        pick = (span >= k) & (span < 2 * k)
        out[pick] = np.minimum(table[low[pick]], table[high[pick] - k])
        if not (span >= 2 * k).any():
            return out
        table = np.minimum(table[:-k], table[k:])
        k *= 2
    return out


def _content(spans: dict[int, np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the words low to high."""
    length = high - low
    out = length.astype(np.uint64)
    for k, x in spans.items():
        pick = (length >= k) & ((length < 2 * k) | (k == 32))
        out[pick] = _join(_join(x[low[pick]], x[high[pick] - k]), out[pick])
    return out


def _anchors(h: np.ndarray, first: np.ndarray):
    """row, anchor hash, content hash, place, place of the anchor in the first window, windows."""
    windows = np.maximum(np.diff(first) - WIDTH + 1, 0)
    if not windows.sum():
        return
    p, row = ranges(first[:-1], windows), np.repeat(np.arange(len(windows)), windows)
    spans = _spans(h)
    name, begin, low, high, _ = recompress(h, first)
    length = np.diff(np.append(begin, len(h)))
    # long symbols first, then by hash, then the leftmost
    rank = (np.uint64(63) - np.minimum(length, 63).astype(np.uint64)) << np.uint64(58)
    key = ((rank | mix(name ^ C2) >> np.uint64(6)) & ~PLACES) | np.arange(len(name), dtype=np.uint64)
    a, b = np.searchsorted(low, p), np.searchsorted(high, p + WIDTH, side="right")
    a, b = a.astype(np.int64), b.astype(np.int64)
    some = b > a
    choice = np.full(len(p), -1, np.int64)
    choice[some] = (_least(key, a[some], b[some]) & PLACES).astype(np.int64)
    if not some.all():  # symbols that look too far: the least word takes their place
        word = ((mix(h ^ C1)) & ~PLACES) | np.arange(len(h), dtype=np.uint64)
        rest = p[~some]
        choice[~some] = -2 - (_least(word, rest, rest + WIDTH) & PLACES).astype(np.int64)
    at = runs(row, choice)
    p0, n, choice, row = p[at[:-1]], np.diff(at), choice[at[:-1]], row[at[:-1]]
    own = choice >= 0
    lo, hi = np.empty(len(p0), np.int64), np.empty(len(p0), np.int64)
    lo[own], hi[own] = low[choice[own]], high[choice[own]]
    lo[~own] = -2 - choice[~own]
    hi[~own] = lo[~own] + 1
    # a run of windows is cut where it is longer than two windows can cover
    anchor = _content(spans, lo, hi) ^ np.where(own, np.uint64(0), C1)
    whole = lambda x: _join(spans[32][x], spans[32][x + WIDTH - 32])
    s = mix(_join(whole(p0), whole(p0 + n - 1), 5) + ((lo - p0) * 256 + n).astype(np.uint64) * C1)
    yield row, anchor, s, p0 - first[row], lo - p0, n


def anchors(data: np.ndarray, offsets: np.ndarray):
    for i, j in slices(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(part, own, PLAIN)
        h = hash_words(part, starts, ends)
        if len(h) <= SLICE_BYTES:
            for row, *rest in _anchors(h, first):
                yield i + row, *rest
            continue
        for begin in range(0, len(h) - WIDTH + 1, SLICE_BYTES):  # one long document, in overlapping parts
            x = h[begin : begin + SLICE_BYTES + WIDTH - 1]
            for row, anchor, s, pos, o, n in _anchors(x, np.array([0, len(x)])):
                yield i + row, anchor, s, begin + pos, o, n


def texts(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray, skip: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words of n windows from pos on, joined by one space each, and hashes of the common ones."""
    out, shared, at = [], [], -1
    for r, p, k, s in zip(row.tolist(), pos.tolist(), n.tolist(), skip.tolist(), strict=True):
        if r != at:
            at, part = r, data[offsets[r] : offsets[r + 1]]
            starts, ends, _ = words(part, np.array([0, len(part)]), PLAIN)
            own = [part[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out.append(b" ".join(own[p : p + k + WIDTH - 1]))
        shared.append(xxhash.xxh3_64_intdigest(b" ".join(own[p + s : p + s + WIDTH - PART + 1])))
    return out, np.array(shared, np.uint64)


def equal(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, o: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of each window: its words, compared as text, under one anchor at one place."""
    kinds: dict[tuple, int] = {}
    out = []
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = data[a:b].tobytes()
        starts = [0, *(np.flatnonzero(data[a:b] == 0x20) + 1).tolist(), len(text) + 1]
        for j in range(int(n[r])):
            window = text[starts[j] : starts[j + WIDTH] - 1] if j + WIDTH < len(starts) else (r, j)
            out.append(kinds.setdefault((group[r], o[r] - j, window), len(kinds)))
    return np.array(out, np.int64)


def finish(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    starts, ends, first = words(data, offsets, PLAIN)
    edge = np.zeros(len(starts) + 1, np.int32)
    begin = np.minimum(first[row] + pos, first[row + 1])
    np.add.at(edge, begin, 1)
    np.add.at(edge, np.minimum(begin + n + WIDTH - 1, first[row + 1]), -1)
    gone = np.cumsum(edge[:-1]) > 0
    removed = np.concatenate([[0], np.cumsum(gone)])
    kept = np.flatnonzero(~gone)
    # each kept word and a space behind it
    length = ends[kept] - starts[kept] + 1
    text = np.concatenate([data, [np.uint8(0x20)]])[np.minimum(ranges(starts[kept], length), len(data))] if len(kept) else data[:0]
    stop = np.cumsum(length)
    if len(kept):
        text[stop - 1] = 0x20
    at = np.concatenate([[0], stop])[np.searchsorted(kept, first)]
    hashes = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [pa.array(np.diff(first)), pa.array(removed[first[1:]] - removed[first[:-1]]), pa.array(hashes, pa.string())]


def substring_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    Removed is each word covered by 50 consecutive words that also begin in a document with a smaller doc_id. Only doc_id
    and text are read: further columns, whatever their names, play no part. Null texts have no words; texts under 50 words
    keep all; texts of any length are treated whole; repeats within a document stay. Null ids come before all others.
    Rows of one id with different texts are documents of their own, in order of their texts' hashes; identical rows are
    one document, do not repeat each other, and get equal results. Empty tables give no rows.
    """
    return without_repeats(docs, anchors, texts, equal, True, finish, "n_words long, n_removed long, kept_sha256 string", hot)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))
