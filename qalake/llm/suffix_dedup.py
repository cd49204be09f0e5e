"""Suffix-array dedup of byte strings by deep-shallow sorting.

The suffixes that can begin a repeated string are found first (see repeats.py: an anchor is the least hash of 32 bytes
among a window's, so that equal windows have the same). Segments that are equal as a whole, by two 64-bit hashes, settle
without a sort, as most repeats do; the suffixes of the others are sorted by deep-shallow sorting: multikey quicksort, eight bytes as one character, down to a shallow depth; the groups
that still have a common prefix there are ordered by blind tries, which look at a suffix only where a group branches.
Suffixes that agree in 100 bytes end in one leaf; all but its first are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .repeats import HOT, PART, without_repeats
from .shared import MASK64, SLICE_BYTES, eights, mix, ranges, read, runs, sliding_min, slices

#: Bytes of a string, of a hashed gram, and of the prefix that quicksort orders.
WIDTH, GRAM, SHALLOW = 100, 32, 24
PLACE_BITS = 21
PLACES = np.uint64((1 << PLACE_BITS) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes from each place on."""
    at, n = eights(data), len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, 0x2545F4914F6CDD1D, np.uint64)
    for k in range(0, GRAM, 8):
        h ^= at[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return mix(h)


def pieces(offsets: np.ndarray, width: int, limit: int = SLICE_BYTES):
    """(first row, row begins in bytes, place of the first byte in its document): rows together, or a long one in overlapping parts."""
    for i, j in slices(offsets, limit):
        if offsets[j] - offsets[i] <= limit or j - i > 1:
            yield i, offsets[i : j + 1], 0
            continue
        for begin in range(int(offsets[i]), max(int(offsets[j]) - width + 1, int(offsets[i]) + 1), limit):
            yield i, np.array([begin, min(begin + limit + width - 1, int(offsets[j]))]), begin - int(offsets[i])


def anchors(data: np.ndarray, offsets: np.ndarray):
    for i, bounds, base in pieces(offsets, WIDTH):
        part, own = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        windows = np.maximum(np.diff(own) - WIDTH + 1, 0)
        if not windows.sum():
            continue
        g = gram_hashes(part)
        key = (g & ~PLACES) | np.arange(len(g), dtype=np.uint64)
        least = (sliding_min(key, WIDTH - GRAM + 1) & PLACES).astype(np.int64)
        p, row = ranges(own[:-1], windows), np.repeat(np.arange(len(windows)), windows)
        q = least[p]
        at = runs(row, q)
        p0, n, q, row = p[at[:-1]], np.diff(at), q[at[:-1]], row[at[:-1]]
        end = p0 + n + WIDTH - 1
        s = ((q - p0) * 256 + n).astype(np.uint64)
        for place in (p0, p0 + 32, p0 + 64, np.minimum(p0 + 96, end - 32), np.maximum(end - 64, p0), end - 32):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + g[place])
        yield i + row, g[q], s, base + p0 - own[row], q - p0, n


def texts(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray, skip: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The bytes of n windows from pos on, and hashes of the common ones. Shorter rows (of a repeated id) give what they have."""
    begin = np.minimum(offsets[row] + pos, offsets[row + 1])
    end = np.minimum(begin + n + WIDTH - 1, offsets[row + 1])
    out = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    shared = [xxhash.xxh3_64_intdigest(t[k : k + WIDTH - PART + 1]) for t, k in zip(out, skip.tolist(), strict=True)]
    return out, np.array(shared, np.uint64)


def deep_shallow(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of data (WIDTH bytes of each count) within their groups, and each place's class of equals, rising."""
    at = eights(np.concatenate([data, np.zeros(WIDTH + 8, np.uint8)]))
    order = np.argsort(group, kind="stable")
    kind = np.zeros(len(order), np.int64)
    bounds = runs(group[order])
    kind = np.repeat(bounds[:-1], np.diff(bounds))  # a class is named by its first place
    for depth in range(0, SHALLOW, 8):
        size = np.bincount(kind, minlength=len(kind))[kind]
        live = np.flatnonzero(size > 1)
        if not len(live):
            return order, kind
        character = at[start[order[live]] + depth].byteswap()
        rank = np.lexsort((character, kind[live]))
        order[live], character = order[live][rank], character[rank]
        new = runs(kind[live], character)
        kind[live] = np.repeat(live[new[:-1]], np.diff(new))
    done = np.zeros(len(kind), bool)
    words = list(range(SHALLOW, WIDTH - 8 + 1, 8))
    tail = np.uint64(MASK64 >> (8 * (8 - (WIDTH - SHALLOW) % 8))) if (WIDTH - SHALLOW) % 8 else None
    while True:
        size = np.bincount(kind, minlength=len(kind))[kind]
        live = np.flatnonzero((size > 1) & ~done)
        if not len(live):
            return order, kind
        here, first = start[order[live]], start[order[kind[live]]]
        # where each suffix leaves its group's first one
        branch = np.full(len(live), WIDTH, np.int64)
        open_ = np.arange(len(live))
        for depth in [*words, *([words[-1] + 8] if tail is not None else [])]:
            differ = at[here[open_] + depth] ^ at[first[open_] + depth]
            if tail is not None and depth > words[-1]:
                differ &= tail
            hit = np.flatnonzero(differ)
            if len(hit):
                low = differ[hit] & (~differ[hit] + np.uint64(1))
                branch[open_[hit]] = depth + np.log2(low.astype(np.float64)).astype(np.int64) // 8
                open_ = np.delete(open_, hit)
            if not len(open_):
                break
        bounds = runs(kind[live])
        node = np.repeat(np.minimum.reduceat(branch, bounds[:-1]), np.diff(bounds))
        leaf = node == WIDTH
        done[live[leaf]] = True
        live, node, here = live[~leaf], node[~leaf], here[~leaf]
        if not len(live):
            continue
        character = data[np.minimum(here + node, len(data) - 1)].astype(np.int64)
        rank = np.lexsort((character, kind[live]))
        order[live], character = order[live][rank], character[rank]
        new = runs(kind[live], character)
        kind[live] = np.repeat(live[new[:-1]], np.diff(new))


def equal(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, o: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of each window. Windows can only be equal with one anchor at one place of theirs."""
    row, j = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
    order, kind = deep_shallow(data, np.minimum(offsets[row] + j, len(data)), group[row] * (2 * WIDTH) + (o[row] - j))
    out = np.empty(len(order), np.int64)
    out[order] = kind
    return out


def finish(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    edge = np.zeros(len(data) + 1, np.int32)
    begin = np.minimum(offsets[row] + pos, offsets[row + 1])
    end = np.minimum(begin + n + WIDTH - 1, offsets[row + 1])
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    rises = gone.copy()
    rises[1:] &= ~gone[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    rises[inner] = gone[inner]
    removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, rises))
    hashes = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        kept = data[a:b][~gone[a:b]] if removed[b] > removed[a] else data[a:b]
        hashes.append(hashlib.sha256(kept).hexdigest())
    return [pa.array(np.diff(offsets)), pa.array(removed[offsets[1:]] - removed[offsets[:-1]]), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array(hashes, pa.string())]


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (lower-case hex of what remains).

    Removed is each byte covered by a string of 100 bytes that also begins earlier: in a smaller doc_id, or earlier in
    the same document. Only doc_id and text are read: further columns, whatever their names, play no part. Null texts are
    empty; texts under 100 bytes keep all; texts of any length are treated whole. Null ids come before all others. Rows of
    one id with different texts are documents of their own, in order of their texts' hashes; identical rows are one
    document, do not repeat each other, and get equal results. Empty tables give no rows.
    """
    return without_repeats(docs, anchors, texts, equal, False, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))
