"""Windows that repeat an earlier one: what suffix-array dedup and substring dedup have in common.

Each document's windows (of so many bytes or words) are cut into segments, runs of windows with a common anchor. An
anchor is chosen by the window's content alone, so that equal windows have equal anchors at equal places; segments are
some tens of windows long. Segments, not windows, are shuffled:

1. rows (anchor, content hash, document, place) are dealt by anchor and sorted. A segment equal to an earlier one
   repeats as a whole. An anchor with a single content is done; that is nearly all of the corpus.
2. Segments of an anchor with several contents (the ends of passages, edited copies) get their text by a join and are
   cut into parts of a few windows. A part is dealt by anchor and by what all its possible windows have in common, so
   that a line in a third of all documents, with other text around it each time, goes to many tasks; equal parts of a
   task meet before. The windows of parts that come together are compared; each method does that in its way.
3. The windows found are gathered by document and joined to the text.

Repeats within a task meet before the shuffle, so that of a passage with a third of all rows a task sends one row for
each batch of documents. An anchor that has many contents in a batch (a line with other text around it each time) has
several contents for certain: its rows are dealt by anchor and content, and two of them by anchor as well, so that all
rows of the anchor elsewhere learn of it; step 2 then compares them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, mix, numbered, ranges, raw, runs, slices, whole_groups

SEGMENT = "h long, s long, doc long, pos long, o int, n int"
NAMES = ["h", "s", "doc", "pos", "o", "n"]
#: Segments of a batch that are compared before they are sent.
HELD = 300_000
WHOLE = -1  # o of rows whose windows are known to repeat
#: Contents of an anchor in one batch from which on it is hot: its segments are dealt by content too.
HOT = 16
HOT_MARK = 1 << 16  # added to o of such rows
RUN = 256  # n of a segment that follows itself r times more is its windows + r * RUN; a segment has fewer windows


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    types = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int32]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t, copy=False)) for c, t in zip(columns, types, strict=True)], names=NAMES)


def _differs(doc, pos, first_doc, first_pos, across: bool) -> np.ndarray:
    """Is the first one earlier? across: only in another document."""
    return doc != first_doc if across else (doc != first_doc) | (pos != first_pos)


def _windows(n: np.ndarray) -> np.ndarray:
    return (n % RUN) * (n // RUN + 1)


def _one_by_one(h, s, doc, pos, o, n) -> tuple[np.ndarray, ...]:
    """Segments that follow themselves, each by itself."""
    times = n // RUN + 1
    h, s, doc, pos, o, n = (np.repeat(x, times) for x in (h, s, doc, pos, o, n % RUN))
    return h, s, doc, pos + ranges(np.zeros(len(times), np.int64), times) * n, o, n


def _known(doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows for windows that are known to repeat; neighbours become one."""
    order = np.lexsort((pos, doc))
    doc, pos, n = doc[order], pos[order], n[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n, at) if len(at) else n
    spread = doc[at] * np.int64(0x9E3779B97F4A7C1) ^ pos[at]
    return _rows(spread, np.zeros(len(at)), doc[at], pos[at], np.full(len(at), WHOLE), total)


def segments(anchors: Callable, across: bool, hot: int = HOT) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """anchors(data, offsets) yields (row, h, s, pos, o, n) as arrays."""

    def send(parts):
        doc, h, s, pos, o, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        if across:  # a word or phrase said over and over: one row, since a document's own repeats share their fate
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(h)))
            doc, h, s, pos, o, n = doc[at], h[at], s[at], pos[at], o[at], n[at] + RUN * (times - 1)
        order = np.lexsort((pos, doc, s, h))
        doc, h, s, pos, o, n = (x[order] for x in (doc, h, s, pos, o, n))
        at = runs(h, s)
        first = np.repeat(at[:-1], np.diff(at))
        again = _differs(doc, pos, doc[first], pos[first], across)
        if again.any():
            yield _known(doc[again], pos[again], _windows(n[again]))
        h, s, doc, pos, o, n = (x[~again] for x in (h, s, doc, pos, o, n))
        at = runs(h, s)[:-1]
        group = runs(h[at])
        many = np.diff(group) >= hot
        if many.any():
            marked = np.isin(h, h[at[group[:-1][many]]])
            twice = np.concatenate([at[group[:-1][many]], at[group[:-1][many] + 1]])
            yield _rows(*(x[twice] for x in (h, s, doc, pos, o, n)))
            o = o + HOT_MARK * marked
        yield _rows(h, s, doc, pos, o, n)

    def work(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            data, offsets = raw(batch.column("text"))
            held, count = [], 0
            for row, h, s, pos, o, n in anchors(data, offsets):
                held.append((ids[row], h.view(np.int64), s.view(np.int64), pos, o, n))
                count += len(h)
                if count >= HELD:
                    yield from send(held)
                    held, count = [], 0
            if count:
                yield from send(held)

    return work


def settle(across: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From segments sorted by h, s, doc, pos: rows that repeat as a whole (o = WHOLE), and those of anchors with several contents.

    State is one row and what of the last anchor is still undecided.
    """

    def work(batches):
        last = None  # h, s, doc, pos of the first row of the last content
        several = False  # has the last anchor more than one content?
        waiting: list[np.ndarray] = []
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in NAMES])
            if (known := x[4] == WHOLE).any():
                yield _rows(*x[:, known])
                x = x[:, ~known]
            if not x.shape[1]:
                continue
            lead = 0 if last is None else 1
            if lead:
                x = np.concatenate([np.array([*last, 0, 0], np.int64)[:, None], x], axis=1)
            h, s, doc, pos = x[:4]
            at = runs(h, s)
            first = np.repeat(at[:-1], np.diff(at))
            again = _differs(doc, pos, doc[first], pos[first], across)
            if lead:
                again[0] = False
            if again.any():
                yield _known(doc[again], pos[again], _windows(x[5][again]))
            group = runs(h)
            contents = np.searchsorted(at[:-1], group[1:]) - np.searchsorted(at[:-1], group[:-1])
            many = contents > 1
            if lead and several:
                many[0] = True
            if lead and waiting and many[0]:
                yield _rows(*_one_by_one(*np.concatenate(waiting, axis=1)))
            if not lead or many[0] or len(group) > 2:
                waiting = []
            known_hot = x[4] >= HOT_MARK
            x[4] -= HOT_MARK * known_hot
            many_row = np.repeat(many, np.diff(group)) | known_hot
            fresh = ~again
            if lead:
                fresh[0] = False
            if (out := fresh & many_row).any():
                yield _rows(*_one_by_one(*x[:, out]))
            several = bool(many[-1])
            if not several:
                tail = np.zeros(len(h), bool)
                tail[group[-2] :] = True
                if (rest := fresh & tail & ~known_hot).any():
                    waiting.append(x[:, rest])
            last = x[:4, first[-1]].copy()

    return work


#: Places of the anchor that one part's windows may have.
PART = 8


def parts(o: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments by the anchor's place in the window: segment, windows left out before, place in the first window, windows, block of places."""
    high, low = o // PART, (o - n + 1) // PART
    row = np.repeat(np.arange(len(o)), high - low + 1)
    block = high[row] - ranges(np.zeros(len(o), np.int64), high - low + 1)
    first, last = np.minimum(o[row], block * PART + PART - 1), np.maximum((o - n + 1)[row], block * PART)
    return row, o[row] - first, first, first - last + 1, block


def _cut_out(texts: Callable, across: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows h, doc, pos, o, n, seg for parts of segments; parts equal to an earlier one of the task are known at once (o = WHOLE).

    texts(data, offsets, row, pos, n, skip) gives the parts' bytes, and hashes of what stands in all windows that such a
    part may have: it begins skip units behind the first window's begin and is PART - 1 units shorter than a window.
    """

    def send(key, doc, pos, o, n, seg):
        seen: dict[tuple, int] = {}
        order = np.lexsort((pos, doc))
        first = np.empty(len(order), np.int64)
        for i, k, a, b in zip(order.tolist(), key[order].tolist(), o[order].tolist(), n[order].tolist(), strict=True):
            first[i] = seen.setdefault((k, a, b, seg[i]), i)
        again = _differs(doc, pos, doc[first], pos[first], across)
        none = lambda k: pa.array([None] * k, pa.binary())
        if again.any():
            known = _known(doc[again], pos[again], n[again])
            yield pa.RecordBatch.from_arrays([*(known.column(c) for c in ("h", "doc", "pos", "o", "n")), none(known.num_rows)], names=CUT)
        keep = np.flatnonzero(~again)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key[keep]),
                pa.array(doc[keep]),
                pa.array(pos[keep]),
                pa.array(o[keep].astype(np.int32)),
                pa.array(n[keep].astype(np.int32)),
                pa.array([seg[i] for i in keep.tolist()], pa.binary()),
            ],
            names=CUT,
        )

    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            lists = batch.column("segs")
            count = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            h, pos, o, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            row = np.repeat(np.arange(len(count)), count)
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for i in range(0, len(h), 10_000):
                k = slice(i, i + 10_000)
                part, before, first, many, block = parts(o[k], n[k])
                own, at = row[k][part], pos[k][part] + before
                seg, shared = texts(data, offsets, own, at, many, first - block * PART)
                key = mix(h[k][part].view(np.uint64) ^ mix(shared + block.astype(np.uint64))).view(np.int64)
                yield from send(key, docs[own], at, first, many, seg)

    return work


CUT = ["h", "doc", "pos", "o", "n", "seg"]


def _compare(equal: Callable, across: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """equal(seg bytes, offsets, group, o, n) gives each window's class, windows in order of rows."""

    def open_parts(batches, known):
        for batch in batches:
            whole = pc.equal(batch.column("o"), WHOLE)
            if pc.any(whole).as_py():
                known.append(batch.filter(whole))
            yield batch.filter(pc.invert(whole))

    def work(batches):
        known: list[pa.RecordBatch] = []
        for table in whole_groups(open_parts(batches, known), "h", 8_000):
            while known:
                yield _rows(*(known[-1].column(c).to_numpy(zero_copy_only=False) for c in ("h", "h", "doc", "pos", "o", "n")))
                known.pop()
            doc, pos, o, n = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "pos", "o", "n"))
            at = runs(table.column("h").to_numpy())
            group = np.repeat(np.arange(len(at) - 1), np.diff(at))
            data, offsets = raw(table.column("seg"))
            kind = equal(data, offsets, group, o, n)
            row, j = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
            wdoc, wpos = doc[row], pos[row] + j
            order = np.lexsort((wpos, wdoc, kind))
            bounds = runs(kind[order])
            first = np.empty(len(order), np.int64)
            first[order] = np.repeat(order[bounds[:-1]], np.diff(bounds))
            again = _differs(wdoc, wpos, wdoc[first], wpos[first], across)
            if again.any():
                yield _known(wdoc[again], wpos[again], np.ones(int(again.sum()), np.int64))
        for batch in known:
            yield _rows(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "h", "doc", "pos", "o", "n")))

    return work


def repeated_windows(docs: DataFrame, anchors: Callable, texts: Callable, equal: Callable, across: bool, hot: int = HOT) -> DataFrame:
    """doc, spans: array of (pos, n), the windows (n from pos on) that also begin earlier. docs: doc, text."""
    rows = docs.mapInArrow(segments(anchors, across, hot), SEGMENT)
    found = rows.repartition(F.when(F.col("o") >= HOT_MARK, F.xxhash64("h", "s")).otherwise(F.col("h"))).sortWithinPartitions("h", "s", "doc", "pos").mapInArrow(settle(across), SEGMENT)
    found = cut(found, "segments")
    known = found.filter(F.col("o") == WHOLE).select("doc", "pos", "n")
    # the segments of one document: no more than it has windows
    several = found.filter(F.col("o") != WHOLE).groupBy("doc").agg(F.collect_list(F.struct("h", "pos", "o", "n")).alias("segs"))
    several = docs.join(several.hint("shuffle_hash"), "doc").select("doc", "text", "segs")
    several = several.mapInArrow(_cut_out(texts, across), "h long, doc long, pos long, o int, n int, seg binary")
    more = several.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(equal, across), SEGMENT).select("doc", "pos", "n")
    return known.unionByName(more).groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))


def without_repeats(docs: DataFrame, anchors: Callable, texts: Callable, equal: Callable, across: bool, finish: Callable, schema: str, hot: int = HOT) -> DataFrame:
    """finish(data, offsets, row, pos, n) gives the result columns, after doc_id, as Arrow arrays."""
    numbers, repeated = numbered(docs)
    # the same in both joins, never null (so that no join adds a filter): texts are shuffled once
    rows = numbers.select(F.coalesce("doc", F.lit(0).cast("long")).alias("doc"), "text")
    spans = repeated_windows(rows, anchors, texts, equal, across, hot)
    joined = rows.join(spans.hint("shuffle_hash"), "doc", "left").select("doc", "text", F.coalesce("spans", F.array().cast("array<struct<pos:bigint,n:int>>")).alias("spans"))
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            lists = batch.column("spans")
            count = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            pos, n = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(count)])
            for i, j in slices(offsets):
                k = slice(begin[i], begin[j])
                out = finish(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.repeat(np.arange(j - i), count[i:j]), pos[k], n[k])
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(i, j - i), *out], names=["doc", *names])

    out = joined.mapInArrow(work, f"doc long, {schema}")
    if not repeated:  # numbers are ids
        return out.withColumnRenamed("doc", "doc_id")
    return out.join(numbers.select("doc", "doc_id").distinct(), "doc").select("doc_id", *names)
