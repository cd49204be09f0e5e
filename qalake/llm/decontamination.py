"""Benchmark decontamination by winnowing.

Fingerprints: of each sliding window of W = N - K + 1 consecutive K-gram hashes the least is kept, so that any N words in
common have a fingerprint in common. Documents' fingerprints are matched with the benchmark's, and each hit is extended to
the windows of N words around it, which are compared word by word (by 64-bit word hashes, all N of them). Items of fewer
than N words are one window; for each such length L all L-grams are fingerprints (K = L, W = 1).

A benchmark of a checked size (INDEX_WORDS) is sent to the tasks, and no document is shuffled; a larger one is joined, by
fingerprint first and by window then, as tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FOLDED, LOWER, cut, grams, hash_words, ranges, raw, read, signed, sliding_min, slices, text_tie, whole_texts, words

N, K = 13, 5
#: Benchmark words that are sent to tasks (about 130 bytes each: a window's hash and its words' hashes); above it the tables are joined.
INDEX_WORDS = 1_000_000
OUT = "doc_id long, tie long, n_words long, n_hit long, n_items long, items_sha256 string"


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the number of each row's first word."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, FOLDED)
    return hash_words(data, starts, ends), first


def inside_rows(n: int, first: np.ndarray, k: int) -> np.ndarray:
    """For each of n k-grams: does it stay in its row?"""
    start = np.arange(n)
    return start + k <= first[np.searchsorted(first, start, side="right")]


def fingerprints(h: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are the least of some n words' k-grams (the leftmost of equals), row by row."""
    g = grams(h, k)
    w = n - k + 1
    if len(g) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = inside_rows(len(g) - w + 1, first, n)
    least = sliding_min(g, w)
    # the leftmost place of the least: the first of equal values from each window's start on
    keep = np.zeros(len(g), bool)
    todo = np.flatnonzero(whole)
    for step in range(w):
        hit = g[todo + step] == least[todo]
        keep[todo[hit] + step] = True
        todo = todo[~hit]
    places = np.flatnonzero(keep)
    return places, g[places]


class Index:
    """Windows of the benchmark: their words, the items that hold them, and the fingerprints, for each window length."""

    def __init__(self, texts: list[str | None], items: list):
        data, offsets = raw(pa.array([t or "" for t in texts], pa.large_string()))
        h, first = folded_words(data, offsets)
        names = ["" if i is None else str(i) for i in items]
        self.lengths: dict[int, tuple] = {}
        count = np.diff(first)
        for n in sorted({min(N, int(c)) for c in count if c}):
            rows = np.flatnonzero(count >= N if n == N else count == n)
            at = ranges(first[rows], count[rows] - n + 1)
            owner = np.repeat(rows, count[rows] - n + 1)
            window = grams(h, n)[at]
            content = h[at[:, None] + np.arange(n)]
            order = np.lexsort((*content.T[::-1], window))
            at, window, content, owner = at[order], window[order], content[order], owner[order]
            # a window that several items hold is one, with all their names
            new = np.ones(len(at), bool)
            new[1:] = (content[1:] != content[:-1]).any(axis=1)
            number = np.cumsum(new) - 1
            holders: list[set[int]] = [set() for _ in range(int(new.sum()))]
            for place, item in zip(number.tolist(), owner.tolist(), strict=True):
                holders[place].add(item)
            window, content = window[new], content[new]
            k = K if n == N else n
            own = np.zeros(len(first), np.int64)
            sub = np.concatenate([h[first[r] : first[r + 1]] for r in rows])
            own = np.concatenate([[0], np.cumsum(count[rows])])
            _, prints = fingerprints(sub, own, n, k)
            # items with the same windows share one set
            known: dict[frozenset, frozenset] = {}
            sets = [frozenset(names[i] for i in x) for x in holders]
            self.lengths[n] = (k, np.unique(prints), window, content, [known.setdefault(x, x) for x in sets])

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(places, n, window numbers): the windows of n words at places are equal to the index's windows."""
        for n, (k, prints, window, content, _) in self.lengths.items():
            places, got = fingerprints(h, first, n, k)
            at = np.searchsorted(prints, got)
            at[at == len(prints)] = 0
            places = places[prints[at] == got]
            if not len(places):
                continue
            near = np.unique((places[:, None] - np.arange(n - k + 1)).ravel())
            near = near[(near >= 0) & (near + n <= len(h))]
            near = near[inside_rows(len(h), first, n)[near]]
            g = grams(h, n)[near]
            low, high = np.searchsorted(window, g, "left"), np.searchsorted(window, g, "right")
            place, number = np.repeat(near, high - low), ranges(low, high - low)
            same = (h[place[:, None] + np.arange(n)] == content[number]).all(axis=1)
            yield place[same], n, number[same]


def digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


NONE = digest(set())


def _by_index(index):
    def judge(batches):
        found = index.value
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            count, hit, many, sha = [], [], [], []
            for i, j in slices(offsets):
                h, first = folded_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cover = np.zeros(len(h) + 1, np.int32)
                groups: dict[int, dict[int, frozenset]] = {}  # each row's sets of names, once each
                for places, n, numbers in found.hits(h, first):
                    np.add.at(cover, places, 1)
                    np.add.at(cover, places + n, -1)
                    names = found.lengths[n][4]
                    for row, number in set(zip((np.searchsorted(first, places, "right") - 1).tolist(), numbers.tolist(), strict=True)):
                        groups.setdefault(row, {})[id(names[number])] = names[number]
                items = {row: set().union(*own.values()) for row, own in groups.items()}
                covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
                count.append(np.diff(first))
                hit.append(covered[first[1:]] - covered[first[:-1]])
                many += [len(items.get(r, ())) for r in range(j - i)]
                sha += [digest(items[r]) if r in items else NONE for r in range(j - i)]
            if many:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("tie"),
                        pa.array(np.concatenate(count)),
                        pa.array(np.concatenate(hit)),
                        pa.array(many, pa.int64()),
                        pa.array(sha),
                    ],
                    names=["doc_id", "tie", "n_words", "n_hit", "n_items", "items_sha256"],
                )

    return judge


def _prints(lengths: list[int]):
    """Rows (doc_id, tie, n, fp) of a table's fingerprints."""

    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            ids, ties = batch.column("doc_id"), batch.column("tie")
            for i, j in slices(offsets):
                h, first = folded_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for n in lengths:
                    places, got = fingerprints(h, first, n, K if n == N else n)
                    rows = pa.array(i + np.searchsorted(first, places, "right") - 1)
                    yield pa.RecordBatch.from_arrays([ids.take(rows), ties.take(rows), pa.array(np.full(len(got), n, np.int32)), pa.array(signed(got))], names=["doc_id", "tie", "n", "fp"])

    return work


def _windows(lengths: list[int], whole_only: bool):
    """Rows (doc_id, tie, n, place, a, b) of all windows, named by two hashes; whole_only: rows under N words are one window."""

    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            ids, ties = batch.column("doc_id"), batch.column("tie")
            for i, j in slices(offsets):
                h, first = folded_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                g2 = h ^ np.uint64(0xD6E8FEB86659FD93)
                for n in lengths:
                    a, b = grams(h, n), grams(g2, n)
                    places = np.flatnonzero(inside_rows(len(a), first, n))
                    rows = np.searchsorted(first, places, "right") - 1
                    if whole_only and n < N:
                        fits = np.diff(first)[rows] == n
                        places, rows = places[fits], rows[fits]
                    take = pa.array(i + rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(take),
                            ties.take(take),
                            pa.array(np.full(len(places), n, np.int32)),
                            pa.array(places - first[rows]),
                            pa.array(signed(a[places])),
                            pa.array(signed(b[places])),
                        ],
                        names=["doc_id", "tie", "n", "place", "a", "b"],
                    )

    return work


def _count_words(batches):
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        count = [np.diff(folded_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1]) for i, j in slices(offsets)]
        if count:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(np.concatenate(count))], names=["doc_id", "tie", "n_words"])


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same result by joins of fingerprints and windows, for a benchmark of any size."""
    lengths = [r[0] for r in items.groupBy(F.least("n", F.lit(N)).cast("int").alias("n")).count().collect() if r[0]]  # at most N rows
    items = items.withColumn("tie", F.lit(0).cast("long")).select(F.col("item").alias("doc_id"), "text", "tie", "n")
    counts = docs.mapInArrow(_count_words, "doc_id long, tie long, n_words long").distinct()
    if lengths:
        prints = [items.filter(F.col("n") >= N if n == N else F.col("n") == n).drop("n").mapInArrow(_prints([n]), "doc_id string, tie long, n int, fp long") for n in lengths]
        wanted = prints[0]
        for p in prints[1:]:
            wanted = wanted.unionByName(p)
        near = docs.mapInArrow(_prints(lengths), "doc_id long, tie long, n int, fp long").join(wanted.select("n", "fp").distinct(), ["n", "fp"], "left_semi")
        near = cut(near.select("doc_id", "tie").distinct(), "near")
        own = _match(docs.dropDuplicates(["doc_id", "tie"]), near)
        ours = own.mapInArrow(_windows(lengths, False), "doc_id long, tie long, n int, place long, a long, b long")
        theirs = items.drop("n").mapInArrow(_windows(lengths, True), "doc_id string, tie long, n int, place long, a long, b long").select(F.col("doc_id").alias("item"), "n", "a", "b").distinct()
        met = cut(ours.join(theirs, ["n", "a", "b"]), "met")
        spans = met.select("doc_id", "tie", F.explode(F.sequence("place", F.col("place") + F.col("n") - 1)).alias("word")).distinct().groupBy("doc_id", "tie").agg(F.count("*").alias("n_hit"))
        names = met.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set("item")).alias("items"))
        hits = _match(spans, names)
    else:
        hits = docs.sparkSession.createDataFrame([], "doc_id long, tie long, n_hit long, items array<string>")
    out = _match(docs.select("doc_id", "tie"), counts)
    out = _match(out, hits, "left")
    items_sha = F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256)
    return out.select(
        "doc_id",
        "tie",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        items_sha.alias("items_sha256"),
    )


def _match(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by document and the hash of its text; null ids are ids."""
    right = right.withColumnsRenamed({"doc_id": "right_id", "tie": "right_tie"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("right_id")) & (F.col("tie") == F.col("right_tie")), how).drop("right_id", "right_tie")


def decontaminate(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, tie (the text's hash), n_words, n_hit, n_items, items_sha256, contaminated.

    Only doc_id, item_id and text are read: further columns, whatever their names, play no part. Null and empty texts have
    no words and are not contaminated; texts of any length are read whole. Items without words are never found; items with
    equal text are all found; null item ids count as the empty id, and an id that occurs in several rows is one name.
    Rows that repeat an id are judged by their own text, repeated rows give repeated results, null ids are kept. A share
    of exactly 5 % is contaminated. Empty tables give no rows; an empty benchmark contaminates nothing.
    """
    docs = whole_texts(docs).withColumn("tie", text_tie(F.col("text")))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    length = F.length("text")
    if (items.agg(F.sum(length)).first()[0] or 0) <= 2 * index_words:  # a word and what parts it from the next: two characters at least
        rows = items.collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([r.text for r in rows], [r.item for r in rows]))
        out = docs.mapInArrow(_by_index(index), OUT)
    else:
        counted = items.withColumnRenamed("item", "doc_id").withColumn("tie", F.lit(0).cast("long"))
        n = counted.mapInArrow(_count_words, "doc_id string, tie long, n_words long").select(F.col("doc_id").alias("item"), F.col("n_words").alias("n")).distinct()
        out = _by_join(docs, items.join(n, "item"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("tie")


#: Brute force: all windows of all documents against all windows of the benchmark.
ORACLE = """
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select item_id, least(13, len(w)) as n, unnest(list_transform(range(1, cast(greatest(len(w) - 12, 1) as bigint) + 1), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) as win from b where len(w) > 0),
lens as (select distinct n from bw),
dw as (select doc_id, n, unnest(range(1, cast(len(w) - n + 1 as bigint) + 1)) as i, w from d, lens where len(w) >= n),
hits as (select doc_id, i, dw.n as n, item_id from dw join bw on bw.n = dw.n and bw.win = array_to_string(list_slice(w, i, i + dw.n - 1), ' ')),
cover as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
names as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
from d left join cover on cover.doc_id = d.doc_id left join names on names.doc_id = d.doc_id
"""
