"""Ranked lexical search by hashed max-sketches: upper bounds for all documents, exact scores for few.

A document's score for a query is the sum of w * impact over the query's terms, where w is a term's weight in the collection and
impact what its occurrences are worth in this document. A sketch has WIDTH places; a term's hash names its place, and the
document's impacts fold into the maximum of each place. A query looks up the places of its terms and sums w times what it
finds: never less than the score, since a place holds its terms' impacts or more. Lookups of all queries are one matrix product
of a batch's sketches and the queries' weights by place.

Each task reads its documents as a stream and keeps the best TOP of each query. A batch's documents are rescored exactly in
the order of falling bounds, a step at a time, until a bound is below the TOP-th best score so far; those left out can't be
among the best, ties included. Tasks give at most TOP rows for each query, which are merged in two steps, so that no task
has to take the rows of all.

Two passes read the texts: one counts documents, terms, and documents by query term (sums of each task's own counts are all
that is shuffled), the next one searches. Queries are a set of stated size: they are dealt into blocks of about QUERY_BYTES,
which are sent to all tasks, and each block takes the two passes, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decontamination import folded_words
from .shared import raw, read, runs, slices, whole_texts

TOP = 20
#: Places of a sketch, documents rescored at once, bytes of query texts in a block, and groups that merge tasks' rows first.
WIDTH, STEP, QUERY_BYTES, GROUPS = 2048, 64, 8 << 20, 64
#: Fixed values of the score: parts of a million, and of a thousand, and the share of a document's length in it.
MILLI, UNIT, SATURATION, LENGTH = 1000, 1_000_000_000, 12, 25
LEAST = np.iinfo(np.int64).min


@dataclass
class Queries:
    """Terms of a block of queries: hashes of all in order, and for each query which of them it has, and how often."""

    ids: list
    hashes: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @staticmethod
    def of(ids: list, texts: list[str]) -> Queries:
        h, first = hashed(pa.array(texts, pa.large_string()))
        all_terms, at = np.unique(h, return_inverse=True)
        own = [np.unique(at[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
        return Queries(ids, all_terms, [t for t, _ in own], [n for _, n in own])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash among the terms, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


@dataclass
class Collection:
    """What scores need to know of all documents: those with terms, their terms, and documents by query term."""

    documents: int
    terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(MILLI * math.log((2 * self.documents + 2) / (2 * int(n) + 1))) for n in self.df], np.int64)

    def impacts(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Worth of tf occurrences in documents of so many terms."""
        m = 100 - LENGTH + LENGTH * length * self.documents // max(self.terms, 1)
        return UNIT * tf // (MILLI * tf + SATURATION * m)


def hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms (64 bits stand for a term) and where each row's begin."""
    return folded_words(*raw(text))


def tallied(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each row, in order: row, hash, occurrences."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, h = row[order], h[order]
    begins = runs(row, h)
    return row[begins[:-1]], h[begins[:-1]], np.diff(begins)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Parts of batches of bounded bytes (or one row), with their terms."""
    for batch in batches:
        _, offsets = raw(batch.column("text"))
        for i, j in slices(offsets):
            part = batch.slice(i, j - i)
            yield part, hashed(part.column("text"))


def _counts(queries: Queries):
    """Of each task: number -2 has documents with terms, -1 all terms, others documents with that term of the queries."""

    def count(batches):
        documents = terms = 0
        df = np.zeros(len(queries.hashes), np.int64)
        for _, (h, first) in _batches(batches):
            documents += int((np.diff(first) > 0).sum())
            terms += len(h)
            at = queries.find(h)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))[at >= 0]
            pairs = np.unique(row * len(df) + at[at >= 0]) if len(df) else row
            df += np.bincount(pairs % len(df), minlength=len(df)) if len(df) else 0
        found = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(found, [-2, -1])), pa.array(np.append(df[found], [documents, terms]))], ["term", "n"])

    return count


def collection(docs: DataFrame, queries: Queries) -> Collection:
    """Sums of all tasks' counts; the driver gets a number for each term of the queries."""
    df = np.zeros(len(queries.hashes) + 2, np.int64)
    for row in docs.select("text").mapInArrow(_counts(queries), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row["term"]] = row["n"]
    return Collection(int(df[-2]), int(df[-1]), df[:-2])


def sketches(row: np.ndarray, h: np.ndarray, impact: np.ndarray, rows: int, width: int = WIDTH) -> np.ndarray:
    """The greatest impact at each place, a row for each document."""
    out = np.zeros((rows, width), np.int64)
    np.maximum.at(out, (row, (h % np.uint64(width)).astype(np.int64)), impact)
    return out


class Best:
    """The highest scores of each query so far, and their documents; ties by ascending id."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.score, self.doc = [np.zeros(0, np.int64)] * queries, [np.zeros(0, np.int64)] * queries
        self.least = np.ones(queries, np.int64)

    def add(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.append(self.score[q], score[score > 0]), np.append(self.doc[q], doc[score > 0])
        order = np.lexsort((doc, -score))[: self.top]
        self.score[q], self.doc[q] = score[order], doc[order]
        if len(order) == self.top:
            self.least[q] = score[order[-1]]


def _search(queries: Queries, known: Collection, top: int, width: int):
    """Of each task the best documents of each query."""
    weight = known.weights()
    worth = [weight[t] * n for t, n in zip(queries.terms, queries.times)]
    by_place = np.zeros((width, len(queries.ids)))
    for q, (t, x) in enumerate(zip(queries.terms, worth)):
        np.add.at(by_place[:, q], (queries.hashes[t] % np.uint64(width)).astype(np.int64), x)

    def search(batches):
        best = Best(len(queries.ids), top)
        for part, (h, first) in _batches(batches):
            doc = part.column("doc_id")
            doc = np.where(doc.is_null(), LEAST, doc.fill_null(0)) if doc.null_count else doc.to_numpy()
            length = np.diff(first)
            row, term, tf = tallied(h, first)
            impact = known.impacts(tf, length[row])
            bounds = sketches(row, term, impact, len(doc), width).astype(np.float64) @ by_place  # whole numbers below 2 ** 53: exact
            at = queries.find(term)
            key, impact = (row * len(weight) + at)[at >= 0], impact[at >= 0]
            for q in np.flatnonzero((bounds >= best.least).any(0)):
                order = np.argsort(-bounds[:, q], kind="stable")
                for i in range(0, len(order), STEP):
                    few = order[i : i + STEP]
                    few = few[bounds[few, q] >= best.least[q]]
                    if not len(few):
                        break
                    best.add(q, _scores(few, key, impact, len(weight), queries.terms[q], worth[q]), doc[few])
        for q, name in enumerate(queries.ids):
            if n := len(best.doc[q]):
                doc = pa.array(best.doc[q], mask=best.doc[q] == LEAST)
                yield pa.record_batch([pa.array([name] * n, pa.string()), pa.array([q] * n), doc, pa.array(best.score[q])], ["item_id", "query", "doc_id", "score"])

    return search


def _scores(rows: np.ndarray, key: np.ndarray, impact: np.ndarray, width: int, terms: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Exact scores of rows: the sum over the query's terms of their worth times their impact. key: row * width + term, ascending."""
    if not len(key):
        return np.zeros(len(rows), np.int64)
    want = rows[:, None] * width + terms
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return (np.where(key[at] == want, impact[at], 0) * worth).sum(1)


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES, width: int = WIDTH) -> DataFrame:
    """The highest-scoring documents (doc_id, text) of each of items (item_id, text): item_id, rank, doc_id, score.

    Equal scores rank by ascending doc_id, null ids first; rows of one id are documents of their own, and which of them comes
    first is not said where scores are equal too. Null and empty texts have no terms: such documents are never found, such
    items find nothing. Items that repeat id and text count once; items of one id with different texts are ranked each for
    itself. Texts of any length are read whole. Further columns are not read. Empty tables give no rows.
    """
    kind = items.schema["item_id"].dataType
    queries = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, docs = 1 + size // query_bytes, whole_texts(docs)
    found = None
    for block in range(blocks):
        rows = sorted(queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow().to_pylist(), key=lambda r: (r["item_id"] or "", r["text"]))
        asked = Queries.of([r["item_id"] for r in rows], [r["text"] for r in rows])
        known = collection(docs, asked)
        part = docs.mapInArrow(_search(asked, known, top, width), "item_id string, query long, doc_id long, score long").withColumn("block", F.lit(block))
        found = part if found is None else found.unionByName(part)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    group, query = F.spark_partition_id() % GROUPS, ["block", "query"]
    few = found.withColumn("group", group).withColumn("n", F.row_number().over(W.partitionBy(*query, "group").orderBy(*best))).filter(F.col("n") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy(*query).orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
with d as (select row_number() over () as row, doc_id, {_TERMS} as terms from documents),
of_all as (select count(*) as n, sum(len(terms)) as l from d where len(terms) > 0),
tf as (select row, term, count(*) as tf from (select row, unnest(terms) as term from d) t group by row, term),
df as (select term, cast(floor(1000 * ln((2 * any_value(n) + 2)::double / (2 * count(*) + 1))) as bigint) as w from tf, of_all group by term),
m as (select row, doc_id, cast(100 - 25 + ((25 * len(terms)::hugeint * n) // l) as bigint) as m from d, of_all where len(terms) > 0),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) t group by item_id, term),
s as (select item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as score, any_value(doc_id) as doc_id
  from q join tf using (term) join df using (term) join m using (row) group by item_id, row),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from r where rank <= {TOP}
"""
