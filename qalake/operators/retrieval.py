"""Embeddings and retrieval over tables of questions and chunks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qalake.functions.rules import contains_any
from qalake.functions.text import cosine, unit
from qalake.session import stored

from .dictionary import count_terms

TOP_K, MIN_SCORE, WEAK, REFUSE = 7, 0.45, 0.55, 0.45
#: Bytes of questions that are sent to all tasks, and of a block of questions or vectors; pairs of STEP questions and vectors are scored at once.
BROADCAST_BYTES, BLOCK_BYTES, STEP = 64 << 20, 32 << 20, 1000


def embedding_text(topic: Column, code: Column, content: Column) -> Column:
    """Content led by its topic, and the topic by its code."""
    return F.when(topic.isNull(), content).otherwise(F.concat_ws("\n", F.when(code.isNotNull(), F.concat(F.lit("Code "), code, F.lit(": "), topic)).otherwise(topic), content))


def row_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


#: Hex digits of a row's hash that are one summand, and how many a row has.
LIMB, LIMBS = 12, 5


def corpus_hash(rows: DataFrame, key: str, text: str) -> DataFrame:
    """16 hex digits that change with any row and with none's order: sums of the row hashes' parts, and the number of rows.

    Sums are taken map-side, so that a few numbers a task are shuffled, whatever the corpus.
    """
    h = rows.select(row_hash(F.col(key), F.col(text)).alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + LIMB * i, LIMB), 16, 10).cast("decimal(15,0)")
    sums = h.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(25,0)")).alias(f"s{i}") for i in range(LIMBS)])
    return sums.select(F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(LIMBS)]), 256), 1, 16).alias("corpus_hash"))


def embedding_backlog(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents (id, text) whose vector is missing or of another text. stored: id, text_hash."""
    now = documents.select("id", row_hash(F.col("text")).alias("text_hash"))
    return now.join(stored, ["id", "text_hash"], "left_anti")


def embed_batches(texts: DataFrame, max_rows: int = 100, max_tokens: int = 8000, part_rows: int = 50_000) -> DataFrame:
    """text_hash, part, batch: distinct texts in batches of bounded rows and tokens.

    Ranges of hashes are parts, as many as the counted texts need for about part_rows each; a part's texts are read in order of
    their hashes, and a batch ends where the next text would exceed a bound. A task holds an Arrow batch and where the
    last batch began. Texts are cut to the budget by the caller's encoder; one above it is a batch of its own.
    """
    t = texts.select(F.lower("text").alias("text")).distinct().select(
        F.sha2("text", 256).alias("text_hash"),
        F.least(F.floor(F.length("text") / 4) + 1, F.lit(max_tokens)).cast("long").alias("tokens"),
    )
    parts = max(1, -(-t.count() // part_rows))
    t = t.withColumn("part", F.floor(F.conv(F.substring("text_hash", 1, 8), 16, 10).cast("long") * parts / 4294967296).cast("int"))

    def work(batches):
        last, batch, rows, tokens = None, 0, 0, 0
        for table in batches:
            out = []
            for part, more in zip(table.column("part").to_pylist(), table.column("tokens").to_pylist(), strict=True):
                if part != last:
                    last, batch, rows, tokens = part, 0, 0, 0
                elif rows >= max_rows or tokens + more > max_tokens:
                    batch, rows, tokens = batch + 1, 0, 0
                rows, tokens = rows + 1, tokens + more
                out.append(batch)
            yield pa.RecordBatch.from_arrays([table.column("text_hash"), table.column("part"), pa.array(out, pa.int32())], names=["text_hash", "part", "batch"])

    return t.repartition("part").sortWithinPartitions("part", "text_hash").mapInArrow(work, "text_hash string, part int, batch int")


Encoder = Callable[[list[str]], list[list[float]]]
VECTORS = "text_hash string, embedding array<float>"


def embed(batches: DataFrame, encode: Encoder) -> DataFrame:
    """Vectors of batches (text_hash, text, part, batch), one call of a caller's function for each batch.

    A part's batches are read in order, and a call's texts are held until the batch ends: embed_batches bounds them.
    """

    def work(frames):
        held, last = [], None
        for frame in frames:
            for key, rows in frame.groupby(["part", "batch"], sort=False):
                if last not in (None, key):
                    yield called(held)
                    held = []
                last = key
                held.append(rows)
        if held:
            yield called(held)

    def called(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        return pd.DataFrame({"text_hash": rows.text_hash, "embedding": list(encode(rows.text.tolist()))})

    ordered = batches.select("text_hash", "text", "part", "batch").repartition("part").sortWithinPartitions("part", "batch", "text_hash")
    return ordered.mapInPandas(work, VECTORS)


def embed_texts(texts: DataFrame, encode: Encoder, memo: str, model: str, max_rows: int = 100, max_tokens: int = 8000) -> tuple[DataFrame, int]:
    """text_hash, embedding of the distinct texts (text, lower-cased; null: none), and how many of them had to be encoded.

    memo is a table in the shared folder, by model and text hash, that runs share: texts that it has are not encoded again. A
    run writes what it has encoded to a folder of its own, so that runs at the same time do no harm; a text that two of them
    encoded counts once. max_tokens: about four characters each.
    """
    spark = texts.sparkSession
    schema = f"model string, {VECTORS}"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{memo}/run=first")
    read = lambda: spark.read.schema(f"{schema}, run string").parquet(memo).filter(F.col("model") == model).select("text_hash", "embedding").dropDuplicates(["text_hash"])
    wanted = texts.filter("text is not null").select(F.lower("text").alias("text")).distinct().withColumn("text_hash", F.sha2("text", 256))
    missing = stored(wanted.join(read(), "text_hash", "left_anti"), "missing")
    n = missing.count()
    if n:
        batches = embed_batches(missing, max_rows, max_tokens).join(missing, "text_hash")
        embed(batches, encode).select(F.lit(model).alias("model"), "text_hash", "embedding").write.parquet(f"{memo}/run={uuid.uuid4().hex}")
    return wanted.select("text_hash").join(read(), "text_hash"), n


def normalize_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, unit(F.col(column)))


def cosine_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cosine of the vectors that share keys."""
    return a.alias("a").join(b.alias("b"), keys).select(*keys, cosine(F.col("a.embedding"), F.col("b.embedding")).alias("score"))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Unit vectors as rows; zeros for those that are null, of another length, or zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    m = np.zeros((len(column), size))
    fits = length == size
    if fits.any():
        m[fits] = np.nan_to_num(column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class Nearest:
    """The k best vectors seen so far of each question, equal scores by id. Scores are made for STEP x STEP pairs at once."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, floor: float, digits: int, skip_self: bool, t: np.ndarray | None = None):
        self.ids, self.matrix, self.k, self.floor, self.digits, self.skip_self, self.t = ids, matrix, k, floor, digits, skip_self, t
        self.best = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, matrix: np.ndarray, valid: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """valid: from when and until when each vector counts, if questions have a time."""
        for i in range(0, len(self.ids), STEP):
            rows = slice(i, i + STEP)
            for j in range(0, len(ids), STEP):
                part = slice(j, j + STEP)
                self._merge(rows, ids[part], matrix[part], None if valid is None else (valid[0][part], valid[1][part]))

    def _merge(self, rows: slice, ids: np.ndarray, matrix: np.ndarray, valid: tuple | None) -> None:
        scores = np.round(self.matrix[rows] @ matrix.T, self.digits)
        scores[scores < self.floor] = -np.inf
        if valid is not None:
            t = self.t[rows, None]
            scores[(t < valid[0][None, :]) | (t >= valid[1][None, :])] = -np.inf
        if self.skip_self:
            scores[self.ids[rows, None] == ids[None, :]] = -np.inf
        self.merge(rows, ids, scores)

    def merge(self, rows: slice, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some questions (rows) and of all ids; those that don't count are -inf."""
        scores = np.concatenate([self.best[rows], scores], axis=1)
        edge = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k][:, None]
        at, column = np.nonzero((scores >= edge) & np.isfinite(scores))
        found = np.concatenate([self.found[rows], np.broadcast_to(ids, (len(scores), len(ids)))], axis=1)[at, column]
        value = scores[at, column]
        order = np.lexsort((found, -value, at))
        at, found, value = at[order], found[order], value[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        best, own = self.best[rows], self.found[rows]
        best[:], own[:] = -np.inf, np.iinfo(np.int64).max
        best[at[keep], place[keep]], own[at[keep], place[keep]] = value[keep], found[keep]

    def rows(self) -> pa.RecordBatch:
        at, place = np.nonzero(np.isfinite(self.best))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at]), pa.array(self.found[at, place]), pa.array(self.best[at, place])], names=["qid", "id", "score"])


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


FOUND = "qid long, id long, score double"


def _met(k: int, floor: float, digits: int, skip_self: bool, timed: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of questions and one of vectors: the k best of each question. timed: questions have t, vectors t and until."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        size = pc.max(pc.list_value_length(left.column("embedding"))).as_py() or 1 if left.num_rows else 1
        at = lambda table, c: table.column(c).to_numpy() if timed else None
        own = Nearest(left.column("qid").to_numpy(), _matrix(left.column("embedding"), size), k, floor, digits, skip_self, at(left, "t"))
        own.see(right.column("id").to_numpy(), _matrix(right.column("embedding"), size), (at(right, "t"), at(right, "until")) if timed else None)
        return pa.Table.from_batches([own.rows()])

    return meet


def _in_blocks(q: DataFrame, v: DataFrame, keys: list[str], rows: int, meet: Callable) -> DataFrame:
    """meet() for questions and vectors with equal keys; of keys with more than `rows` of either, for all pairs of their blocks.

    The blocks of each key are counted in a table with a row for each key, which joins both sides.
    """
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    shape = blocks(v, "others").join(blocks(q, "parts"), keys)
    deal = lambda df, key, own, name: df.withColumn(name, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
    spread = lambda df, other, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    q = spread(deal(q.join(shape, keys), "qid", "parts", "a"), "others", "b").drop("others", "parts")
    v = spread(deal(v.join(shape, keys), "id", "others", "b"), "parts", "a").drop("others", "parts")
    return q.groupBy(*keys, "a", "b").cogroup(v.groupBy(*keys, "a", "b")).applyInArrow(meet, FOUND)


#: Vectors of a block of the approximate search, about, and questions that a task scores against one at once.
ASIDE, ASKED = 5000, 100


def _size(vectors: DataFrame) -> int:
    """Dimensions of the first vector."""
    first = vectors.filter("embedding is not null").select(F.size("embedding")).first()
    return max(first[0], 1) if first else 1


def knn_topk(
    questions: DataFrame, vectors: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE, digits: int = 6, skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """qid, id, score, rank: for each question (qid, embedding) the k nearest vectors (id, embedding) by cosine.

    Questions of up to broadcast_bytes (counted before) go to every task as one matrix. A task keeps the k best of each question
    while it reads its vectors, and makes at most STEP x STEP scores at once; what is shuffled is k rows for each question
    and task. More questions never meet in one place: both sides are dealt into blocks of about block_bytes, and each pair
    of blocks is multiplied by a task of its own. skip_self: a vector with the question's id is no neighbour.
    """
    spark = questions.sparkSession
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "embedding")
    questions = questions.select(F.col("qid").cast("long").alias("qid"), "embedding")
    n, size = questions.count(), _size(questions)
    if n * size * 8 <= broadcast_bytes:
        own = questions.toArrow()
        shared = spark.sparkContext.broadcast((own.column("qid").to_numpy(), _matrix(own.column("embedding"), size)))

        def work(batches):
            ids, matrix = shared.value
            nearest = Nearest(ids, matrix, k, min_score, digits, skip_self)
            for batch in batches:
                nearest.see(batch.column("id").to_numpy(), _matrix(batch.column("embedding"), size))
            yield nearest.rows()

        return _rank(vectors.mapInArrow(work, FOUND), k)
    rows = max(1, block_bytes // (size * 8))
    parts, others = -(-n // rows), max(1, -(-vectors.count() // rows))
    q = questions.withColumn("a", F.pmod(F.xxhash64("qid"), F.lit(parts))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    v = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(others)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return _rank(q.groupBy("a", "b").cogroup(v.groupBy("a", "b")).applyInArrow(_met(k, min_score, digits, skip_self), FOUND), k)


def sample_of(vectors: DataFrame, most: int = 20_000) -> np.ndarray:
    """Unit vectors of a bounded sample (the first by a hash of the id), in the order of that hash."""
    own = vectors.filter("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(most).select("embedding").toArrow()
    return _matrix(own.column("embedding"), _size(vectors))


def centres(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit vectors in the middle of cells, by rounds of spherical k-means on a sample."""
    if not len(sample):
        return np.ones((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    middle = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        cell = np.argmax(sample @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, cell, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(norm > 0, sums / np.maximum(norm, 1e-12), middle)
    return middle


@dataclass
class Codes:
    """An index of vectors: the centres of its cells, and words for each part of a vector; a vector's code names a word for each part."""

    middle: np.ndarray
    words: list[np.ndarray]
    cuts: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, cells: int, parts: int = 16, words: int = 256, rounds: int = 10, seed: int = 5) -> Codes:
        """Words by k-means on each part of the sample's vectors."""
        size = sample.shape[1]
        cuts = np.linspace(0, size, min(parts, size) + 1).astype(int)
        rng, books = np.random.default_rng(seed), []
        for low, high in zip(cuts[:-1], cuts[1:]):
            x = sample[:, low:high] if len(sample) else np.zeros((1, high - low))
            book = x[rng.choice(len(x), min(words, len(x)), replace=False)]
            for _ in range(rounds):
                own = Codes.nearest(x, book)
                sums, n = np.zeros_like(book), np.bincount(own, minlength=len(book))[:, None]
                np.add.at(sums, own, x)
                book = np.where(n > 0, sums / np.maximum(n, 1), book)
            books.append(book)
        return Codes(centres(sample, cells), books, cuts)

    @staticmethod
    def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.argmax(x @ book.T - (book**2).sum(1) / 2, axis=1)

    def encode(self, m: np.ndarray) -> np.ndarray:
        """A byte for each part."""
        own = [self.nearest(m[:, low:high], book) for low, high, book in zip(self.cuts[:-1], self.cuts[1:], self.words)]
        return np.stack(own, axis=1).astype(np.uint8)

    def scores(self, questions: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Cosines of questions and coded vectors, nearly: sums of the parts' products, which are looked up."""
        out = np.zeros((len(questions), len(codes)), np.float32)
        for i, (low, high, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.words)):
            out += (questions[:, low:high] @ book.T).astype(np.float32)[:, codes[:, i]]
        return out

    def cells(self, m: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(m @ self.middle.T), axis=1, kind="stable")[:, :n].astype(np.int32)

    def tuned(self, sample: np.ndarray, k: int, recall: float, most: float, questions: int = 200) -> tuple[int, float, float]:
        """Probes and the share of vectors to rescore that find `recall` of the k nearest of the sample's first vectors; what they found.

        Both are doubled until they do, the share up to `most`: a share of the sample stands for a share of all vectors.
        """
        asked, n = sample[:questions], len(sample)
        if n <= k + 1:
            return len(self.middle), most, 1.0
        exact = asked @ sample.T
        near = self.scores(asked, self.encode(sample))
        own = (np.arange(len(asked)), np.arange(len(asked)))
        exact[own], near[own] = -np.inf, -np.inf
        want = np.argpartition(-exact, k, axis=1)[:, :k]
        home, order, found = self.cells(sample, 1)[:, 0], self.cells(asked, len(self.middle)), 0.0
        shares = [s for s in (0.005, 0.01, 0.02, 0.05, most) if s <= most]
        probes = 1
        while True:
            probes = min(probes, len(self.middle))
            seen = (order[:, :probes, None] == home[None, None, :]).any(1) if probes < len(self.middle) else np.ones_like(near, bool)
            value = np.where(seen, near, -np.inf)
            place = np.argsort(np.argsort(-value, axis=1, kind="stable"), axis=1, kind="stable")
            for share in shares:
                hit = (np.take_along_axis(place, want, 1) < max(k, share * n)) & np.take_along_axis(seen, want, 1)
                found = float(hit.mean())
                if found >= recall:
                    return probes, share, found
            if probes == len(self.middle):
                return probes, most, found
            probes *= 2


def _coded(codes: Codes, k: int, floor: float, probes: int, share: float, skip_self: bool) -> Callable:
    """Of questions (qid, matrix) and a block of vectors: codes choose a share of the block for each question, whose exact cosines give its k best."""

    def meet(nearest: Nearest, right: pa.Table) -> None:
        right = right.take(pc.sort_indices(right.column("id")))  # so that reruns agree
        ids, m = right.column("id").to_numpy(), _matrix(right.column("embedding"), codes.middle.shape[1])
        code, home = codes.encode(m), codes.cells(m, 1)[:, 0]
        few = min(len(ids), max(k + 1, int(share * len(ids))))  # one may be the question itself
        for i in range(0, len(nearest.ids), ASKED):
            rows = slice(i, i + ASKED)
            asked = nearest.matrix[rows]
            near = codes.scores(asked, code)
            if probes < len(codes.middle):
                seen = np.zeros((len(asked), len(codes.middle)), bool)
                np.put_along_axis(seen, codes.cells(asked, probes).astype(np.int64), True, axis=1)
                near[~seen[:, home]] = -np.inf
            best = np.argpartition(-near, few - 1, axis=1)[:, :few]
            score = np.full(near.shape, -np.inf)
            exact = np.round(np.einsum("ik,ijk->ij", asked, m[best]), nearest.digits)
            exact[~np.isfinite(np.take_along_axis(near, best, 1)) | (exact < floor)] = -np.inf
            if skip_self:
                exact[nearest.ids[rows, None] == ids[best]] = -np.inf
            np.put_along_axis(score, best, exact, axis=1)
            nearest.merge(rows, ids, score)

    return meet


def knn_approx(
    questions: DataFrame, vectors: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE, target: float = 0.95, most: float = 0.1, skip_self: bool = False, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, dict]:
    """The rows of knn_topk, nearly, and how they were looked for: cells, probes, share (of vectors rescored), found (recall on the sample).

    An inverted file of product-quantised codes. A vector is in the cell of its nearest centre, as many cells as the root of the
    number of vectors, and is coded in a byte for each of 16 parts. A question looks its cosines up by code in its `probes` nearest
    cells, and the best of them, at most a `most`-th of all vectors, are rescored by their exact cosines. Probes and share are
    the least that reach halfway from `target` to 1 on the sample that cells and codes are fitted on; all vectors are indexed.

    Vectors are dealt by a hash of their id into blocks of about ASIDE rows, each a fair sample of all, and a question takes its
    share of each block: what it rescores never leaves the task, and what is shuffled are the vectors, once, and k rows for
    each question and block. Questions of more than BROADCAST_BYTES meet the blocks in blocks of their own, as in knn_topk.
    """
    spark = questions.sparkSession
    questions = questions.select(F.col("qid").cast("long").alias("qid"), "embedding")
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "embedding")
    n, sample = vectors.count(), sample_of(vectors)
    codes = Codes.fit(sample, max(1, math.isqrt(n)))
    probes, share, found = codes.tuned(sample, k, (1 + target) / 2, most)  # halfway to all: the sample's recall is not that of all vectors
    size, asked_rows = codes.middle.shape[1], questions.count()
    others = max(1, n // ASIDE)
    shared = spark.sparkContext.broadcast(codes)
    how = {"cells": len(codes.middle), "probes": probes, "share": max(k, int(share * n)) / max(n, 1), "found": found}
    make = lambda ids, matrix: Nearest(ids, matrix, k, min_score, 6, skip_self)
    if asked_rows * size * 8 <= BROADCAST_BYTES:
        own = questions.toArrow()
        asked = spark.sparkContext.broadcast((own.column("qid").to_numpy(), _matrix(own.column("embedding"), size)))

        def work(batches):
            nearest, held = make(*asked.value), list(batches)  # a block, of about ASIDE rows
            if held:
                _coded(shared.value, k, min_score, probes, share, skip_self)(nearest, pa.Table.from_batches(held))
            yield nearest.rows()

        return _rank(vectors.repartition(others, "id").mapInArrow(work, FOUND), k), how
    rows = max(1, block_bytes // (size * 8))
    parts, others = -(-asked_rows // rows), max(1, -(-n // rows))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        nearest = make(left.column("qid").to_numpy(), _matrix(left.column("embedding"), size))
        fair = np.random.default_rng(1).permutation(right.num_rows)
        right = right.take(pc.sort_indices(right.column("id"))).take(pa.array(fair))
        for i in range(0, right.num_rows, ASIDE):
            _coded(shared.value, k, min_score, probes, share, skip_self)(nearest, right.slice(i, ASIDE))
        return pa.Table.from_batches([nearest.rows()])

    q = questions.withColumn("a", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    v = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(others)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return _rank(q.groupBy("a", "b").cogroup(v.groupBy("a", "b")).applyInArrow(meet, FOUND), k), how


#: What rounding may take off a cosine or an angle; pairs of rows and cells that a task holds at once; cells that a question goes to, on average.
SLACK, PAIRS, SENT = 1e-5, 1 << 17, 4


def _few_rows(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of as many rows as make PAIRS with all cells: a question may go to each of them, vector and all."""
    rows = max(1, PAIRS // cells)
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def knn_in_cells(questions: DataFrame, vectors: DataFrame, k: int, min_score: float, skip_self: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """qid, id, score, rank: the k nearest vectors (id, embedding, stretch, t, until) with t <= a question's t < until, exactly.

    questions: qid, embedding, stretch, t. An as-of join: both sides meet by stretch of time and by cell. A vector is in the cell of
    its nearest centre, and a cell has a radius, the largest angle of a vector of it. A question goes to each cell that can hold a
    cosine of min_score or more: its angle to the centre, less the radius, is no larger than min_score's own. So cells only leave
    out what can't be found, and the higher the threshold, the more; centres come from a bounded sample, which results don't
    depend on. Cells are as many as the root of the number of vectors; a vector may come once for each stretch. Where cells are so
    wide that a sample of questions would go to more than SENT or half of them on average, there are fewer, down to one:
    then questions are not repeated, and each pair of a stretch is scored.
    """
    one = vectors.select("id", "embedding")
    sample, asked, cells = sample_of(one), sample_of(questions.select(F.col("qid").alias("id"), "embedding"), 2000), max(1, math.isqrt(vectors.count()))
    size = sample.shape[1]
    asked = asked if asked.shape[1] == size else np.zeros((0, size))
    angle = lambda cosine: np.arccos(np.clip(cosine, -1, 1))
    most = float(angle(min_score))

    def placed(matrix, middle):
        near = matrix @ middle.T
        cell = np.argmax(near, axis=1) if len(near) else np.zeros(0, np.int64)
        return cell, angle(near[np.arange(len(near)), cell])

    def place(batches):
        for batch in _few_rows(batches, len(middle)):
            cell, away = placed(_matrix(batch.column("embedding"), size), middle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    def wide():
        return cells > 1 and len(asked) and (angle(asked @ middle.T) - radius <= most + SLACK).sum() > min(SENT, cells / 2) * len(asked)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    while True:
        middle = centres(sample, cells)
        cells, radius = len(middle), np.full(len(middle), -np.inf if min_score > 0 else np.inf)  # vectors of no length have a cosine of 0 with all
        np.maximum.at(radius, *placed(sample, middle))
        if not wide():  # by the sample; then by all vectors
            v = stored(vectors.mapInArrow(place, f"{kind}, cell int, away double"), "cells")
            for row in v.groupBy("cell").agg(F.max("away").alias("away")).collect():  # a row for each cell
                radius[row["cell"]] = max(radius[row["cell"]], row["away"])
            if not wide():
                break
        cells = max(1, cells // 4)

    def probe(batches):
        for batch in _few_rows(batches, len(middle)):
            away = angle(_matrix(batch.column("embedding"), size) @ middle.T)
            at, cell = np.nonzero(away - radius <= most + SLACK)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in questions.schema)
    q = questions.mapInArrow(probe, f"{kind}, cell int")
    met = _met(k, min_score, 6, skip_self, timed=True)
    found = _in_blocks(q, v.drop("away"), ["stretch", "cell"], max(1, block_bytes // (size * 8)), met)
    return _rank(found, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours found, by question."""
    hit = exact.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def retrieval_quality(questions: DataFrame, retrieved: DataFrame, weak: float = WEAK, refuse: float = REFUSE) -> DataFrame:
    """Scores by question (qid), also of those without results: weak, and to be refused."""
    seen = retrieved.groupBy("qid").agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.count("*").alias("n"))
    q = questions.select("qid").join(seen, "qid", "left")
    return q.select(
        "qid", "best", "worst", F.round(F.col("best") - F.col("worst"), 6).alias("spread"), F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("best").isNull() | (F.col("best") < weak)).alias("weak"), (F.col("best").isNull() | (F.col("best") < refuse)).alias("refuse"),
    )


def hyde_vectors(questions: DataFrame) -> DataFrame:
    """The vector of a generated text where there is one (hyde), else the question's own."""
    return questions.select("qid", F.coalesce("hyde", "embedding").alias("embedding"))


def score_floor_search(found: DataFrame, chunks: DataFrame, floor: float = 0.005, keep: int = 8) -> DataFrame:
    """Of each question's hits above a floor, the first `keep` that have text in one of three fields."""
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text", "content", "preview")])
    hits = found.filter(F.col("score") > floor).join(chunks, "id").select("qid", "id", "score", "rank", text.alias("body")).filter("body is not null")
    w = W.partitionBy("qid").orderBy("rank")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)


def chunk_sources(retrieved: DataFrame) -> DataFrame:
    """Distinct sources of an answer, in the order in which they first come."""
    w = W.partitionBy("qid", "source").orderBy("rank")
    first = retrieved.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return first.select("qid", "source", "rank", F.coalesce("subtopic", "heading").alias("section"), F.row_number().over(W.partitionBy("qid").orderBy("rank")).alias("place"))


def pack_context(retrieved: DataFrame, budget: int = 8000, most: int = 1500, frame: int = 100, least: int = 200) -> DataFrame:
    """qid, rank, taken: characters of each ranked chunk (text) that go into the context.

    A chunk may have min(most, what is left - frame) characters; below `least` nothing more goes in. What a chunk takes
    depends on all before it, so that a fold over the question's few chunks decides.
    """
    lists = retrieved.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.length("text").alias("chars")))).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.expr("cast(array() as array<struct<rank:int,taken:int>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        room = F.least(F.lit(most), F.lit(budget) - s["used"] - frame)
        stop = s["full"] | (room < least)
        taken = F.least(x["chars"], room)
        out = F.concat(s["out"], F.array(F.struct(x["rank"].alias("rank"), taken.alias("taken"))))
        return F.struct(F.when(stop, s["used"]).otherwise(s["used"] + taken + frame).alias("used"), stop.alias("full"), F.when(stop, s["out"]).otherwise(out).alias("out"))

    return lists.select("qid", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("x")).select("qid", "x.rank", "x.taken")


def recent_history(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, of these the user's and the assistant's."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    return last.filter(F.col("role").isin("user", "assistant")).drop("back")


def term_search(chunks: DataFrame, terms: DataFrame, samples: int = 5) -> DataFrame:
    """term, n, sample_ids: for each term (term) that is in a chunk's content or topic, whatever the case, their number and the first ids.

    Terms are a table of any size; tasks count them by slices of chunks.
    """
    text = F.lower(F.concat_ws("\n", "content", "topic"))
    low = terms.select("term", F.lower("term").alias("low")).distinct()
    found = count_terms(chunks.select("entry_id", text.alias("text")), low.select(F.col("low").alias("term")), "entry_id", samples).withColumnRenamed("term", "low")
    return found.join(low, "low").select("term", "n", F.array_join(F.transform("firsts", lambda x: x.cast("string")), ",").alias("sample_ids"))


def retrieval_probe(questions: DataFrame, vectors: DataFrame, k: int = 10, floor: float = 0.3, skip_self: bool = False) -> DataFrame:
    """Neighbours with labels against what was expected (expected in questions, label in vectors)."""
    found = knn_topk(questions, vectors, k, floor, skip_self=skip_self)
    return found.join(questions.select("qid", "expected"), "qid").join(vectors.select("id", "label"), "id").select(
        "qid",
        "rank",
        "id",
        "score",
        "expected",
        "label",
        (F.col("label") == F.col("expected")).alias("hit"),
    )


def low_confidence_report(quality: DataFrame, questions: DataFrame, retrieved: DataFrame, specific: list[str], gap: float = 0.45, top: int = 5) -> DataFrame:
    """One row for each weak question: its chunks, features and what may help."""
    chunks = retrieved.filter(F.col("rank") <= top).groupBy("qid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")),
            ",",
        ).alias("chunk_ids")
    )
    q = quality.filter("weak").join(questions, "qid").join(chunks, "qid", "left")
    specifics = contains_any(F.lower("question"), specific)
    words = F.size(F.filter(F.split("question", r"\s+"), lambda w: w != ""))
    advice = F.array_join(
        F.filter(
            F.array(
                F.when(F.coalesce("best", F.lit(0.0)) < gap, "add_content"),
                F.when(words <= 3, "ask_for_detail"),
                F.when(specifics, "check_terms"),
            ),
            lambda x: x.isNotNull(),
        ),
        ",",
    )
    return q.select(
        "qid",
        "best",
        F.coalesce("chunk_ids", F.lit("")).alias("chunk_ids"),
        words.alias("n_words"),
        specifics.alias("asks_specific"),
        (F.coalesce("best", F.lit(0.0)) < gap).alias("possible_gap"),
        advice.alias("advice"),
    )

