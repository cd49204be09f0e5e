"""Answer reuse: joins between a question table and a table of stored answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalake.functions.text import query_hash
from qalake.functions.times import micros

from .maintenance import snapshot_upsert
from .retrieval import knn_in_cells

THRESHOLD, TTL_HOURS, MOST = 0.92, 24, 1000


def _stretches(questions: DataFrame, answers: DataFrame, hours: int) -> tuple[DataFrame, DataFrame]:
    """Both with t (and until) in microseconds and a stretch of so many hours: a question's own, and each that an answer is valid in."""
    width = hours * 3_600_000_000
    at = lambda c: F.floor(c / width).cast("long")
    q = questions.withColumn("t", micros("ts")).withColumn("stretch", at(F.col("t")))
    a = answers.filter(F.col("created_at") < F.col("expires_at")).withColumn("t", micros("created_at")).withColumn("until", micros("expires_at"))
    return q, a.withColumn("stretch", F.explode(F.sequence(at(F.col("t")), at(F.col("until") - 1))))


def latest_valid(questions: DataFrame, answers: DataFrame, key: str, hours: int = 6) -> DataFrame:
    """qid, answer_id: of the answers (key, answer_id, created_at, expires_at) with a question's key (key, qid, ts) that were
    there and had not expired when it was asked, the latest; of equal times the one with the largest id.

    Both sides are one table, ordered by key, stretch of time and time, and read once: the task carries the answers that may
    still be wanted, the latest on top. One that expires before a later one does is never wanted again, so that the pile stays
    short, and with one time to live it is a single answer. A key that is asked all the time is as many keys as there are
    stretches; its rows are never paired with each other.
    """
    q, a = _stretches(questions.filter(F.col(key).isNotNull()), answers.filter(F.col(key).isNotNull()), hours)
    none = F.lit(None).cast("long")
    rows = a.select(key, "stretch", "t", F.lit(0).alias("role"), F.col("answer_id").cast("long").alias("id"), "until").unionByName(q.select(key, "stretch", "t", F.lit(1).alias("role"), F.col("qid").cast("long").alias("id"), none.alias("until")))
    ordered = rows.repartition(key, "stretch").sortWithinPartitions(key, "stretch", "t", "role", "id")
    return ordered.select(key, "stretch", "t", "id", "until").mapInArrow(_carried(key), "qid long, answer_id long")


def _carried(key: str):
    def work(batches):
        last, pile = None, []
        for batch in batches:
            own = pa.chunked_array([batch.column(key)]).dictionary_encode().combine_chunks()
            names, out = own.dictionary.to_pylist(), ([], [])
            columns = [own.indices.to_pylist(), *(batch.column(c).to_pylist() for c in ("stretch", "t", "id", "until"))]
            for code, stretch, t, row, until in zip(*columns, strict=True):
                if (names[code], stretch) != last:
                    last, pile = (names[code], stretch), []
                if until is None:
                    while pile and pile[-1][1] <= t:  # has expired, for all later questions too
                        pile.pop()
                    if pile:
                        out[0].append(row)
                        out[1].append(pile[-1][0])
                else:
                    while pile and pile[-1][1] <= until:
                        pile.pop()
                    pile.append((row, until))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["qid", "answer_id"])

    return work


def exact_reuse(questions: DataFrame, answers: DataFrame, hours: int = 6) -> DataFrame:
    """qid, answer_id: the latest answer with the question's hash that was there and had not expired when it was asked.

    An answer that expires at that moment has expired.
    """
    return latest_valid(questions.select("qid", "ts", query_hash(F.col("question")).alias("query_hash")), answers, "query_hash", hours)


def semantic_reuse(questions: DataFrame, answers: DataFrame, threshold: float = THRESHOLD, hours: int = 6, skip_self: bool = False) -> DataFrame:
    """qid, answer_id, similarity: the nearest answer (answer_id, embedding, created_at, expires_at) that was valid when the question
    (qid, ts, embedding) was asked, if its cosine is the threshold or more; of equal ones the least id. Exact: see knn_in_cells.
    """
    q, a = _stretches(questions.select("qid", "ts", "embedding"), answers.select(F.col("answer_id").alias("id"), "embedding", "created_at", "expires_at"), hours)
    found = knn_in_cells(q.select("qid", "embedding", "stretch", "t"), a.select("id", "embedding", "stretch", "t", "until"), 1, threshold, skip_self)
    return found.select("qid", F.col("id").alias("answer_id"), F.col("score").alias("similarity"))


def require_topic_overlap(hits: DataFrame, asked: DataFrame, answered: DataFrame) -> DataFrame:
    """hits (qid, answer_id, ...) whose question and answer share a topic, or whose question has none.

    asked: qid, topic_id; answered: answer_id, topic_id. Near vectors of different topics are what reuse goes wrong by. Hits are
    read once: they may have cost a search.
    """
    topics = lambda df, key, name: df.groupBy(key).agg(F.collect_set("topic_id").alias(name))
    both = hits.join(topics(asked, "qid", "__asked"), "qid", "left").join(topics(answered, "answer_id", "__answered"), "answer_id", "left")
    return both.filter(F.col("__asked").isNull() | F.arrays_overlap("__asked", "__answered")).select(*hits.columns)


def topic_answers(asked: DataFrame, answers: DataFrame, hours: int = 24) -> DataFrame:
    """qid, answer_id: the latest valid answer (topic_id, answer_id, created_at, expires_at) of any of a question's topics (topic_id, qid, ts)."""
    found = latest_valid(asked, answers, "topic_id", hours)
    times = answers.select("answer_id", "created_at").distinct()
    return found.join(times, "answer_id").groupBy("qid").agg(F.max_by("answer_id", F.struct("created_at", "answer_id")).alias("answer_id"))


def topic_reuse(enhanced: DataFrame) -> DataFrame:
    """qid, answer_id: the first of the graph's matches."""
    return enhanced.filter("rank = 1").select("qid", F.col("id").alias("answer_id"))


def resolve_reuse(questions: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """qid, cache_type, answer_id, similarity: the first tier (name, hits) that has an answer, else miss.

    Hits: qid, answer_id and, for semantic ones, similarity. Callers give later tiers the questions that earlier ones left
    (`unanswered`), so that costly tiers see few.
    """
    out = questions.select("qid")
    for i, (_, hits) in enumerate(tiers):
        similarity = F.col("similarity") if "similarity" in hits.columns else F.lit(None).cast("double")
        out = out.join(hits.select("qid", F.col("answer_id").alias(f"a{i}"), similarity.alias(f"s{i}")), "qid", "left")
    kind = F.coalesce(*[F.when(F.col(f"a{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(tiers)], F.lit("miss"))
    score = F.coalesce(*[F.when(F.col(f"a{i}").isNotNull(), F.coalesce(f"s{i}", F.lit(1.0 if name != "topic" else None).cast("double"))) for i, (name, _) in enumerate(tiers)])
    return out.select("qid", kind.alias("cache_type"), F.coalesce(*[f"a{i}" for i in range(len(tiers))]).alias("answer_id"), F.when(kind != "topic", score).alias("similarity"))


def unanswered(questions: DataFrame, *hits: DataFrame) -> DataFrame:
    for h in hits:
        questions = questions.join(h.select("qid"), "qid", "left_anti")
    return questions


def put_answers(stored: DataFrame, new: DataFrame, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Stored answers with new ones (query_hash, response, created_at) added or refreshed."""
    rows = new.withColumn("expires_at", F.col("created_at") + F.expr(f"interval {int(ttl_hours)} hours")).withColumn("hit_count", F.lit(0))
    return snapshot_upsert(stored, rows, ["query_hash"])


def hit_counters(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Answers with their hits (answer_id, ts) counted in."""
    n = hits.groupBy("answer_id").agg(F.count("*").alias("more"), F.max("ts").alias("last"))
    out = answers.join(n, "answer_id", "left")
    return out.withColumn("hit_count", F.col("hit_count") + F.coalesce("more", F.lit(0))).withColumn("last_hit_at", F.greatest("last_hit_at", "last")).drop("more", "last")


def valid_at(answers: DataFrame, as_of: str) -> DataFrame:
    return answers.filter(F.col("expires_at") > F.lit(as_of).cast("timestamp"))


def warm_set(answers: DataFrame, as_of: str, n: int = MOST) -> DataFrame:
    return valid_at(answers, as_of).orderBy(F.desc("hit_count"), F.desc("created_at"), "answer_id").limit(n)


def evict_answers(answers: DataFrame, as_of: str, n: int = MOST) -> DataFrame:
    """Without expired ones, the n best by hits and age: a global top-k, not one ordered partition."""
    return warm_set(answers, as_of, n)


def invalidate_on_change(rows: DataFrame, old_hash: DataFrame, new_hash: DataFrame) -> DataFrame:
    """Rows if the corpus (one-row tables with corpus_hash) is the same, else none."""
    same = old_hash.join(new_hash, "corpus_hash", "left_semi").select(F.lit(1).alias("__same"))
    return rows.crossJoin(F.broadcast(same.limit(1))).drop("__same")  # one row or none


def reuse_metrics(resolved: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("cache_type") == kind)
    table = resolved.agg(F.count("*").alias("total"), n("exact").alias("exact"), n("semantic").alias("semantic"), n("database").alias("stored"), n("topic").alias("topic"), n("miss").alias("misses"))
    return table.withColumn("hit_rate", F.when(F.col("total") > 0, F.round((F.col("total") - F.col("misses")) / F.col("total"), 4)).otherwise(F.lit(0.0)))


def ttl_dedup(questions: DataFrame, hours: int = TTL_HOURS) -> DataFrame:
    """Rows (key, qid, ts) with kept: the first of a key opens a window of fixed length; those in it are repeats.

    A window's begin depends on the one before, so that a key's rows are read in order of time, once, by one task, which
    remembers the key and when its window began: no list of a key's rows is made, however many it has.
    """
    rows = questions.select("key", F.col("qid").cast("long").alias("qid"), micros("ts").alias("t"))
    span = hours * 3_600_000_000

    def work(batches):
        last, opened = None, 0
        for batch in batches:
            t = batch.column("t").to_numpy()
            own = pa.chunked_array([batch.column("key")]).dictionary_encode().combine_chunks()
            code = own.indices.fill_null(-1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(t) else np.zeros(0, np.int64)
            kept = np.zeros(len(t), bool)
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(t)], strict=True):
                key = (batch.column("key")[i].as_py(),)
                at = i if key != last else i + int(np.searchsorted(t[i:j], opened + span))
                last = key
                while at < j:  # a step for each window
                    kept[at], opened = True, int(t[at])
                    at = i + int(np.searchsorted(t[i:j], opened + span))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("qid"), pa.array(kept)], names=["key", "qid", "kept"])

    kind = questions.schema["key"].dataType.simpleString()
    return rows.repartition("key").sortWithinPartitions("key", "t", "qid").mapInArrow(work, f"key {kind}, qid long, kept boolean")
