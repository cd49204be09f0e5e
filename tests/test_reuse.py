"""Reuse of answers as of a question's time, against plain loops over all pairs."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from qalake.operators import reuse

T0 = datetime(2024, 1, 1)
Q, A = "key string, qid long, ts timestamp", "key string, answer_id long, created_at timestamp, expires_at timestamp"


def at(hours):
    return T0 + timedelta(hours=hours)


def log(seed, n, keys, lives):
    """Times in whole hours, so that questions, answers and expiries often fall together."""
    rng = random.Random(seed)
    key = lambda: rng.choice([f"k{i}" for i in range(keys)] + [None])
    asked = [(key(), i, at(rng.randrange(60))) for i in range(n)]
    stored = [(key(), i, b, b + timedelta(hours=rng.choice(lives))) for i in range(n) for b in [at(rng.randrange(-5, 60))]]
    return asked, stored


@pytest.mark.parametrize("seed,keys,lives", [(1, 1, [6]), (2, 3, [0, 1, 5, 30]), (3, 20, [2, 24])])
def test_latest_valid_answer(spark, seed, keys, lives):
    asked, stored = log(seed, 150, keys, lives)
    want = {}
    for key, qid, ts in asked:
        valid = [(b, i) for k, i, b, e in stored if k is not None and k == key and b <= ts < e]
        if valid:
            want[qid] = max(valid)[1]
    for hours in (6, 1):
        got = reuse.latest_valid(spark.createDataFrame(asked, Q).repartition(3), spark.createDataFrame(stored, A), "key", hours)
        assert {r.qid: r.answer_id for r in got.collect()} == want and got.count() == len(want)


def test_a_hot_question_is_no_pairing(spark):
    """40,000 questions and as many answers of one key in one stretch: 1.6e9 pairs, if they were made."""
    n = 40_000
    q = spark.range(n).selectExpr("'k' as key", "id as qid", "timestamp_micros(1704067200000000 + id * 100000) as ts")
    a = spark.range(n).selectExpr("'k' as key", "id as answer_id", "timestamp_micros(1704067200000000 + id * 100000) as created_at").selectExpr("*", "created_at + interval 6 hours as expires_at")
    got = reuse.latest_valid(q, a, "key").filter("qid = answer_id")
    assert got.count() == n


@pytest.mark.parametrize("threshold,block", [(0.9, None), (0.3, None), (0.3, 300), (-0.2, 400)])
def test_nearest_valid_answer(spark, threshold, block, monkeypatch):
    from qalake.operators import retrieval

    rng = np.random.default_rng(3)
    heads = rng.normal(size=(6, 8))
    made = lambda n: np.vstack([heads[rng.integers(6)] + rng.normal(size=8) * 0.3 for _ in range(n)]).astype(np.float32)
    qs, vs = made(60), made(200)
    vs[7], vs[8], qs[3] = 0, vs[9], 0
    times = rng.integers(0, 40, 260)
    lives = rng.choice([1, 6, 20], 200)
    q = [(i, at(int(t)), v.tolist()) for i, (t, v) in enumerate(zip(times[:60], qs))]
    a = [(i, v.tolist(), at(int(t)), at(int(t) + int(d))) for i, (t, v, d) in enumerate(zip(times[60:], vs, lives))]
    unit = lambda m: m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-30)
    score = np.round(unit(qs) @ unit(vs).T, 6)
    want = {}
    for i in range(60):
        valid = [(-score[i, j], j) for j in range(200) if a[j][2] <= q[i][1] < a[j][3] and score[i, j] >= threshold]
        if valid:
            want[i] = min(valid)[1]
    if block:
        monkeypatch.setattr(retrieval.knn_in_cells, "__defaults__", (False, block))
    asked, stored = spark.createDataFrame(q, "qid long, ts timestamp, embedding array<float>"), spark.createDataFrame(a, "answer_id long, embedding array<float>, created_at timestamp, expires_at timestamp")
    got = {r.qid: r.answer_id for r in reuse.semantic_reuse(asked, stored, threshold).collect()}
    assert got == want and len(want) > 5


def test_hits_need_a_common_topic(spark):
    hits = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.8), (3, 11, 0.7), (4, 12, 0.6)], "qid long, answer_id long, similarity double")
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (4, 1)], "qid long, topic_id int")
    answered = spark.createDataFrame([(10, 1), (10, 2), (11, 3)], "answer_id long, topic_id int")
    assert sorted(r.qid for r in reuse.require_topic_overlap(hits, asked, answered).collect()) == [1, 3]


def test_topic_answers_take_the_latest_of_all_topics(spark):
    asked = spark.createDataFrame([(1, 7, at(5)), (2, 7, at(5)), (2, 8, at(5))], "topic_id int, qid long, ts timestamp")
    kept = spark.createDataFrame([(1, 100, at(1), at(20)), (2, 101, at(3), at(4)), (2, 102, at(2), at(20)), (3, 103, at(4), at(20))], "topic_id int, answer_id long, created_at timestamp, expires_at timestamp")
    assert [tuple(r) for r in reuse.topic_answers(asked, kept).orderBy("qid").collect()] == [(7, 102), (8, 102)]


def test_wide_cells_do_not_repeat_questions(spark, monkeypatch):
    """Vectors in all directions: by cells each question would go to nearly all of them; a few close groups keep their cells."""
    from qalake.operators import retrieval

    seen, in_blocks = [], retrieval._in_blocks
    monkeypatch.setattr(retrieval, "_in_blocks", lambda q, v, *rest: seen.append((q.count(), v.select("cell").distinct().count())) or in_blocks(q, v, *rest))
    rng = np.random.default_rng(5)
    heads = np.eye(16)[:8]
    for m, threshold in ((rng.normal(size=(900, 16)), 0.25), (np.repeat(heads, 100, axis=0) + rng.normal(size=(800, 16)) * 0.01, 0.9)):
        m = m.astype(np.float32)
        q = spark.createDataFrame([(i, at(i % 40), v.tolist()) for i, v in enumerate(m)], "qid long, ts timestamp, embedding array<float>")
        a = spark.createDataFrame([(i, v.tolist(), at(i % 37), at(i % 37 + 6)) for i, v in enumerate(m)], "answer_id long, embedding array<float>, created_at timestamp, expires_at timestamp")
        unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
        score = np.round(unit @ unit.T, 6)
        asked, made = np.arange(len(m))[:, None] % 40, np.arange(len(m))[None, :] % 37
        score[(made > asked) | (asked >= made + 6) | (score < threshold)] = -1
        want = {i: int(np.argmax(row)) for i, row in enumerate(score) if row.max() > 0}
        assert {r.qid: r.answer_id for r in reuse.semantic_reuse(q, a, threshold).collect()} == want
    assert seen[0] == (900, 1) and seen[1][0] <= 800 * 4 and seen[1][1] > 4, seen


def test_topics_are_compared_in_one_reading_of_the_hits(spark):
    hits = spark.createDataFrame([(1, 10, 0.9), (1, 10, 0.9), (2, 11, 0.8), (3, 12, 0.7), (4, 10, 0.6)], "qid long, answer_id long, similarity double")
    read = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    asked = spark.createDataFrame([(1, 1), (1, 1), (2, None), (4, 2)], "qid long, topic_id int")
    answered = spark.createDataFrame([(10, 1), (10, 3), (11, None)], "answer_id long, topic_id int")
    got = reuse.require_topic_overlap(hits.mapInArrow(work, hits.schema), asked, answered)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, 0.9), (1, 10, 0.9), (3, 12, 0.7)] and read.value == 5


def test_topic_overlap_asks_all_questions(spark):
    from __spark_entry__ import oracle_sql, queries

    from .oracle import DATA

    assert "% 20" not in oracle_sql()["topic_overlap"]
    assert any(r.qid % 20 for r in queries()["topic_overlap"](spark, DATA).collect())
