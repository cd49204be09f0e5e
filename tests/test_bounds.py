"""What a task holds or sends does not grow faster than its input."""

import numpy as np

from qalake.operators import graph, retrieval


def test_rare_entities_stay_rare_in_large_tables(spark):
    """300,000 edges; entities of 60 questions each: a join on them would make 60 pairs for each edge, and more in larger tables."""
    edges = spark.range(300_000).selectExpr("id as qid", "id div 60 as entity_id").unionByName(spark.range(41).selectExpr("id as qid", "-1L as entity_id")).unionByName(spark.range(40).selectExpr("id as qid", "-2L as entity_id"))
    got = {r.entity_id for r in graph.frequent_entities(edges).select("entity_id").collect()}
    assert got == {*range(5000), -1}


def test_a_question_for_all_cells_is_dealt_in_pieces():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(np.arange(10_000))], ["qid"])
    pieces = list(retrieval._few_rows([batch], 1000))
    assert max(p.num_rows for p in pieces) * 1000 <= retrieval.PAIRS and sum(p.num_rows for p in pieces) == 10_000
    assert [p.num_rows for p in retrieval._few_rows([batch.slice(0, 2)], 10**9)] == [1, 1]


def test_rescored_vectors_are_not_joined(spark, monkeypatch):
    """What a question rescores, a tenth of all vectors, stays in the task; both ways find what is near."""
    m = np.random.default_rng(8).normal(size=(1200, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit[::20] @ unit.T
    score[np.arange(60), np.arange(0, 1200, 20)] = -1
    want = {(20 * i, int(j)) for i, row in enumerate(score) for j in np.argsort(-row)[:5]}
    for sent in (retrieval.BROADCAST_BYTES, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", sent)
        rows, how = retrieval.knn_approx(q, v, 5, 0.0, skip_self=True, block_bytes=20_000)
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
        got = {(r.qid, r.id) for r in rows.collect()}
        assert len(got & want) >= 0.9 * len(want) and how["share"] <= 0.1
