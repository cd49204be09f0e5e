"""The pipeline against plain versions of its stages, each judged on its own input."""

import random

import corpus_pipeline
from qalake.llm.toxicity import fold_in, train, toxicity, whole_texts
from pyspark.sql import functions as F

from .cases import prose
from .test_jaccard_join import brute as brute_near
from .test_jaccard_join import edited
from .test_small_operators import brute_contamination


def corpus(spark, folder):
    rng = random.Random(21)
    item = prose(rng, 30)
    rows, labels = [], []
    for i in range(160):
        text = prose(rng, rng.randrange(40, 90))
        rude = i % 5 == 0
        if rude:
            w = text.split(" ")
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "loser"]))
            text = " ".join(w)
        if i % 9 == 4:
            text = f"{prose(rng, 5)} {item} {prose(rng, 20)}"
        if i % 7 == 3:
            text = rows[rng.randrange(i)][1]
        if i % 8 == 6:
            text = edited(rng, rows[rng.randrange(i)][1], 1)
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["a", "a", "b", None]), len(text)))
        labels.append((i, 1, int(any(w in text for w in ("idiot", "scum", "loser")))))
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, "one two", "en", "c", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_each_stage_on_its_input(spark, tmp_path):
    folder = f"file://{tmp_path}/data"
    item = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][:3] == ["toxicity", "exact dedup", "n-gram Jaccard join"] and len(corpus_pipeline.STAGES) == 5
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        after = [tuple(r) for r in docs.collect()]
        seen.append((before, after))
        if i < 4:
            assert docs.columns == columns
            assert set(after) <= set(before)
    ids = lambda rows: sorted(r[0] for r in rows)
    all_docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    model = train(whole_texts(all_docs), labels.filter(~fold_in(F.col("doc_id"), 4, 2)))
    assert ids(seen[0][1]) == sorted(r.doc_id for r in toxicity(all_docs, model).collect() if not r.predicted)
    assert 20 <= len(seen[0][0]) - len(seen[0][1]) <= 60
    best = {}
    for r in seen[1][0]:
        best[r[1] or ""] = max(r[0], best.get(r[1] or "", -1))
    assert ids(seen[1][1]) == sorted(best.values()) and len(seen[1][1]) < len(seen[1][0])
    groups = brute_near(seen[2][0])
    assert ids(seen[2][1]) == sorted({g for g, _ in groups.values()}) and len(seen[2][1]) < len(seen[2][0])
    dirty = {int(r[0]) for r in brute_contamination(seen[3][0], [(1, item), (2, None)]) if r[5]}
    assert dirty and ids(seen[3][1]) == sorted(r[0] for r in seen[3][0] if r[0] not in dirty)
    mixed = docs.collect()
    sizes = {r[0]: len((r[1] or "").split()) for r in seen[4][0]}
    assert all(r["size"] == sizes[r.doc_id] and r.taken == r.copies * r["size"] and 1 <= r.copies <= 3 for r in mixed)
    by_source = {}
    for r in mixed:
        own = by_source.setdefault(r.source, [0, r.target])
        own[0] += r.taken
    assert all(abs(taken - target) <= 100 for taken, target in by_source.values())
    assert len({r.doc_id for r in mixed}) == len(mixed)


def test_run_gives_what_the_stages_give_and_reruns_agree(spark, tmp_path):
    folder = f"file://{tmp_path}/data"
    corpus(spark, folder)
    first, second = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert first == second and first


def test_stages_keep_one_of_repeated_rows_and_each_text_of_an_id(spark, tmp_path):
    """Three identical rows, an id with two texts, null ids and texts, clashing columns, empty tables."""
    folder = f"file://{tmp_path}/data"
    spark.createDataFrame([(7000, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = random.Random(5)
    spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, a), (2, b), (2, c), (3, c), (None, b), (None, None), (4, ""), (5, None), (2**62, "w " * 60_000)]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as tie", "2 as rows", "3 as chosen_tie", "4 as class_id", "5 as key", "6 as size", "7 as tie0")
    result = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
        result[name] = sorted((str(r.doc_id), (r.text or "")[:9]) for r in got.collect())
    every = sorted((str(d), (t or "")[:9]) for d, t in rows)
    assert result["toxicity"] == result["benchmark decontamination"] == every
    once = lambda pairs: sorted((str(d), (t or "")[:9]) for d, t in pairs)
    assert result["exact dedup"] == once([(1, a), (2, b), (3, c), (5, None), (2**62, "w w w w w")])
    assert result["n-gram Jaccard join"] == once([(None, b), (1, a), (2, c), (None, None), (4, ""), (5, None), (2**62, "w w w w w")])
    mixed = result["mixing sources to target weights"]
    assert len(mixed) == len(set(mixed)) and ("1", a[:9]) in mixed and set(mixed) <= set(every)
