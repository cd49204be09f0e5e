"""Edge cases that the tables don't hold."""

import random
import statistics
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qalake.functions.rules import fold_pack
from qalake.functions.text import cosine, normalize_query, query_hash, unit
from qalake.operators import corpus, evaluate, graph, maintenance, questions, retrieval, reuse, traffic, urls, verify
from qalake.sources import files
from qalake.streaming import flags

T0 = datetime(2024, 1, 1)


def one(df):
    return [tuple(r) for r in df.collect()]


def test_question_text(spark):
    rows = [(1, "  What IS  PTSD?! "), (2, "?!"), (3, ""), (4, None), (5, "Ünï_9 x")]
    df = spark.createDataFrame(rows, "qid long, q string").select("qid", normalize_query(F.col("q")).alias("n"), query_hash(F.col("q")).alias("h"))
    got = {r.qid: r.n for r in df.collect()}
    assert got == {1: "what is ptsd", 2: "", 3: "", 4: None, 5: "ünï_9 x"}
    assert all(len(r.h) == 32 for r in df.filter("qid <> 4").collect())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_normalising_twice_changes_nothing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_query(F.col("t")).alias("a"))
    assert all(r.a == r.b for r in df.select("a", normalize_query(F.col("a")).alias("b")).collect())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=12), max_size=12), st.integers(3, 20))
def test_packing_loses_nothing_and_keeps_the_limit(spark, parts, limit):
    df = spark.createDataFrame([(parts,)], "p array<string>").select(fold_pack(F.col("p"), F.lit(limit), joint="|").alias("x"))
    packs = df.first().x
    assert "|".join(packs) == "|".join(parts)
    assert all(len(p) <= limit or p in parts for p in packs)


def greedy(parts, limit):
    packs = []
    for p in parts:
        if packs and len(packs[-1]) + 1 + len(p) <= limit:
            packs[-1] += "|" + p
        else:
            packs.append(p)
    return packs


@pytest.mark.parametrize("block", [1, 2, 3, 128])
def test_packing_by_blocks_is_greedy(spark, block):
    rng = random.Random(block)
    rows = [["a" * rng.randrange(1, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 7, 127, 128, 129, 257)] + [None]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, p array<string>").select("i", fold_pack(F.col("p"), F.lit(10), joint="|", block=block).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert got == {i: None if p is None else greedy(p, 10) for i, p in enumerate(rows)}


def test_packing_100000_parts_of_one_text(spark):
    docs = spark.createDataFrame([(1, 30)], "doc_id long, n int").select("doc_id", F.expr("array_join(transform(sequence(1, 100000), i -> repeat('x', 20 + cast(i % 23 as int))), '\n\n')").alias("text"))
    start = time.time()
    got = corpus.pack_parts(docs, limit=50).agg(F.count("*").alias("packs"), F.sum(F.length("content")).alias("chars"), F.max(F.length("content")).alias("longest")).first()
    assert time.time() - start < 60
    sizes, packs = [20 + i % 23 for i in range(1, 100_001)], []
    for size in sizes:
        if packs and packs[-1] + 2 + size <= 50:
            packs[-1] += 2 + size
        else:
            packs.append(size)
    assert (got.packs, got.chars, got.longest) == (len(packs), sum(packs), max(packs))


def test_vectors(spark):
    rows = [(1, [3.0, 4.0], [3.0, 4.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0], [1.0, 2.0]), (4, [1.0, 0.0], [0.0, 2.0])]
    got = spark.createDataFrame(rows, "i long, a array<float>, b array<float>").select("i", F.round(cosine(F.col("a"), F.col("b")), 6), unit(F.col("a"))).collect()
    assert [r[1] for r in got] == [1.0, 0.0, 0.0, 0.0] and got[0][2] == pytest.approx([0.6, 0.8]) and got[1][2] == [0.0, 0.0]


def test_neighbours_by_blocks_and_by_broadcast(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "qid long, embedding array<float>")
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(90, [0.0, 0.0])], "id long, embedding array<float>")
    a, b = (sorted(one(retrieval.knn_topk(q, v, 4, 0.1, broadcast_bytes=n, block_bytes=m))) for n, m in ((10**6, 10**6), (0, 40)))
    assert a == b and len([r for r in a if r[0] == 3]) == 4 and not [r for r in a if r[0] == 2]
    assert [r[1] for r in sorted(a, key=lambda r: r[3]) if r[0] == 1] == [2, 5, 8, 1]
    assert retrieval.knn_topk(q.limit(0), v).count() == 0


def test_approximate_neighbours_find_most(spark):
    """Clusters and noise: few cells are probed, few vectors rescored, and nearly all neighbours found, in blocks too."""
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(40, 32))
    m = (heads[rng.integers(40, size=3000)] + rng.normal(size=(3000, 32)) * 0.5).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    exact = retrieval.knn_topk(q, v, 7, 0.2, skip_self=True)
    for size in (1 << 20, 32 * 8 * 30):
        rows, how = retrieval.knn_approx(q, v, 7, 0.2, skip_self=True, block_bytes=size)
        share = retrieval.recall(rows, exact).agg(F.sum(F.col("recall") * F.col("n")) / F.sum("n")).first()[0]
        assert share >= 0.93 and how["share"] <= 0.1 and how["probes"] < how["cells"] == 54 and how["found"] >= 0.95
        assert rows.filter("qid = id").count() == 0


def test_codes_are_near_their_vectors():
    rng = np.random.default_rng(7)
    m = rng.normal(size=(500, 20))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    codes = retrieval.Codes.fit(m, 9)
    code = codes.encode(m)
    assert code.shape == (500, 16) and codes.middle.shape == (9, 20)
    assert np.abs(codes.scores(m[:50], code) - m[:50] @ m.T).max() < 0.2
    assert retrieval.Codes.fit(np.zeros((0, 4)), 3).encode(np.ones((2, 4))).shape == (2, 4)


def test_reuse_ends_at_expiry(spark):
    q = spark.createDataFrame([(1, "A?", T0), (2, "a", T0 + timedelta(hours=24)), (3, "b", T0)], "qid long, question string, ts timestamp")
    a = spark.createDataFrame(
        [(9, "a", T0, T0 + timedelta(hours=24)), (8, "a", T0 - timedelta(hours=2), T0 + timedelta(hours=22))],
        "answer_id long, q string, created_at timestamp, expires_at timestamp",
    )
    assert one(reuse.exact_reuse(q, a.withColumn("query_hash", query_hash(F.col("q"))))) == [(1, 9)]


def test_ttl_windows_open_anew(spark):
    rows = [("k", i, T0 + timedelta(hours=h)) for i, h in enumerate([0, 23, 24, 30, 48, 49])]
    got = reuse.ttl_dedup(spark.createDataFrame(rows, "key string, qid long, ts timestamp")).orderBy("qid").collect()
    assert [r.kept for r in got] == [True, False, True, False, True, False]


def test_flags(spark):
    at = [0, 10, 20, 30, 40, 59, 60, 119]
    rows = [(i, "1.1.1.1", T0 + timedelta(seconds=s), "same" if i > 3 else f"prompt {i}") for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, ip string, ts timestamp, prompt string")
    assert [r.burst for r in flags.burst_flags(df).orderBy("id").collect()] == [False] * 5 + [True, True, False]
    assert [r.repeat for r in flags.repeat_flags(df).orderBy("id").collect()] == [False] * 7 + [True]
    short = spark.createDataFrame([(i, "2.2.2.2", T0 + timedelta(hours=i), "hi") for i in range(5)], df.schema)
    assert [r.short for r in flags.short_prompt_flags(short).orderBy("id").collect()] == [False] * 3 + [True] * 2
    assert {r.reason for r in flags.abuse_reason(short, ["2.2.2.2"]).collect()} == {None}


def test_citations(spark):
    rows = [(1, "No citation here"), (2, "The rate is thirty percent of pay [0]. And then it ends after years ¹²."), (3, None), (4, "")]
    got = one(verify.extract_citations(spark.createDataFrame(rows, "qid long, answer string")))
    assert sorted((r[0], r[2]) for r in got) == [(2, 0), (2, 12)]
    a = spark.createDataFrame([(1, "It pays 30% after 2 years."), (2, "It pays 40 percent, code 7101, $1,200.50."), (3, "Nothing")], "qid long, answer string")
    c = spark.createDataFrame([(i, 1, "Pays 30% after 2 years", "u") for i in (1, 2)], "qid long, rank int, text string, url string")
    got = {r.qid: (r.percents, r.codes, r.specifics, r.is_clean) for r in verify.verify_numbers(a, c).collect()}
    assert got == {1: ("", "", "", True), 2: ("40", "7101", "1,200.50", False), 3: ("", "", "", True)}
    text = "A claim [1] and [9] and ¹ and ⁹.\nSources:\n1. [A](u)\n9. [B](v)"
    got = spark.createDataFrame([(text,)], "t string").select(verify.clean_citations(F.col("t"), F.lit(2))).first()[0]
    assert got == "A claim [1] and  and ¹ and .\nSources:\n1. [A](u)"
    score = verify.verify_citations(spark.createDataFrame([(1, "plain")], "qid long, answer string"), c).first()
    assert (score.total, score.score, score.review) == (0, 1.0, False)


def test_claim_support(spark):
    rows = [("The of and", "x"), ("retirees receive 30%", "Retirees receive 30% more"), ("retirees receive 40%", "Retirees receive 30% more")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, t string").select(F.round(verify.claim_support(F.col("c"), F.col("t")), 4)).collect()]
    assert got == [0.5, 1.0, pytest.approx(1 / 3, abs=1e-3)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id long, name string, n int")
    assert sorted(one(maintenance.snapshot_upsert(old, new, ["id"]))) == [(1, "a", 1), (2, None, 5), (3, "c", 6)]
    once = maintenance.snapshot_upsert(old, new, ["id"], ["name"])
    assert sorted(one(once)) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    assert sorted(one(maintenance.snapshot_upsert(once, new, ["id"], ["name"]))) == sorted(one(once))


def test_legacy_counters_and_places(spark):
    kv = spark.createDataFrame([("ask_count", "12x"), ("visit_count", "7"), ("unique_visitors", "{}"), ("locations", "{}")], "key string, value string")
    assert one(traffic.legacy_totals(kv)) == [(0, 7, 0)] and traffic.legacy_location_counts(kv).count() == 0
    places = [("NY", 2), ("ny", 3), ("International-DE", 1), ("Local", 4), ("Unknown", 5), ("somewhere", 6)]
    got = {r["class"]: r.n for r in traffic.location_classes(spark.createDataFrame(places, "location string, n long")).collect()}
    assert got == {"us_state": 5, "international": 1, "local": 4, "unknown": 5, "other": 6}
    ips = spark.createDataFrame([("10.1.1.1",), ("172.32.0.1",), ("172.16.0.1",), ("8.8.8.8",), ("junk",)], "ip string")
    ranges = spark.createDataFrame([(134744064, 134744319, "G")], "lo long, hi long, region string")
    assert dict(one(traffic.classify_ip(ips, ranges))) == {"10.1.1.1": "Local", "172.32.0.1": "Unknown", "172.16.0.1": "Local", "8.8.8.8": "G", "junk": "Unknown"}


def test_expansion(spark):
    df = spark.createDataFrame([("what is DC 5000?",), ("dc 5003 pain",), ("PTSD",), ("PTSD (stress)",)], "q string")
    got = [r[0] for r in df.select(questions.expand_query(F.col("q"), [("5000", "Knee")], [(r"\bPTSD\b", "PTSD (stress)")])).collect()]
    assert got == ["What is Diagnostic Code 5000? Knee. What are the rating criteria?", "Diagnostic Code 5003 pain", "PTSD (stress)", "PTSD (stress)"]
    df = spark.createDataFrame([("Bad Knee pain",), ("none",)], "q string")
    assert [r[0] for r in df.select(questions.expand_terms(F.col("q"), [("knee", "k"), ("knee pain", "kp")])).collect()] == ["bad kp", "none"]


def test_questions_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# comment\n\nCARDIO-1 | What? | more\n[SKIN-A-2] How?\nno id\nPLAIN | x\n")
    got = one(files.read_questions(spark, f"file://{tmp_path}/q.txt"))
    assert got == [("CARDIO-1", "CARDIO", "What? | more"), ("SKIN-A-2", "SKIN-A", "How?"), ("PLAIN", "PLAIN", "x")]


def test_corpus_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"entry_id": "a", "content": "1"}, {"entry_id": "a", "content": "2"}, {"content": "x"}, {"entry_id": "b"}, {"entry_id": "c", "content": "3", "aliases": ["z"]}]')
    got = sorted((r.entry_id, r.content, r.aliases) for r in files.read_corpus(spark, f"file://{tmp_path}/c.json").collect())
    assert got == [("a", "2", None), ("c", "3", ["z"])]


def test_oversized_chunks_are_repaired(spark):
    long = "\n".join(f"line {i} " + "x" * 50 for i in range(40))
    rows = [("a", "t", "short"), ("b", "t", long), ("c", "FAQ x", "Q1: a\nQ2: " + "b" * 400), ("d", "t", "intro\n### 1. A\n" + "w " * 900 + "\n### 2. B")]
    got = corpus.repair_oversized(spark.createDataFrame(rows, "entry_id string, topic string, content string"), 100).collect()
    parts = {k: [r.content for r in got if r.entry_id == k] for k in "abcd"}
    assert parts["a"] == ["short"] and "".join("".join(parts["b"]).split()) == "".join(long.split()) and all(len(p) <= 404 for p in parts["b"])
    assert len(parts["c"]) == 2 and len(parts["d"]) == 3


def test_urls(spark):
    df = spark.createDataFrame([(1, "/a/"), (2, "http://www.kb.org/a"), (3, None), (4, "https://kb.org/cart#x"), (5, "https://other.org/")], "i long, url string")
    got = {r.i: (r.u, r.b) for r in df.select("i", urls.normalize_url(F.col("url"), "kb.org").alias("u"), urls.blocked_url(F.col("url"), "kb.org", ["cart"]).alias("b")).collect()}
    assert got == {1: ("https://kb.org/a", False), 2: ("https://kb.org/a", False), 3: ("", True), 4: ("https://kb.org/cart#x", True), 5: ("https://other.org", False)}


def test_entities_keep_the_first_name(spark):
    df = spark.createDataFrame([(1, "dc 5000 and 5000, code 5000"), (2, None)], "qid long, text string")
    got = one(graph.extract_entities(df, [("code", r"code (\d+)", "first {}"), ("code", r"(\d{4})", "second {}")]))
    assert got == [(1, "code", "5000", "first 5000")]


# -- hot keys: far more rows of one key than any test table has -------------------------------------------------------


def test_ttl_windows_of_a_hot_key(spark):
    """A row a minute of one key, and few of others; no list of a key's rows is made."""
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 1000 == 0, "rare").when(F.col("id") % 1000 == 1, F.lit(None).cast("string")).otherwise("hot").alias("key"),
        F.col("id").alias("qid"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
    )
    got = {r.qid for r in reuse.ttl_dedup(rows, 24).filter("kept").collect()}
    want = set()
    for key in (0, 1, 2):
        opened = None
        for i in range(n):
            if min(i % 1000, 2) == key and (opened is None or i >= opened + 1440):
                opened = i
                want.add(i)
    assert got == want


def test_an_entity_that_all_questions_hold(spark):
    """What is matched are distinct sets of entities, not rows."""
    n = 4000
    asked = spark.range(n).select(F.col("id").alias("qid"))
    edges = asked.select("qid", F.lit(0).alias("entity_id")).unionByName(asked.filter("qid % 3 > 0").select("qid", (F.col("qid") % 3).cast("int").alias("entity_id")))
    originals = spark.range(n).filter("id % 2 = 0").select("id", (F.col("id") % 50).alias("ts"))
    got = {}
    for r in graph.similar_by_entity(asked, edges, originals, 3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.matches))
    sets = [{0, i % 3} for i in range(n)]
    for q in range(0, n, 397):
        best = sorted(((-len(sets[q] & sets[i]), -(i % 50), -i) for i in range(0, n, 2) if i != q))[:3]
        assert sorted(got[q]) == [(k + 1, -b[2], -b[0]) for k, b in enumerate(best)]
    assert len(got) == n


def shared_best(sets, asked, n):
    """By definition: matches, then the newest (here the id's own time), for some questions."""
    out = {}
    for q in asked:
        best = sorted(((-len(sets[q] & s), -(i % 97), -i) for i, s in sets.items() if i != q and sets[q] & s))[:n]
        out[q] = [(k + 1, -b[2], -b[0]) for k, b in enumerate(best)]
    return out


@pytest.mark.parametrize("rare", [0, 3, 15, 10**6])
def test_entities_rare_and_frequent(spark, rare):
    rng = random.Random(6)
    sets = {i: {int(rng.paretovariate(0.7)) for _ in range(rng.randrange(0, 9))} for i in range(300)}
    edges = spark.createDataFrame([(q, e) for q, s in sets.items() for e in s], "qid long, entity_id long")
    ids = spark.range(300)
    got = {}
    for r in graph.similar_by_entity(ids.withColumnRenamed("id", "qid"), edges, ids.select("id", (F.col("id") % 97).alias("ts")), 5, rare).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.matches))
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in shared_best(sets, sets, 5).items() if x}


def test_an_entity_in_two_fifths_of_distinct_sets(spark):
    """100,000 questions, no two with equal sets: a join on the frequent entity would make 1.6e9 pairs."""
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("qid"), F.expr("array(id + 10, id div 40 * -1 - 1, if(id % 5 < 2, 0, id + 10))").alias("e"))
    ids = spark.range(n)
    out = graph.similar_by_entity(ids.withColumnRenamed("id", "qid"), rows.select("qid", F.explode("e").alias("entity_id")), ids.select("id", (F.col("id") % 97).alias("ts")), 3)
    some = [0, 1, 2, 39, 40, 41, 50_000, 50_003, 99_999]
    got = {q: [] for q in some}
    for r in out.filter(F.col("qid").isin(some)).collect():
        got[r.qid].append((r.rank, r.id, r.matches))
    sets = {i: {i + 10, -(i // 40) - 1} | ({0} if i % 5 < 2 else set()) for i in range(n)}
    assert {q: sorted(x) for q, x in got.items()} == shared_best(sets, some, 3)


def test_latency_of_a_hot_key_is_counted_by_value(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("k"), (F.col("id") * 7 % 900).alias("ms"))
    got = {r.k: r for r in evaluate.latency_stats(rows, ["k"], "ms").collect()}
    for k in "ab":
        v = sorted(i * 7 % 900 for i in range(100_000) if (i % 50 == 0) == (k == "b"))
        assert (got[k].n, got[k].min, got[k].max, got[k].p95, got[k].p99) == (len(v), v[0], v[-1], v[int(len(v) * 0.95)], v[int(len(v) * 0.99)])
        assert got[k]["mean"] == pytest.approx(statistics.mean(v), abs=1e-4) and got[k]["std"] == pytest.approx(statistics.stdev(v), abs=1e-4) and got[k]["median"] == statistics.median(v)


def test_neighbours_leave_out_the_question_itself(spark):
    """By broadcast, by blocks and in cells; equal scores by id."""
    v = spark.range(300).select("id", F.array((F.col("id") % 7).cast("float"), F.lit(1.0).cast("float"), (F.col("id") % 5).cast("float")).alias("embedding"))
    q = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    plans = [
        retrieval.knn_topk(q, v, 5, 0.0, skip_self=True),
        retrieval.knn_topk(q, v, 5, 0.0, skip_self=True, broadcast_bytes=0, block_bytes=500),
        retrieval.knn_approx(q, v, 5, 0.0, target=2.0, most=1.0, skip_self=True, block_bytes=500)[0],
    ]
    a, b, c = (sorted(one(p)) for p in plans)
    assert a == b == c and len(a) == 15 * 5 and not [r for r in a if r[0] == r[1]]


def test_batches_of_texts_stay_bounded(spark):
    texts = spark.range(3000).select(F.repeat(F.lit("x"), (F.col("id") % 97 * 4).cast("int")).alias("p"), "id").select(F.concat(F.col("id").cast("string"), "p").alias("text"))
    rows = retrieval.embed_batches(texts.unionByName(texts), 40, 1000, 700)
    size = texts.select(F.sha2("text", 256).alias("text_hash"), (F.floor(F.length("text") / 4) + 1).alias("tokens"))
    got = rows.join(size, "text_hash").groupBy("part", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()
    assert sum(r.n for r in got) == 3000 and all(r.n <= 40 and r.tokens <= 1000 for r in got) and {r.part for r in got} == set(range(5))


def test_figures_in_words_are_found(spark):
    """Also without a space before the word, and with two."""
    df = spark.createDataFrame([("pays 30percent, 40  percent, 50% and 7 percents",)], "t string")
    assert sorted(df.select(F.regexp_extract_all(F.lower("t"), F.lit(verify.PERCENT), F.lit(1)).alias("x")).first().x) == ["30", "40", "50", "7"]


def test_figures_are_held_against_their_own_kind(spark):
    """Thirty days are not found in thirty dollars, nor the other way round."""
    a = spark.createDataFrame([(1, "Wait 30 days."), (2, "It costs $30."), (3, "Wait 30 days, pay $30.")], "qid long, answer string")
    c = spark.createDataFrame([(1, 1, "It costs $30.", "u"), (2, 1, "Wait 30 days.", "u"), (3, 1, "Pay.", "u")], "qid long, rank int, text string, url string")
    assert one(verify.verify_numbers(a, c).orderBy("qid").select("specifics", "is_clean")) == [("30", False), ("30", False), ("30,30", False)]
    assert {r.answer.startswith(verify.WARNING) for r in verify.sanitize_answers(a, c).collect()} == {True}
