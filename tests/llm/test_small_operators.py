import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from qalake.llm import decontamination, exact_dedup, mixing, quality, token_counts, toxicity, url_filter

from ..oracle import DATA, connect
from .cases import SCHEMA, documents, prose, table


def test_exact_dedup_keeps_the_largest_id(spark):
    rows = documents(5, 90)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(table(spark, rows)).collect()), key=str)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    want = [(r[0], max(g := groups[r[1] or ""]), len(g), r[0] == max(g), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_exact_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "a", "", "", 0), (1, "a", "", "", 0), (1, "a", "", "", 0), (None, "b", "", "", 0), (None, "b", "", "", 0)]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(table(spark, rows)).collect())
    assert got == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_exact_dedup_against_a_given_history(spark):
    """The larger id wins, on either side, and counts add up; new digests are appended, and the next run finds them."""
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    history = spark.createDataFrame([(sha("a"), 77, 5), (sha("c"), 2, 1), (sha("z"), 9, 3)], "digest binary, keep_id long, group_size long")
    rows = [(1, "a", "", "", 0), (2, "b", "", "", 0), (3, "b", "", "", 0), (8, "c", "", "", 0), (None, "c", "", "", 0)]
    result = exact_dedup.exact_dedup(table(spark, rows), history)
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in result.collect())
    assert got == [("1", 77, 6, False), ("2", 3, 2, False), ("3", 3, 2, True), ("8", 8, 3, True), ("None", 8, 3, False)]
    longer = exact_dedup.appended(history, result)
    assert sorted((r.keep_id, r.group_size) for r in longer.collect()) == [(3, 2), (8, 3), (9, 3), (77, 6)]
    got = exact_dedup.exact_dedup(table(spark, [(90, "b", "", "", 0), (1, "z", "", "", 0)]), longer).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 9, 4), (90, 90, 3)]


def test_exact_dedup_of_long_texts_and_many_copies(spark, monkeypatch):
    """A third of all rows is one text; its shard is dealt to several tasks."""
    monkeypatch.setattr(exact_dedup, "SHARD_PROBES", 20)
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 40)
    rows = [(i, "same " * 50_000 if i % 3 == 0 else f"text {i % 200}", "", "", 0) for i in range(600)]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t, []).append(d)
    want = {d: (max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t, *_ in rows}
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want and len(got) == 600


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_perfect_hash_is_minimal_and_checks_bytes(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    bits, sizes, order = exact_dedup.build_hash(digests)
    slots = exact_dedup.find_slots(bits, sizes, digests[order], digests) if n else np.zeros(0, int)
    assert sorted(slots) == list(range(n)) and (order[slots] == np.arange(n)).all()
    others = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(500)), np.uint8).reshape(-1, 32)
    if n:
        assert (exact_dedup.find_slots(bits, sizes, digests[order], others) == -1).all()


def test_url_filter(spark):
    rows = [
        (1, "http://A.Example.com/en/x?q=porn"), (2, "http://www.example.com/en/"), (3, "http://www.example.com/fr/"), (4, "https://x.net/fr/1"),
        (5, "https://x.org/free-Casino/"), (6, "https://x.org/casinos"), (7, "https://free.org/win"), (8, "https://free.org/free"), (9, None), (10, "no scheme/porn"),
        (11, "ftp://porn.org"), (12, "https://x.net#/fr/"), (13, "https://com/a"), (14, "https://x.netx/es/"), (15, "https://é.org/xxx"), (16, "https://a.org/éxxxé"),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert got == {
        1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("com/", "allow"), 4: ("net/fr/", "block"), 5: (None, "block"), 6: (None, "allow"),
        7: (None, "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "block"), 11: (None, "block"), 12: (None, "allow"), 13: ("com/", "allow"),
        14: (None, "allow"), 15: (None, "block"), 16: (None, "block"),
    }
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_contamination(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = lower(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text, *_ in rows:
        w, hit, found = lower(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("index_words", [10**6, 0])
def test_decontamination_equals_brute_force(spark, index_words):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, ""), (None, "Ab1 cd2 ef3"), (3, prose(rng, 20))]
    rows = documents(6, 60)
    for i in range(12):
        text = items[rng.randrange(12)][1].upper()
        rows.append((3000 + i, " ".join([prose(rng, rng.randrange(60)), text, prose(rng, rng.randrange(30))]), "en", "s", 0))
    rows += [(4000, "ab1, CD2; ef3!", "en", "s", 0), (4000, "ab1, CD2; ef3!", "en", "s", 0), (None, "ab1 cd2", "en", "s", 0)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = decontamination.decontaminate(table(spark, rows), benchmark, index_words).drop("tie").collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == brute_contamination(rows, items)
    empty = benchmark.filter("item_id < 0")
    assert not any(r.contaminated for r in decontamination.decontaminate(table(spark, rows), empty, index_words).collect())
    assert decontamination.decontaminate(table(spark, []), benchmark, index_words).count() == 0


def test_decontamination_of_a_prompt_that_many_items_share(spark):
    """Its windows are held once in the index; long texts and repeated rows."""
    rng = random.Random(15)
    prompt = prose(rng, 40)
    items = [(i, f"{prompt} {prose(rng, 15)}") for i in range(300)]
    index = decontamination.Index([t for _, t in items], [i for i, _ in items])
    assert len(index.lengths[13][2]) == len(set(map(tuple, index.lengths[13][3].tolist())))
    assert max(map(len, index.lengths[13][4])) == 300 and len({id(x) for x in index.lengths[13][4]}) < len(index.lengths[13][4])
    rows = [(1, prompt, "", "", 0), (1, prompt, "", "", 0), (2, "q " * 60_000 + prompt, "", "", 0), (3, items[7][1], "", "", 0)]
    got = decontamination.decontaminate(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("tie").collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == brute_contamination(rows, items)


def test_every_shared_span_has_a_common_fingerprint():
    rng = np.random.default_rng(3)
    for _ in range(50):
        span = rng.integers(0, 3, 13).astype(np.uint64)
        found = []
        for _ in range(2):
            h = np.concatenate([rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64), span, rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64)])
            found.append(set(decontamination.fingerprints(h, np.array([0, len(h)]), 13, 5)[1].tolist()))
        assert found[0] & found[1]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 80)), "en", rng.choice(["a", "b", "b", "b", "b", "c", None]), 0) for i in range(900)]
    rows += [(900, None, "en", "a", 0), (901, " \n", "en", "d", 0), (None, "one two", "en", "a", 0), (5, "one two", "en", "a", 0), (5, "one two", "en", "a", 0)]
    got = mixing.mix_sources(table(spark, rows), group=7).collect()
    again = mixing.mix_sources(table(spark, rows).repartition(5), group=7).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in rows)
    total, sources = sum(r["size"] for r in got), {}
    for r in got:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        own = sources.setdefault(r.source, [0, 0, r.target, r.source_size])
        own[0] += r["size"]
        own[1] += r.taken
    for size, taken, target, source_size in sources.values():
        assert size == source_size and target <= 3 * size and abs(taken - target) <= 80
    assert abs(sum(s[2] for s in sources.values()) - total) < 1e-6 * total
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_a_source_of_fifty_documents_comes_near_its_target(spark):
    """Though one of them is long; whether most of them are heavy, or meet in groups."""
    rng = random.Random(13)
    rows = [(i, "w " * (3000 if i % 50 == 0 else rng.randrange(20, 400)), "en", f"s{i // 50}", 0) for i in range(300)] + [(7, "x y z", "en", "s1", 0)] * 500 + [(None, "long " * 20_000, "en", "s9", 0)]
    for heavy in (100, 20):
        got = mixing.mix_sources(table(spark, rows), heavy=heavy).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"), F.sum("size").alias("size")).collect()
        assert sum(r.n for r in got) == len(rows)
        for r in got:  # where the others can make up for the long one, whichever way it is drawn; else its chance comes first
            p, others = r.target / r["size"] % 1, r["size"] - (3000 if r.source != "s9" else 20_000)
            enough = max(p, 1 - p) * 3000 <= min(p, 1 - p) * others
            assert abs(r.taken - r.target) <= (0.05 * r.target if enough else r["size"] - others), r


def test_targets_are_the_fixed_point(spark):
    sizes = {"a": 10, "b": 500, "c": 20, "d": 470, "e": 0}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    weight = dict(zip(sorted(sizes), [1, 2, 3, 1, 2]))
    want, open_ = {}, set(sizes)
    while True:  # share, stop those above, share again
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in sizes if s not in open_)
        want = {s: rest * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * sizes[s] for s in sizes}
        full = {s for s in open_ if want[s] > 3 * sizes[s]}
        if not full:
            break
        open_ -= full
    assert got == pytest.approx(want)


def test_each_document_keeps_its_chance(spark):
    """1,500 sources with the sizes of a given one: mean copies of the document of each rank are what is wanted, within 4 standard errors."""
    sizes = [n for (n,) in connect().execute(r"select len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) from documents where source = 'src0'").fetchall()]
    one = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "rank long, text string")
    rows = spark.range(1500).crossJoin(one).select((F.col("id") * 1000 + F.col("rank")).alias("doc_id"), "text", F.format_string("s%05d", "id").alias("source"), "rank", "id")
    got = mixing.mix_sources(rows, (3, 7)).withColumn("rank", F.col("doc_id") % 1000).withColumn("kind", F.substring("source", 2, 5).cast("int") % 2)
    got = got.groupBy("kind", "rank").agg(F.avg("copies").alias("mean"), F.count("*").alias("n"), F.first("size").alias("size")).collect()
    assert len(got) == 2 * len(sizes) and {r.n for r in got} == {750}
    error = (0.6 * 0.4 / 750) ** 0.5
    assert max(abs(r["mean"] - (0.6, 1.4)[r.kind]) for r in got if r["size"]) <= 4 * error


def test_sources_come_near_their_targets_through_the_tree(spark, monkeypatch):
    """On given documents: the rounding tree has a level at least, whatever the size, and totals are within 1 % or a document."""
    levels = []
    cut = mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df, name: levels.append(name) or cut(df, name))
    got = mixing.op8_mixing(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source"), "doc_id")
    got = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
    assert {"heavy", "groups", "level1"} <= set(levels)
    assert max(abs(r.taken - r.target) / r.target for r in got) <= 0.01


def test_pivotal_rounding_is_unbiased(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("source"))
    got = mixing.mix_sources(df).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    assert all(abs(r[1] - r[2]) <= 4 for r in got)


def test_token_counts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = documents(9, 40) + [(7000, "it's  we'll\n\n  x<|endoftext|>y 日本 ½ ²³ a b\x1c\x1f ", "en", "s", 0), (7001, "word " * 30_000, "en", "s", 0), (None, "Ünïcödé ÷×ª", "en", "s", 0)]
    own = Tokenizer.from_file(path)
    want = sorted((str(d), len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in rows)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time all are in the cache
        got = token_counts.token_counts(table(spark, rows), path, cache).collect()
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, *_ in rows})
    assert token_counts.token_counts(table(spark, []), path, cache).count() == 0


def test_a_second_run_of_the_query_encodes_nothing(spark, tmp_path, monkeypatch):
    """All its texts are in the cache, which the session's shared folder keeps for each tokenizer."""
    folder = f"file://{tmp_path}/data"
    table(spark, documents(14, 30)).select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    first = sorted(map(str, token_counts.op10_token_counts(spark, folder).collect()))
    cache = spark.read.parquet(token_counts.cache_folder(spark))
    before = cache.count()

    def encode(path, version):
        def work(batches):
            for batch in batches:
                assert not batch.num_rows, "a stored text was encoded"
                yield from ()

        return work

    monkeypatch.setattr(token_counts, "_encode", encode)
    assert sorted(map(str, token_counts.op10_token_counts(spark, folder).collect())) == first
    assert spark.read.parquet(token_counts.cache_folder(spark)).count() == before


def labelled(spark, n=400):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        bad, rude = rng.random() < 0.3, rng.random() < 0.25
        text = prose(rng, rng.randrange(30, 120))
        if bad:
            text = " ".join(w + "###" for w in text.split())
        if rude:
            w = text.split(" ")
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "loser"]) + rng.choice(["", "s", "ish"]))
            text = " ".join(w)
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(not bad), int(rude)))
    rows += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "word " * 20_000, "en", "s", 0), (None, "###", "en", "s", 0)]
    labels += [(9001, None, None), (3, labels[3][1], labels[3][2]), (12345, 1, 1)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs = table(spark, rows)
    truth = {r.doc_id: r for r in labels.collect()}
    model = toxicity.train(toxicity.whole_texts(docs), labels.filter("doc_id % 4 <> 2").select("doc_id", "toxic"))
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 2]
    assert sum(r.predicted == truth[r.doc_id].toxic for r in held) >= 0.95 * len(held)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    model = quality.train(docs, labels.filter("doc_id % 5 <> 0").select("doc_id", F.col("quality").alias("label")))
    got = quality.quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id].quality for r in held) >= 0.95 * len(held)


def test_classifiers_without_labels_or_rows(spark):
    rows, labels = labelled(spark, 20)
    none, docs = labels.filter("doc_id < 0"), table(spark, rows)
    model = toxicity.train(toxicity.whole_texts(docs), none.select("doc_id", "toxic"))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, model).collect())
    assert toxicity.toxicity(table(spark, []), model).count() == 0
    model = quality.train(docs, none.select("doc_id", F.col("quality").alias("label")))
    assert all(0 <= r.score <= 1 for r in quality.quality(docs, model).collect())
    assert quality.quality(table(spark, []), model).count() == 0


def test_quality_of_any_id_and_of_repeats(spark):
    rows, labels = labelled(spark, 60)
    big = spark.createDataFrame(
        [(2**62 + i, t) for i, t, *_ in rows if i is not None and i < 60] + [(2**63 - 1, "a b"), (-(2**63), "a b"), (2**62, rows[0][1])],
        "doc_id long, text string",
    ).selectExpr("*", "'x' as label", "1 as score")
    model = quality.train(big, labels.filter("doc_id < 60").select((F.col("doc_id") + 2**62).alias("doc_id"), F.col("quality").alias("label")))
    got = quality.quality(big, model).collect()
    assert len(got) == 63 and len({r.score for r in got if r.doc_id == 2**62}) == 1 and len({r.score for r in got if abs(r.doc_id) > 2**62 + 100}) == 1
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(r.predicted == truth[r.doc_id - 2**62] for r in got if 2**62 <= r.doc_id < 2**62 + 60) >= 57


def test_scores_are_sums_of_table_entries():
    """Bin by bin and pair by pair, one text at a time."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float)
    model = quality.Additive(x, y, rounds=30)
    assert model.pairs and ((model.score(x) >= 0.5) == (y == 1)).mean() >= 0.9
    place = lambda cuts, v: sum(c <= v for c in cuts)
    for row in [*x[:40], np.full(x.shape[1], 1e9), np.full(x.shape[1], -1e9)]:
        total = model.base + sum(t[place(c, v)] for c, t, v in zip(model.cuts, model.tables, row))
        total += sum(t[place(model.coarse[a], row[a]), place(model.coarse[b], row[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(total, -40, 40))), abs=1e-12)


def test_features_do_not_depend_on_neighbours(spark):
    import pyarrow as pa

    from qalake.llm.shared import raw

    texts = [t or "" for _, t, *_ in documents(12, 30)]
    together = quality.features(*raw(pa.array(texts)))
    assert np.allclose(together, np.concatenate([quality.features(*raw(pa.array([t]))) for t in texts]))
    assert SCHEMA
