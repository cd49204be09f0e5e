"""Ranked search against a brute-force version that scores all documents for all items."""

import math
import random
import re
from collections import Counter

import numpy as np

from qalake.llm import lexical_search as L

from .cases import SCHEMA, documents, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, top=20):
    docs = [(d, Counter(terms(t)), len(terms(t))) for d, t in rows]
    n_docs, n_terms = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for d, c, n in docs:
            m = 75 + 25 * n * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is not None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def cases():
    rng = random.Random(8)
    rows = [(d, t) for d, t, *_ in documents(2, 240)]
    rows += [(2000 + i, "same words in many copies, 12 Über") for i in range(60)]  # ties beyond the top
    rows += [(2100, "THE tion " * 4000 + "rare")]
    items = [(i, " ".join(rng.choice("the tion re éau Über 12 rare same words or missing 日本".split()) for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "?!"), (53, "absent"), (54, "the the THE the"), (54, "the the THE the"), (55, "same words in many copies"), (None, "rare")]
    return rows, items


def tables(spark, rows, items):
    extra = [(*r, None, None, 0) for r in rows]
    return table(spark, extra), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as query", "2 as score", "3 as doc_id")


def test_against_all_scores(spark):
    rows, items = cases()
    docs, asked = tables(spark, rows, items)
    assert result(L.lexical_search(docs.repartition(7), asked)) == brute(rows, items)


def test_blocks_of_queries_and_narrow_sketches(spark, monkeypatch):
    rows, items = cases()
    docs, asked = tables(spark, rows, items)
    monkeypatch.setattr(L, "STEP", 3)
    assert result(L.lexical_search(docs.repartition(3), asked, top=5, query_bytes=200, width=8)) == brute(rows, items, 5)


def test_hard_rows(spark):
    items = spark.createDataFrame([("a", "x y")], "item_id string, text string")
    none = spark.createDataFrame([], SCHEMA)
    assert L.lexical_search(none, items).collect() == [] and L.lexical_search(table(spark), items.limit(0)).collect() == []
    rows = [(None, "x"), (3, "x"), (3, "x"), (1, None), (2, "")]
    assert result(L.lexical_search(spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA), items)) == brute(rows, [("a", "x y")])


def test_bounds_are_never_below_scores_and_leave_most_documents_out():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[int(x)] for x in rng.zipf(1.1, 200) % 4000) for _ in range(600)]
    passage = " ".join(texts[17].split()[:30])
    texts = [t if i % 24 else f"{t} {passage}" for i, t in enumerate(texts)]  # 25 documents quote what is asked
    queries = L.Queries.of(["q"], [passage])
    h, first = L.hashed(L.pa.array(texts))
    row, term, tf = L.tallied(h, first)
    df = np.bincount(queries.find(term)[queries.find(term) >= 0], minlength=len(queries.hashes))
    known = L.Collection(len(texts), len(h), df)
    impact = known.impacts(tf, np.diff(first)[row])
    worth = known.weights()[queries.terms[0]] * queries.times[0]
    place = (queries.hashes[queries.terms[0]] % np.uint64(L.WIDTH)).astype(int)
    bounds = L.sketches(row, term, impact, len(texts))[:, place] @ worth
    at = queries.find(term)
    scores = L._scores(np.arange(len(texts)), (row * len(df) + at)[at >= 0], impact[at >= 0], len(df), queries.terms[0], worth)
    assert (bounds >= scores).all() and scores.argmax() % 24 == 0
    assert (bounds >= np.sort(scores)[-20]).sum() < 60
