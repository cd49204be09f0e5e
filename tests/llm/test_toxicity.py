import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from qalake.llm import toxicity as T


def events(text):
    """Bytes with their contexts: (item, context and byte)."""
    w = [x.encode() for x in re.findall(r"\w+", text.lower())]
    out = []
    for i, x in enumerate(w):
        if i:
            out.append((2 * i, (b" " + w[i - 1] + b" ")[-5:] + x[:1]))
        out += [(2 * i + 1, (b" " + x[:j])[-7:] + (x + b" ")[j : j + 1]) for j in range(len(x) + 1)]
    return out


def brute_model(rows):
    """The terms: both classes' chances of any byte after any context, compared."""
    counts = [Counter(), Counter()]
    for text, toxic in rows:
        counts[toxic].update(g for _, g in events(text))
    both = counts[0] + counts[1]
    kinds, level = [], set(both)
    for n in (5, 2, 1):
        kinds.append(Counter(g[-n:] for g in level))
        level = set(kinds[-1])

    def grouped(table):
        out = defaultdict(dict)
        for g, n in table.items():
            out[g[:-1]][g] = n
        return out

    tables = [grouped(k) for k in kinds]
    of_both, of_class = grouped(both), [grouped(c) for c in counts]

    def shared(g, i=0):
        own = tables[i].get(g[-(5, 2, 1)[i] :][:-1], {})
        n = own.get(g[-(5, 2, 1)[i] :], 0)
        total = sum(own.values())
        if i == 2:
            return n / total
        return (max(n - 0.75, 0) + 0.75 * len(own) * shared(g, i + 1)) / total if total else shared(g, i + 1)

    discount = lambda n: (0, 1.0, 1.6, 2.2)[min(n, 3)]

    def pooled(g):
        own = of_both.get(g[:-1], {})
        total = sum(own.values())
        return (max(own.get(g, 0) - 0.75, 0) + 0.75 * len(own) * shared(g)) / total if total else shared(g)

    across = lambda g: len(g) > 2 and g[-2:-1] == b" "

    def given(k, g):
        q = pooled(g)
        if across(g):
            q *= given(k, b" " + g[-1:]) / pooled(b" " + g[-1:])
        own = of_class[k].get(g[:-1], {})
        total, n = sum(own.values()), own.get(g, 0)
        return (n - discount(n) + sum(map(discount, own.values())) * q) / total if total else q

    def term(g):
        ratio = lambda g: math.log(given(1, g)) - math.log(given(0, g))
        return ratio(g) - (ratio(b" " + g[-1:]) if across(g) else 0)

    return term


def brute_evidence(term, text):
    items, size = defaultdict(float), 0
    for item, g in events(text):
        items[item] += term(g)
        size += item % 2
    values = [0.0] + list(items.values())  # the first word has none before it
    return [sum(values) / size] + [sum(max(v - t, 0) for v in values) / len(values) for t in (1, 2, 3)] + [sum(max(-v - t, 0) for v in values) / len(values) for t in (1, 2, 3)]


def test_texts_get_the_difference_of_both_log_likelihoods(spark):
    """Each computed by itself; with all terms, some or none of them in tasks."""
    rng = random.Random(4)
    word = lambda: rng.choice(["der", "das", "Übel", "abcdefghijklm", "nett", "so"]) + rng.choice(["", "en", "ung"])
    rows = [(" ".join(word() for _ in range(rng.randrange(12))), int(i % 4 == 0)) for i in range(200)] + [("a rare Expression, a", 1), ("a b rare", 0), ("", 1)]
    term = brute_model(rows)
    texts = [t for t, _ in rows if t][:60] + ["derung  abcdefghijklmno", "o... be das derder Übelung", "g" * 3000 + " das"]
    want = {i: brute_evidence(term, t) for i, t in enumerate(texts)}
    table = T.cut(T.terms(spark.createDataFrame(rows, "text string, toxic int")), "terms")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, ""), (901, " .. ")], "key long, text string")
    complete = []
    for hot in (100_000, 150, 0):
        model = T.Model(table, hot)
        complete.append(model.complete)
        got = {r.key: list(r.x) for r in model.evidence(docs).collect() if r.key < 900 or any(r.x)}
        assert got.keys() == want.keys()
        for i, x in want.items():
            assert got[i] == pytest.approx(x, abs=2e-6)  # terms have four bytes
    assert complete == [True, False, False]


def test_held_out_toxic_stems_are_found(spark):
    """Forms of a word that no training text has, too."""
    rng = random.Random(9)
    end = lambda: "".join(rng.choice("aeiou") + rng.choice("nrst") for _ in range(2))
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(["kal", "mor", "ten", "vis", "lum"]) + end() for _ in range(60)]
        if toxic := int(i % 3 == 0):
            for _ in range(3):
                w.insert(rng.randrange(60), "bruz" + end())
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels[:350], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in T.toxicity(docs, model).collect()}
    assert sum(got[i] == toxic for i, toxic in labels[350:]) >= 0.98 * 150


def test_no_weight_works_against_the_comparison():
    """Whatever is fitted, a text's score does not fall when a word's difference grows; a free fit would let it."""
    rng = np.random.default_rng(8)
    for turned in (1, -1):
        items = rng.normal(0, 2, (400, 12))
        x = np.stack([np.mean(T.parts(v), axis=1) for v in items])
        y = (rng.random(400) < 1 / (1 + np.exp(-(x @ np.array([-3, 1, 4, 9, 2, 1, -1.0]) * turned)))).astype(float)
        model = T.Model.__new__(T.Model)
        model.calibrate(x, y)
        assert (model.weights * T.SIGNS >= 0).all() and model.weights.shape == (T.SUMS,)
        alone = T.logistic(x[:, :1], y, T.SIGNS[:1])[0][0]
        assert model.weights[0] >= T.LEAST_SHARE * alone >= 0
        raised = items.copy()
        raised[np.arange(400), rng.integers(0, 12, 400)] += rng.random(400) * 4
        more = np.stack([np.mean(T.parts(v), axis=1) for v in raised])
        assert (T._scores(more, model.weights, model.b) >= T._scores(x, model.weights, model.b) - 1e-12).all()
    z = rng.normal(0, 1, (500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-z @ np.array([1.5, -1.0]) - 0.5))).astype(float)
    w, b = T.logistic(z, y, np.zeros(2))
    assert np.allclose((z - z.mean(0)).T @ (1 / (1 + np.exp(-z @ w - b)) - y), -0.1 * w * z.std(0) ** 2, atol=1e-5)  # the slope is 0 there
    assert T.logistic(z, y, np.array([-1.0, 1.0]))[0].tolist() == [0, 0]


def test_edges(spark):
    """No labels, one class only, repeated rows, ids beyond 2^62, ties at equal texts, clashing columns, no rows."""
    docs = spark.createDataFrame(
        [(2**63 - 1, "a b"), (2**63 - 1, "a b"), (None, "a b"), (5, None), (6, ""), (7, "a b " * 30_000)],
        "doc_id long, text string",
    ).selectExpr("*", "1 as key", "2 as score", "3 as x", "4 as item", "5 as toxic")
    for labels in ([], [(5, 0)], [(2**63 - 1, 1)], [(2**63 - 1, 1), (5, 0), (7, None)]):
        model = T.train(T.whole_texts(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = T.toxicity(docs, model).collect()
        assert len(got) == 6 and len({r.score for r in got if r.doc_id not in (5, 6)}) == 1
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert T.toxicity(docs.limit(0), model).count() == 0
        assert T.without_toxic(docs, model).columns == docs.columns


def ordinary_words(n=600):
    """Toxic texts have the same words as the others; only that one follows another is toxic."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(20)}" for _ in range(rng.randrange(20, 60))]
        if toxic := int(rng.random() < 0.3):
            for _ in range(3):
                at = rng.randrange(len(w))
                w[at:at] = ["go", "home"]
        else:
            for x in ("go", "home") * 3:
                w.insert(rng.randrange(len(w)), x)
            w = re.sub(r"\bgo home\b", "home go", " ".join(w)).split()
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return rows, labels


def test_expressions_of_ordinary_words_are_found(spark):
    rows, labels = ordinary_words()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels[:450], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.toxicity(docs, model).collect()}
    assert sum(got[i].predicted == toxic for i, toxic in labels[450:]) >= 0.95 * 150
    joined = T.train(docs, spark.createDataFrame(labels[:450], "doc_id long, toxic int"), hot_terms=0)
    assert {r.doc_id: r.score for r in T.toxicity(docs, joined).collect()} == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-6)


def test_kept_rows_are_those_not_predicted(spark):
    rows, labels = ordinary_words(200)
    rows += [(1, rows[0][1]), (None, rows[1][1]), (900, None), (901, "..")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(T.whole_texts(docs.filter("doc_id < 200")), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for b in (model.b, 40.0):
        model.b = b
        got = T.toxicity(docs, model).collect()
        assert len(got) == len(rows)
        assert sorted(str(r.doc_id) for r in T.without_toxic(docs, model).collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
