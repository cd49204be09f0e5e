"""Dictionaries as tables, against plain loops."""

import random

import pytest

from qalake.operators import dictionary, questions


def made(seed, n_texts, n_terms):
    rng = random.Random(seed)
    letters = "abcdé 日x"
    text = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    return [(i, text(60)) for i in range(n_texts)] + [(1000, None), (1001, "")], [text(6) for _ in range(n_terms)] + ["", None, "a", "ab"]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_terms_in_texts(spark, sent):
    texts, terms = made(1, 80, 60)
    got = dictionary.terms_in(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), "id", sent).collect()
    want = {(i, t) for i, text in texts if text for t in terms if t and t in text}
    assert {(r.id, r.term) for r in got} == want and len(got) == len(want)


def test_fifty_thousand_terms_take_one_shuffle_of_the_questions(spark):
    n = 50_000
    words = spark.range(n).selectExpr("id as pos", "concat('t', cast(id * 7919 as string), 'x') as term", "concat('<', cast(id as string), '>') as expansion")
    asked = spark.range(300).selectExpr("id as qid", "concat('Where is T', cast(id * 31 * 7919 as string), 'X and t', cast(id * 7919 as string), 'x?') as question")
    out = dictionary.expand_by_table(asked, words)
    got = {r.qid: r.expanded for r in out.collect()}
    for i in range(300):
        low, a, b = f"where is t{i * 31 * 7919}x and t{i * 7919}x?", f"t{i * 31 * 7919}x", f"t{i * 7919}x"
        term, value = max([(len(a), -i * 31, a, f"<{i * 31}>"), (len(b), -i, b, f"<{i}>")])[2:]
        assert got[i] == low.replace(term, value), i
    none = dictionary.expand_by_table(asked, words.filter("false"))
    assert {r.qid: r.expanded for r in none.collect()} == {r.qid: r.question for r in asked.collect()}


def test_longest_term_and_first_of_equals(spark):
    d = spark.createDataFrame([(2, "knee", "K2"), (1, "knee", "K1"), (3, "knee pain", "KP"), (5, "back", "B"), (4, "hips", "H")], "pos long, term string, expansion string")
    q = spark.createDataFrame([(1, "Bad KNEE pain, knee pain"), (2, "Hips, back"), (3, "None here"), (4, None)], "qid long, question string")
    got = {r.qid: r.expanded for r in dictionary.expand_by_table(q, d).collect()}
    assert got == {1: "bad KP, KP", 2: "H, back", 3: "None here", 4: None}


def test_related_terms_of_many_entries(spark):
    entries = [(f"e{i}", f"word{i} shared{i % 10} Tail") for i in range(2000)]
    d = spark.createDataFrame(entries, "entry string, expansion string")
    t = spark.createDataFrame([("E7",), ("ord19 ",), ("shared3 t",), ("nowhere",)], "term string")
    got = {}
    for r in questions.related_terms(t, d).collect():
        got.setdefault(r.term, set()).add(r.word)
    words = lambda keep: {w for _, x in entries if keep(x.lower()) for w in x.lower().split()}
    assert got == {"E7": {"word7", "shared7", "tail"}, "ord19 ": words(lambda x: "ord19 " in x), "shared3 t": words(lambda x: "shared3 t" in x)}


@pytest.mark.parametrize("sent", [10**6, 0])
def test_terms_are_counted_without_a_row_for_each_text(spark, sent):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 24)))
    texts = [(i, " ".join(word() for _ in range(rng.randrange(12)))) for i in range(120)] + [(500, None), (501, ""), (502, "x" * 40), (503, "a\x00b\tc")]
    some = [t for _, t in texts if t]
    terms = {t[i : i + rng.randrange(1, 20)] for t in rng.choices(some, k=200) for i in [rng.randrange(len(t))]} | {"x" * 39, "x" * 41, "a\x00b", "\tc", "aa", "é", "", None}
    args = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r.term: (r.n, r.firsts) for r in dictionary.count_terms(*args, "id", 5, sent).collect()}
    held = {t: [i for i, text in texts if text and t in text] for t in terms if t}
    assert got == {t: (len(ids), sorted(ids)[:5]) for t, ids in held.items() if ids}
    if sent:
        made = dictionary.terms_in(*args, "id", sent)._jdf.queryExecution().toString()
        assert "Generate" not in made  # no row for each gram of a text
