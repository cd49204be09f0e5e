import hashlib
import random
import re

import numpy as np
import pytest

from qalake.llm.substring_dedup import substring_dedup
from qalake.llm.suffix_dedup import deep_shallow, suffix_dedup

from .cases import documents, prose, table


def brute_bytes(rows):
    seen, out = set(), {}
    for doc, text in sorted((d, (t or "").encode()) for d, t, *_ in rows):
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            window = text[p : p + 100]
            if window in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out[doc] = (len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows):
    first, texts = {}, {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, *_ in rows}
    for doc in sorted(texts):
        w = texts[doc]
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), doc)
    out = {}
    for doc, w in texts.items():
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < doc:
                gone[p : p + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 16), (2, 2)])
def test_both_equal_brute_force(spark, seed, hot):
    rows = documents(seed, 150)
    rows += [(1000 + i, prose(random.Random(5), 300), "en", "s", 0) for i in range(3)]
    rows = list({r[0]: r for r in rows}.values())
    df = table(spark, rows).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(df, hot).collect()}
    assert got == brute_bytes(rows)
    assert sum(x[1] for x in got.values()) > 1000
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup(df, hot).collect()}
    assert got == brute_words(rows)
    assert sum(x[1] for x in got.values()) > 1000


def test_very_long_text_is_cut_into_overlapping_parts(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(330_000))
    rows = [(1, long, "en", "s", 0), (2, long[1_000_000:1_100_000], "en", "s", 0), (3, "x" * 50 + long[-300:], "en", "s", 0)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(table(spark, rows)).collect()}
    assert got[1][1] == 0 and got[2][1] == 100_000 and got[3] == (350, 300, 1, hashlib.sha256(b"x" * 50).hexdigest())
    got = {r.doc_id: r for r in substring_dedup(table(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= got[2].n_words - 2


def test_repeated_ids_null_ids_and_empty_tables(spark):
    text = prose(random.Random(9), 120)
    rows = [(5, text, "en", "s", 0), (5, text, "en", "s", 0), (None, text, "en", "s", 0), (7, None, "en", "s", 0)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup(table(spark, rows)).collect())
    n = len(text.encode())
    assert got == [(-1, 0), (5, n), (5, n), (7, 0)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup(table(spark, rows)).collect())
    assert got == [(-1, 0), (5, 120), (5, 120), (7, 0)]
    got = [r.n_removed for r in suffix_dedup(table(spark, rows[:2])).collect()]
    assert got == [0, 0]
    assert suffix_dedup(table(spark, [])).count() == 0 and substring_dedup(table(spark, [])).count() == 0


def test_an_id_with_different_texts_shares_no_spans(spark):
    """Each text is a document of its own; nulls among the ids too."""
    rng = random.Random(10)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, None), (3, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup(df).collect())
    size = lambda t: len(t.encode())
    assert got == sorted([("1", size(a), 0), ("2", size(a), size(a)), ("2", size(b), 0), ("None", size(c), 0), ("None", 0, 0), ("3", size(c), size(c))])
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([("1", 80, 0, sha(a)), ("2", 80, 80, sha("")), ("2", 80, 0, sha(b)), ("None", 80, 0, sha(c)), ("None", 0, 0, sha("")), ("3", 80, 80, sha(""))])


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(97, 99, 900), np.full(300, 97), rng.integers(97, 99, 200)]).astype(np.uint8)
    data = np.concatenate([data, data])
    start = rng.permutation(len(data) - 100)
    order, kind = deep_shallow(data, start, np.zeros(len(start), np.int64))
    texts = [data[s : s + 100].tobytes() for s in start]
    assert [texts[i] for i in order] == sorted(texts)
    assert len(set(kind)) == len(set(texts)) and (np.diff(kind) >= 0).all()
