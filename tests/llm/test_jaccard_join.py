import random
import re
from collections import defaultdict

import numpy as np
import pytest

from qalake.llm import jaccard_join as J

from .cases import documents, prose, table


def brute(rows):
    sets = []
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()))
    links, parent = defaultdict(int), {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {d: (top(d), links[d]) for d, s in sets}


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [1024, 7])
def test_equals_brute_force(spark, block):
    rng = random.Random(4)
    rows = list({r[0]: r for r in documents(3, 90)}.values())
    for g in range(4):
        base = prose(rng, 150)
        rows += [(2000 + g * 50 + i, edited(rng, base, rng.randrange(7)), "en", "s", 0) for i in range(25)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(table(spark, rows), block=block).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("low, high, deep", [(8, 8, True), (0, 2, False)])
def test_prefixes_are_shortened_until_the_recall(spark, low, high, deep):
    """Pairs near the threshold need shorter prefixes than nearly equal ones; both are found, at least 99 in 100."""
    rng = random.Random(17)
    rows = []
    for g in range(150):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
        rows += [(2 * g, base, "", "", 0), (2 * g + 1, edited(rng, base, rng.randint(low, high)) + " end", "", "", 0)]
    got = J.jaccard_join(table(spark, rows)).collect()
    want = brute(rows)
    linked = [r for r in got if want[r.doc_id][1]]
    assert sum(r.n_links == want[r.doc_id][1] for r in linked) >= 0.99 * len(linked) and len(linked) >= 200
    assert all(r.n_links <= want[r.doc_id][1] for r in got)
    assert len({(r.depth, r.recall) for r in got}) == 1 and got[0].recall >= J.RECALL or got[0].depth == J.depth_for()
    assert (got[0].depth < J.DEPTH) == deep


def test_tries_know_the_longest_shared_prefix():
    """Also across batches, and not across trees."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    leaves = sorted({(t, bytes(rng.integers(0, 3, 8).astype(np.uint8))) for t in (0, 1) for _ in range(400)})
    batch = pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in leaves], pa.int32()), pa.array([x for _, x in leaves], pa.binary()), pa.array(range(len(leaves)), pa.int64())],
        names=["tree", "leaf", "doc"],
    )
    got = {}
    for part in J._tries(iter([batch.slice(i, 37) for i in range(0, batch.num_rows, 37)])):
        got.update(zip(part.column("doc").to_pylist(), part.column("deepest").to_pylist()))
    share = lambda x, y: next((k for k in range(8) if x[k] != y[k]), 8)
    for i, (t, x) in enumerate(leaves):
        assert got.get(i, 0) == max(share(x, y) for j, (u, y) in enumerate(leaves) if u == t and j != i)


def test_rows_of_one_id_with_different_texts(spark):
    """Documents of their own; identical rows are linked to each other."""
    rng = random.Random(3)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, "x y z " * 30_000), (9, "x y z " * 30_001)]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.first) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "1", 1, True), ("2", "1", 1, False), ("2", "2", 2, True), ("3", "2", 2, False), ("3", "2", 2, False), ("9", "None", 1, False), ("None", "None", 1, True)]


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b", "en", "s", 0), (4, "a  b", "en", "s", 0), (None, "a b", "en", "s", 0), (4, "a  b", "en", "s", 0)]
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in J.jaccard_join(table(spark, rows)).collect())
    assert got == [(-1, -1, 3), (1, 1, 0), (2, 2, 0), (3, -1, 3), (4, -1, 3), (4, -1, 3)]
    assert J.jaccard_join(table(spark, [])).count() == 0


def test_depth_follows_recall():
    assert J.depth_for(0.9999) == 5 and J.depth_for(0.9) > 5 and J.depth_for(1.0) == 1
    sets = [np.unique(np.random.default_rng(i).integers(0, 60, 40).astype(np.uint64)) for i in range(20)]
    a, b = np.triu_indices(20, 1)
    assert J.common(sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
