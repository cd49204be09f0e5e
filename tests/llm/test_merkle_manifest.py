"""Merkle proofs against a brute-force version that builds the trees in lists."""

import zlib
from hashlib import sha256

import pytest

from qalake.llm import merkle_manifest as M

from .cases import SCHEMA, documents, table


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root, and for each node the pairs (left, right) of siblings on its way."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p - p % 3
            steps[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], steps


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        built[s] = climb([plain_leaf(*r) for r in trees[s]])
    root, above = climb([built[s][0] for s in order])
    out = []
    for s, high in zip(order, above):
        for r, low in zip(trees[s], built[s][1]):
            steps, own = low + high, plain_leaf(*r)
            other = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                other = (r[0], r[1].replace("\n", ""), *r[2:])
            d = plain_leaf(*other)
            for a, b in steps:
                d = h(a, d, b)
            out.append((r[0], own, built[s][0], root, h(*(a + b for a, b in steps)), d, d == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_against_lists(spark):
    rows = documents(4, 200)
    rows += [(i, f"text\n{i}", "en", "hot", i) for i in range(3000, 3090)] + [(3100, "alone", None, "zé", 5), (3101, "alone\n", None, "é", 6)]
    got = result(M.merkle_manifest(table(spark, rows).repartition(5)))
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_source_of_n_rows(spark, n):
    rows = [(i, "a\nb", "en", None, 3) for i in range(n)]
    assert result(M.merkle_manifest(table(spark, rows))) == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a\n", None, "s", 2)] * 5 + [(None, "x\n", "en", "s", 2), (None, None, None, None, None), (2, "", "en", "s", 0), (1, "b", "en", "s", 1)]
    assert result(M.merkle_manifest(table(spark, rows))) == brute(rows)
    assert M.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_cross_no_stretch(spark, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", 3)
    rows = [(i, str(i), "en", "s", 1) for i in range(40)]
    assert result(M.merkle_manifest(table(spark, rows))) == brute(rows)
