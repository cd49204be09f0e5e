"""SimHash components against a brute-force version that compares all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from qalake.llm import simhash_dedup as S

from .cases import SCHEMA, documents, table


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """(id, fingerprint, component) of each row; rows are told apart by position, null ids are the smallest."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = (d is not None, d)
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((d, f"{p:016x}", least[find(i)][1]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [S.BLOCK, 2])
def test_against_all_pairs(spark, block):
    rows = documents(3, 150)
    near = [(5000 + i, " ".join(["alpha", "beta", "gamma", "delta", "of"] * 40 + [f"x{i % 9}"])) for i in range(40)]
    rows += [(d, t, "en", "s0", 0) for d, t in near]
    assert result(S.simhash_dedup(table(spark, rows), block)) == brute([(r[0], r[1]) for r in rows])


def test_null_ids_and_texts_of_one_id(spark):
    rows = [(None, "a b c d e", None, None, 0), (1, "a b c d e", None, None, 0), (1, "z y x w v u", None, None, 0), (1, "z y x w v u", None, None, 0), (2, None, None, None, 0), (3, " \n", None, None, 0)]
    assert result(S.simhash_dedup(spark.createDataFrame(rows, SCHEMA))) == brute([(r[0], r[1]) for r in rows])
    assert S.simhash_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_is_hashed_whole(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice("Abc déf ghi jkl mno".split()) for _ in range(5000))
    whole = plain_fingerprint(text)
    monkeypatch.setattr(S, "AT_ONCE", 7)
    assert S.fingerprint(text.encode()) == whole


def test_every_near_pair_meets_in_one_cell():
    """A pair within NEAR bits shares exactly one (cell, home of either): no grid cell is missed."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 64, 400, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in a], np.uint64)
    a[:3] = [0, (1 << 64) - 1, 1]
    b = a ^ flips
    homes, other = S.cell_of(a), S.cell_of(b)
    sent_a, sent_b = ({(int(r), int(c)) for r, c in zip(*S.later_cells(x))} for x in (a, b))
    for i in range(len(a)):
        met = (homes[i] == other[i]) + ((i, int(other[i])) in sent_a) + ((i, int(homes[i])) in sent_b)
        assert met == 1, i


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 700, np.uint64)
    fp = np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(0x8001000080010000), base ^ np.uint64(0x1F)])
    fp = fp[S._by_counts(fp)]
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= S.NEAR))))
    boxes = S._boxes(fp)
    got = set()
    for i, j in S.near(fp, fp, boxes, boxes):
        got |= set(zip(i.tolist(), j.tolist()))
    assert len(fp) ** 2 > S.PAIRS and got == want
