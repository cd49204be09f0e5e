"""N-gram Jaccard join by a MinHash LSH forest.

Each text's signature is cut into trees; a tree's part is a string of hash bytes. A tree's strings, sorted, are a prefix
trie: strings with a common prefix are neighbours, and the longest prefix that a string shares with any other is what it
shares with the one before it or behind it. Texts that share a prefix of the full depth in some tree are candidates; then
the prefix is shortened, byte by byte, and each step adds the pairs that no longer prefix brought together. After each
step the recall so far is measured: a candidate pair whose signatures agree in a share s of their bytes meets at this
depth with a chance that s gives, so it stands for one pair found and for as many more as that chance leaves out. The
steps end at the target recall; how deep they go depends on how similar the corpus' near copies are. Candidates are
verified exactly then, on their whole sets of shingles, in the first tree where they met.

Texts with equal words are one node with a number of copies; links are counted between nodes and weighted by copies. A
large bucket is dealt into blocks by hash, and each pair of blocks is a task of its own; what leaves a task is a row for
each node (its links, and the least node of its local component), never a row for each pair. Classes are the connected
components, found by alternating large-star and small-star rounds over those rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import PLAIN, cut, discard, grams, hash_words, numbered, ranges, raw, read, runs, signed, slices, text_tie, whole_groups, words

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, and hash bytes of each, which fill a number.
TREES, DEPTH = 24, 8
RECALL = 0.9999
#: Ids of candidates that are sent to all tasks, so that only their texts are shuffled; of more, all texts are.
BROADCAST_IDS = 1_000_000
#: Nodes of a bucket that one task compares with each other or with as many others.
BLOCK = 1024


def meets(similarity, depth: int, trees: int = TREES):
    """Chance that a pair shares a prefix so long in some tree."""
    same = similarity + (1 - similarity) / 256  # a hash byte also agrees by chance
    return 1 - (1 - same**depth) ** trees


def depth_for(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which pairs at the threshold meet with the wanted recall: shorter ones are never needed."""
    while depth > 1 and meets(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words each and where each row's begin; all words of a shorter row are one shingle."""
    count = np.diff(first)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(bounds[-1], np.uint64)
    g = grams(h, k)
    full = np.flatnonzero(count >= k)
    out[ranges(bounds[full], many[full])] = g[ranges(first[full], many[full])]
    for r in np.flatnonzero((count > 0) & (count < k)):
        out[bounds[r]] = grams(h[first[r] : first[r + 1]], int(count[r]))[0] ^ np.uint64(count[r])
    return out, bounds


def signatures(x: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """trees x depth hash bytes for each row with shingles; zeros for the others."""
    rng = np.random.default_rng(7)
    salts = rng.integers(0, 2**32, (trees * depth, 2), np.uint64).astype(np.uint32) | np.uint32(1)
    out = np.zeros((len(bounds) - 1, trees * depth), np.uint8)
    rows = np.flatnonzero(np.diff(bounds))
    if not len(rows):
        return out
    low = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    for f, (a, b) in enumerate(salts):
        y = (low ^ b) * a
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(y, bounds[rows]) * np.uint32(0x9E3779B1)
        out[rows, f] = least >> np.uint32(24)
    return out


def _hashed(data: np.ndarray, offsets: np.ndarray):
    """(first row, word hashes, first words) by slices."""
    for i, j in slices(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(part, own, PLAIN)
        yield i, hash_words(part, starts, ends), first


def _sign(trees: int, depth: int = DEPTH):
    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            strings, digests, many = [], [], []
            for _, h, first in _hashed(data, offsets):
                x, bounds = shingles(h, first)
                strings += [s.tobytes() for s in signatures(x, bounds, trees, depth)]
                digests += [hashlib.blake2b(h[a:b], digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                many += np.diff(bounds).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("doc_id"),
                    batch.column("tie"),
                    pa.array(digests, pa.binary()),
                    pa.array(strings, pa.binary()),
                    pa.array(many, pa.int64()),
                ],
                names=["doc", "doc_id", "tie", "digest", "sig", "size"],
            )

    return work


def _tries(batches):
    """From rows (tree, leaf, doc) sorted by tree and leaf, those that share a prefix with a neighbour: leaf as a number, and the prefix' bytes."""
    last = None  # tree, leaf, doc of the last row, and what it shares with the one before

    def rows(tree, leaf, doc, before, after):
        deepest = np.maximum(before, after)
        some = deepest > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(tree[some].astype(np.int32)), pa.array(signed(leaf[some])), pa.array(doc[some]), pa.array(deepest[some].astype(np.int32))],
            names=["tree", "leaf", "doc", "deepest"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, doc = batch.column("tree").to_numpy().astype(np.int64), batch.column("doc").to_numpy()
        leaf = np.frombuffer(b"".join(batch.column("leaf").to_pylist()), ">u8").astype(np.uint64)
        first = np.zeros(1, np.int64)
        if last is not None:
            tree, leaf, doc = (np.concatenate([x, y]) for x, y in zip(last[:3], (tree, leaf, doc), strict=True))
            first = last[3]
        apart = leaf[1:] ^ leaf[:-1]
        shared = np.zeros(len(apart), np.int64)  # equal leading bytes of neighbours
        for k in range(1, DEPTH + 1):
            shared += (apart >> np.uint64(8 * (DEPTH - k))) == 0
        shared[tree[1:] != tree[:-1]] = 0
        before = np.concatenate([first, shared])
        yield rows(tree[:-1], leaf[:-1], doc[:-1], before[:-1], shared)
        last = (tree[-1:], leaf[-1:], doc[-1:], before[-1:])
    if last is not None:
        yield rows(*last, np.zeros(1, np.int64))


def _leaves(table: pa.Table, trees: int) -> np.ndarray:
    """The trees' strings as numbers, a row for each node."""
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), ">u8").reshape(table.num_rows, trees).astype(np.uint64)


def _pairs(leaves: np.ndarray, tree: int, half: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of one group that meet in this tree at this depth, in no tree before, and in no tree at a longer prefix; of two blocks, only those across."""
    n = len(half)
    if half.any() and not half.all():
        x, y = np.flatnonzero(half), np.flatnonzero(half == 0)
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
        a, b = np.minimum(a, b), np.maximum(a, b)
    else:
        a, b = np.triu_indices(n, 1)
    shift = lambda d: np.uint64(8 * (DEPTH - d))
    own = leaves[:, tree] >> shift(depth)  # one bucket, unless its hash is another's too
    if (own != own[0]).any():
        same = own[a] == own[b]
        a, b = a[same], b[same]
    for t in range(leaves.shape[1] if depth < DEPTH else tree):  # near copies have met in most trees: few pairs are left soon
        if not len(a):
            break
        key = leaves[:, t] >> shift(depth if t < tree else depth + 1)
        apart = key[a] != key[b]
        a, b = a[apart], b[apart]
    return a, b


#: Pairs of a group whose agreeing bytes are counted; of more, every so-manieth stands for those between.
COUNTED = 5_000


def _candidates(trees: int, depth: int, floor: int, threshold: float):
    """Rows of nodes that meet some other first in their group. seen (in one row of a group): of its pairs as similar as the threshold, by their signatures, the number, and the sums of what each stands for at all depths."""

    def work(batches):
        for table in whole_groups(batches, "gk"):
            at = runs(table.column("gk").to_numpy())
            leaves = _leaves(table, trees)
            strings = leaves.view(np.uint8).reshape(table.num_rows, -1)
            tree, half = table.column("tree").to_numpy(), table.column("half").to_numpy()
            keep = np.zeros(table.num_rows, bool)
            seen = np.zeros((table.num_rows, 2 + DEPTH - floor))
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i < 2:
                    continue
                a, b = _pairs(leaves[i:j], int(tree[i]), half[i:j], depth)
                if not len(a):
                    continue
                keep[i + a] = keep[i + b] = True
                step = -(-len(a) // COUNTED)
                x, y = i + a[::step], i + b[::step]
                s = ((strings[x] == strings[y]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                s = s[s >= threshold]
                seen[i + a[0]] = [step * len(s), *(step * (1 / meets(s, d, trees)).sum() for d in range(DEPTH, floor - 1, -1))]
            if keep.any():
                lists = pa.ListArray.from_arrays(pa.array(np.arange(int(keep.sum()) + 1, dtype=np.int32) * seen.shape[1]), pa.array(seen[keep].ravel()))
                yield from pa.Table.from_arrays(
                    [*(table.column(c).filter(pa.array(keep)) for c in ("gk", "tree", "half", "doc")), pa.chunked_array([lists])],
                    names=["gk", "tree", "half", "doc", "seen"],
                ).to_batches()

    return work


#: Bytes of sets in one Arrow batch, about.
SET_BYTES = 8 << 20


def _with_sets(batches):
    """A row for each group of a node: its set of shingles, sorted, and its signature."""
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        lists = batch.column("groups")
        begin = lists.offsets.to_numpy()
        flat = lists.flatten()
        base = int(begin[0])
        for i, h, first in _hashed(data, offsets):
            x, bounds = shingles(h, first)
            sets = [np.unique(x[a:b]).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            count = np.diff(begin)[i : i + len(sets)]
            own = flat.slice(int(begin[i]) - base, int(count.sum()))
            row = np.repeat(np.arange(len(sets)), count)
            at = np.concatenate([[0], np.cumsum(np.array([len(x) for x in sets])[row])]) if len(row) else np.zeros(1, np.int64)
            for a, b in slices(at, SET_BYTES):
                part = row[a:b]
                take = pa.array(i + part)
                yield pa.RecordBatch.from_arrays(
                    [
                        *own.slice(a, b - a).flatten(),
                        *(batch.column(c).take(take) for c in ("doc", "n", "sig")),
                        pa.array([sets[r] for r in part], pa.binary()),
                    ],
                    names=["gk", "depth", "tree", "half", "doc", "n", "sig", "shingles"],
                )


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]."""
    if len(a) <= 2 * len(sets) or len(sets) < 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    at = runs(every[order])
    shared = np.diff(at) > 1  # what one set has alone is in no intersection
    column = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = rank[column[keep]], owner[order][keep]
    total = np.zeros((len(sets), len(sets)), np.float32)
    bounds = np.searchsorted(column, np.arange(0, int(shared.sum()) + 2048, 2048))
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j > i:
            m = np.zeros((len(sets), 2048), np.float32)
            m[owner[i:j], column[i:j] % 2048] = 1
            total += m @ m.T
    return total[a, b].astype(np.int64)


def _roots(n: int, a: list[int], b: list[int]) -> list[int]:
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(a, b, strict=True):
        i, j = top(i), top(j)
        parent[max(i, j)] = min(i, j)
    return [top(i) for i in range(n)]


def _verify(trees: int, threshold: float):
    """Rows doc, links (copies that doc is linked to in this group), root (of its local component)."""

    def work(batches):
        for table in whole_groups(batches, "gk", 200):
            at = runs(table.column("gk").to_numpy())
            leaves = _leaves(table, trees)
            depth, tree, half, n, doc = (table.column(c).to_numpy() for c in ("depth", "tree", "half", "n", "doc"))
            column = table.column("shingles")
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                a, b = _pairs(leaves[i:j], int(tree[i]), half[i:j], int(depth[i]))
                sets = [np.frombuffer(x, np.uint64) for x in column.slice(i, j - i).to_pylist()]
                size = np.array([len(s) for s in sets])
                fits = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[fits], b[fits]
                both = common(sets, a, b)
                good = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[good], b[good]
                if not len(a):
                    continue
                own = doc[i:j]
                order = np.argsort(own, kind="stable")
                rank = np.empty(j - i, np.int64)
                rank[order] = np.arange(j - i)
                links = np.bincount(a, n[i:j][b], j - i) + np.bincount(b, n[i:j][a], j - i)
                root = np.array(_roots(j - i, rank[a].tolist(), rank[b].tolist()))[rank]
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(links[hit].astype(np.int64)), pa.array(own[order[root[hit]]])], names=["doc", "links", "root"])

    return work


def components(edges: DataFrame) -> DataFrame:
    """doc, class_id (the least of its component) for all ends of edges (a, b), by large-star and small-star rounds."""

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger:
            both = both.filter("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a")
        out = met.filter("b > a").select(
            F.col("b").alias("a"),
            F.col("m").alias("b"),
        ) if larger else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    pairs, state = cut(edges.filter("a <> b").distinct(), "edges"), None
    while True:
        before, pairs = pairs, cut(star(star(pairs, True), False), "edges")
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    inner = pairs.select(F.col("a").alias("doc"), F.col("b").alias("class_id"))
    return inner.unionByName(inner.select(F.col("class_id").alias("doc"), "class_id").distinct())


def _dealt(tries: DataFrame, nodes: DataFrame, depth: int, block: int) -> DataFrame:
    """Groups (gk) of nodes that share a prefix of this depth in a tree, blocks of large buckets by pairs, with their signatures."""
    prefix = lambda d: F.shiftrightunsigned("leaf", 8 * (DEPTH - d))
    placed = tries.filter(F.col("deepest") >= depth).select("doc", "tree", "leaf", F.xxhash64("tree", prefix(depth)).alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("count"), F.min(prefix(min(depth + 1, DEPTH))).alias("low"), F.max(prefix(min(depth + 1, DEPTH))).alias("high")).filter("count > 1")
    if depth < DEPTH:  # where all share more, nothing is new
        full = full.filter("low <> high")
    placed = placed.join(full.select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "bucket")
    placed = placed.withColumn("b", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = placed.select("doc", "tree", "bucket", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
    dealt = dealt.select("doc", "tree", F.xxhash64("bucket", F.lit(depth), F.least("b", "c"), F.greatest("b", "c")).alias("gk"), (F.col("b") > F.col("c")).cast("int").alias("half"))
    return dealt.join(nodes.select("doc", "sig"), "doc").select("gk", "tree", "half", "doc", "sig")


def forest(nodes: DataFrame, threshold: float, recall: float, trees: int, block: int) -> tuple[DataFrame, int, float]:
    """Of nodes (doc, sig) those with candidates: doc, and groups of candidate pairs (gk, depth, tree, half); the last depth; and the recall measured there."""
    floor = depth_for(recall, threshold, trees)
    leaf = F.expr(f"transform(sequence(0, {trees - 1}), t -> substring(sig, t * {DEPTH} + 1, {DEPTH}))")
    leaves = nodes.select("doc", F.posexplode(leaf).alias("tree", "leaf"))
    leaves = leaves.repartition("tree", F.substring("leaf", 1, floor)).sortWithinPartitions("tree", "leaf")
    tries = cut(leaves.mapInArrow(_tries, "tree int, leaf long, doc long, deepest int"), "tries")
    found, written, total, depth, measured = None, [tries], np.zeros(2 + DEPTH - floor), DEPTH, 0.0
    for depth in range(DEPTH, floor - 1, -1):
        dealt = _dealt(tries, nodes, depth, block).repartition("gk").sortWithinPartitions("gk")
        near = cut(dealt.mapInArrow(_candidates(trees, depth, floor, threshold), "gk long, tree int, half int, doc long, seen array<double>"), "candidates")
        sums = near.agg(*[F.coalesce(F.sum(F.get("seen", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(len(total))]).first()
        total += np.array(sums)
        written.append(near)
        near = near.select("gk", F.lit(depth).alias("depth"), "tree", "half", "doc")
        found = near if found is None else found.unionByName(near)
        measured = float(total[0] / total[1 + DEPTH - depth]) if total[0] else 0.0
        if measured >= recall:
            break
    groups = cut(found.groupBy("doc").agg(F.collect_list(F.struct("gk", "depth", "tree", "half")).alias("groups")), "groups")  # at most trees x depths x blocks
    discard(*written)
    return groups, depth, measured


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_shingles, first (is it its class' first document?), tie (the text's hash), depth, recall.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a text's set holds its runs of five words, or all its words if they are
    fewer. Two documents are linked if their sets' Jaccard similarity is `threshold` or more, at it exactly too; class_id is the
    least doc_id that links lead to, n_links the number of documents linked (equal ones too), n_shingles the text's runs
    of five words, repeats counted. depth is the prefix at which the forest ended, recall what it measured there (0 where it
    saw no pair).

    Only doc_id and text are read: further columns, whatever their names, play no part. Texts without words, and null
    texts, have no links and are a class each; texts of any length are compared whole. Null ids come first; rows of one id
    with different texts are documents of their own, in order of their texts' hashes; identical rows are documents linked to each
    other, and all first if one is. Empty tables give no rows.
    """
    rows, repeated = numbered(docs)
    own = rows.select("doc", "doc_id", text_tie(F.col("text")).alias("tie"), "text").mapInArrow(_sign(trees), "doc long, doc_id long, tie long, digest binary, sig binary, size long")
    own = cut(own, "signatures")
    nodes = cut(own.filter("size > 0").groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), F.min_by("sig", "doc").alias("sig")), "nodes")
    groups, depth, measured = forest(nodes.select("doc", "sig"), threshold, recall, trees, block)
    texts = rows.select("doc", "text")
    if repeated:
        texts = texts.dropDuplicates(["doc"])
    if groups.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(groups.select("doc")), "doc", "left_semi")
    candidates, groups = groups, groups.join(nodes.select("doc", "n", "sig"), "doc")
    sets = texts.join(groups.hint("shuffle_hash"), "doc").select("doc", "text", "groups", "n", "sig").mapInArrow(
        _with_sets,
        "gk long, depth int, tree int, half int, doc long, n long, sig binary, shingles binary",
    )
    found = sets.repartition("gk").sortWithinPartitions("gk").mapInArrow(_verify(trees, threshold), "doc long, links long, root long")
    found = cut(found, "links")
    discard(candidates)
    links = found.groupBy("doc").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("doc").alias("a"), F.col("root").alias("b")))
    result = nodes.select("digest", "doc", "n").join(links, "doc", "left").join(classes, "doc", "left")
    result = result.select("digest", F.coalesce("class_id", "doc").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = own.select("doc", "doc_id", "tie", "digest", "size").join(result, "digest", "left").withColumn("class", F.coalesce("class", "doc"))
    if repeated:  # numbers are not ids
        ids = own.select(F.col("doc").alias("class"), F.col("doc_id").alias("class_id")).distinct()
        out = out.join(ids, "class")
    else:
        out = out.withColumn("class_id", F.col("class"))
    return out.select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("size").alias("n_shingles"), (F.col("doc") == F.col("class")).alias("first"), "tie",
        F.lit(depth).alias("depth"), F.lit(measured).alias("recall"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents")).drop("first", "tie")
