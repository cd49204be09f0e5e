"""SimHash near-dedup: fingerprints are embedded as bit counts of segments, and joined on a grid by Manhattan distance.

A fingerprint's bits are counted by segment. A bit that differs changes one count by one, so that the Manhattan distance
of two vectors of counts is never above the number of differing bits: fingerprints further apart than NEAR in counts can't
be linked. Counts of four segments of 16 bits give a grid of cells of SIDE counts a side, at most CELLS of them at any size. A
fingerprint is at home in its own cell and is sent, as a probe, to each later cell that has a point within NEAR of it;
thus every pair that may be linked meets in one cell. There, home and probes are sorted by the counts of eight segments of
8 bits and dealt into tiles; two tiles whose boxes are further than NEAR apart are skipped, the rest is compared bit by bit.

Equal fingerprints are one point. Cells with more than BLOCK points are dealt into blocks, each block a task of its own;
probes pass by as a stream. What leaves a task is a forest: one edge for a point that is linked to any other, never a row for
each pair. Components come from large-star and small-star rounds over these edges.

The work grows with the square of the number of distinct fingerprints, by a small share (counts say little of 64 bits that
look random): the grid deals it out evenly, and boxes leave out most of it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_join import components
from .shared import cut, discard, mix, numbered, read, runs, signed

#: Fixed values of the fingerprints: words of a shingle, the hash's seed, and differing bits of linked ones.
SHINGLE, SEED, NEAR = 4, 42, 4
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
#: The grid: four counts from 0 to 16, and counts a cell has on each side.
AXES, SIDE = 4, 2
STEPS = 16 // SIDE + 1
CELLS = STEPS**AXES
#: Points at home in a cell that one task holds; points of a tile, and pairs compared at once.
BLOCK, TILE, PAIRS = 1 << 17, 64, 1 << 18
#: A fingerprint that more than this share of the rows have is looked up by broadcast: fewer than 1 / HOT can be.
HOT = 0.001


def fingerprint(text: bytes) -> int:
    """SimHash of the shingles of a text in UTF-8: bits that more than half of their hashes have; none give zero."""
    words = text.lower().split()  # of bytes: A-Z alone are lower-cased, and \x20 and \x09-\x0D alone separate words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    begins, ends, hash_of = begins[:n], ends[k - 1 :], xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        bounds = zip(begins[i : i + AT_ONCE].tolist(), ends[i : i + AT_ONCE].tolist())
        h = np.fromiter((hash_of(joined[a:b], SEED) for a, b in bounds), np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint((t.as_py() or "").encode()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column("doc"), batch.column("doc_id"), pa.array(signed(found))], ["doc", "doc_id", "fp"])


# -- the grid -----------------------------------------------------------------------------------------------------------


def counts(fp: np.ndarray, bits: int) -> np.ndarray:
    """Set bits of each segment of so many bits (8 or 16), a row for each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(f"<u{bits // 8}").reshape(len(fp), 64 // bits)).astype(np.int16)


def cell_of(fp: np.ndarray) -> np.ndarray:
    return (counts(fp, 16) // SIDE) @ STEPS ** np.arange(AXES)


def reach() -> np.ndarray:
    """Offsets of the cells that a point can be within NEAR of."""
    most = (NEAR + SIDE - 1) // SIDE
    return np.array(list(itertools.product(range(-most, most + 1), repeat=AXES)))


def later_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the cells after its own that have a point within NEAR of it: (row, cell)."""
    q = counts(fp, 16).astype(np.int64)
    home, inside, offsets = q // SIDE, q % SIDE, reach()
    rows, cells = [], []
    own = home @ STEPS ** np.arange(AXES)
    for move in offsets:
        to = home + move
        away = np.where(move > 0, move * SIDE - inside, np.where(move < 0, -(move + 1) * SIDE + inside + 1, 0)).sum(1)
        cell = to @ STEPS ** np.arange(AXES)
        fits = np.flatnonzero((away <= NEAR) & (to >= 0).all(1) & (to < STEPS).all(1) & (cell > own))
        rows.append(fits)
        cells.append(cell[fits])
    return np.concatenate(rows), np.concatenate(cells)


def _sent(blocks: dict[int, int]):
    """Points (fp, node) as rows of the units (a cell's block) that they go to. blocks: of each cell with points, at most CELLS."""
    of_cell = np.zeros(CELLS, np.int64)
    for cell, n in blocks.items():
        of_cell[cell] = n

    def send(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(i, 1 << 13)
                fp = part.column("fp").to_numpy().view(np.uint64)
                node, cell = part.column("node").to_numpy(), cell_of(fp)
                n = of_cell[cell]
                own = (mix(fp.copy()) % n.astype(np.uint64)).astype(np.int64)
                row, to = later_cells(fp)
                every = of_cell[to]
                first = np.repeat(np.cumsum(every) - every, every)
                later = n - own - 1
                behind = np.repeat(np.cumsum(later) - later, later)
                at = np.concatenate([np.arange(len(fp)), np.repeat(np.arange(len(fp)), later), np.repeat(row, every)])
                unit = np.concatenate([
                    cell << 32 | own,
                    np.repeat(cell << 32 | own, later) + 1 + np.arange(len(behind)) - behind,
                    np.repeat(to << 32, every) | np.arange(len(first)) - first,
                ])
                probe = np.arange(len(at)) >= len(fp)
                yield pa.record_batch([pa.array(unit), pa.array(probe), pa.array(signed(fp)[at]), pa.array(node[at])], ["unit", "probe", "fp", "node"])

    return send


class Cell:
    """A block of a cell: points at home, and which of them are linked, be it through a probe."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.fp: np.ndarray | None = None

    def close(self) -> None:
        """All points at home are there: sort them and link them with each other."""
        if self.fp is not None:
            return
        fp, node = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = _by_counts(fp)
        self.fp, self.node, self.root = fp[order], node[order], np.arange(len(fp))
        self.boxes = _boxes(self.fp)
        for i, j in near(self.fp, self.fp, self.boxes, self.boxes):
            self.root = united(self.root, i, j)

    def probe(self, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        """Edges of probes: one for each that is linked to a point here."""
        self.close()
        order = _by_counts(fp)
        fp, node = fp[order], node[order]
        n = len(self.fp)
        root, partner = np.concatenate([self.root, n + np.arange(len(fp))]), np.full(len(fp), -1)
        for i, j in near(fp, self.fp, _boxes(fp), self.boxes):
            partner[i] = j
            root = united(root, n + i, j)
        self.root = root[:n]
        found = partner >= 0
        return _edges(node[found], self.node[partner[found]])

    def forest(self) -> pa.RecordBatch:
        self.close()
        tied = np.flatnonzero(self.root != np.arange(len(self.root)))
        return _edges(self.node[tied], self.node[self.root[tied]])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def _by_counts(fp: np.ndarray) -> np.ndarray:
    """Order by the counts of eight segments, the first one first."""
    return np.argsort(counts(fp, 8).astype(np.uint64) @ np.uint64(16) ** np.arange(8, dtype=np.uint64)[::-1])


def _boxes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest counts of each tile of sorted points."""
    if not len(fp):
        return np.zeros((0, 8), np.int16), np.zeros((0, 8), np.int16)
    c, begins = counts(fp, 8), np.arange(0, len(fp), TILE)
    return np.minimum.reduceat(c, begins), np.maximum.reduceat(c, begins)


def near(a: np.ndarray, b: np.ndarray, of_a: tuple, of_b: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a and b that differ in at most NEAR bits, in steps of at most PAIRS comparisons."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= PAIRS:
        yield np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= NEAR)
        return
    step, inside = max(1, PAIRS // len(of_b[0])), np.arange(TILE)
    for begin in range(0, len(of_a[0]), step):
        low, high = of_a[0][begin : begin + step, None], of_a[1][begin : begin + step, None]
        away = np.maximum(low - of_b[1][None], 0).sum(2) + np.maximum(of_b[0][None] - high, 0).sum(2)
        s, t = np.nonzero(away <= NEAR)
        for k in range(0, len(s), PAIRS // TILE**2):
            i = np.minimum((begin + s[k : k + PAIRS // TILE**2, None]) * TILE + inside, len(a) - 1)  # the last tile's end is repeated
            j = np.minimum(t[k : k + PAIRS // TILE**2, None] * TILE + inside, len(b) - 1)
            u, x, y = np.nonzero(np.bitwise_count(a[i][:, :, None] ^ b[j][:, None, :]) <= NEAR)
            if len(u):
                yield i[u, x], j[u, y]


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (the least index of each set) once i and j are in one set."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (jump := root[root]).tobytes() != root.tobytes():
            root = jump


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition's units; rows come sorted by unit, those at home first."""
    unit, cell = None, Cell()
    for batch in batches:
        units, probe = batch.column("unit").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
        fp, node = batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()
        begins = runs(units, probe)
        for i, j in zip(begins[:-1], begins[1:]):
            if units[i] != unit:
                yield cell.forest()
                unit, cell = units[i], Cell()
            if probe[i]:
                yield cell.probe(fp[i:j], node[i:j])
            else:
                cell.parts.append((fp[i:j].copy(), node[i:j].copy()))
    yield cell.forest()


def linked(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between nodes of points (fp, node: distinct fingerprints) that connect all that differ in at most NEAR bits."""

    def homes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(cell_of(batch.column("fp").to_numpy().view(np.uint64)))], ["cell"])

    sizes = points.select("fp").mapInArrow(homes, "cell long").groupBy("cell").count().collect()  # at most CELLS rows
    sent = points.select("fp", "node").mapInArrow(_sent({r["cell"]: -(-r["count"] // block) for r in sizes}), "unit long, probe boolean, fp long, node long")
    return sent.repartition("unit").sortWithinPartitions("unit", "probe").mapInArrow(_links, "a long, b long")


def simhash_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Fingerprint and component of each row of docs (doc_id, text): doc_id, fingerprint, component_id, group_size.

    group_size: rows with the same fingerprint. Null and empty texts, and those of separators alone, have the fingerprint
    zero and are linked like others. Repeated rows come out as often as they are there; rows of one id with different texts are
    documents of their own, whose component may differ. A null id is the smallest, so that the component of such a row
    has a null id. Texts of any length are hashed whole, AT_ONCE shingles at a time. Further columns are not read. An empty
    table has no rows.
    """
    rows, renumbered = numbered(docs)
    table = cut(rows.mapInArrow(_fingerprints, "doc long, doc_id long, fp long"), "fingerprints")
    points = cut(table.groupBy("fp").agg(F.min("doc").alias("node"), F.count("*").alias("group_size")), "points")
    edges = cut(linked(points, block), "links")
    classes = components(edges).withColumnRenamed("doc", "node")
    found = points.join(classes, "node", "left").select("fp", "group_size", F.coalesce("class_id", "node").alias("class_id"))
    if renumbered:
        ids = table.groupBy(F.col("doc").alias("class_id")).agg(F.first("doc_id").alias("component_id"))
        found = found.join(ids, "class_id").select("fp", "group_size", "component_id")
    found = cut(found.withColumnRenamed("class_id", "component_id"), "classes")
    discard(points, edges)
    many = F.broadcast(found.filter(F.col("group_size") > F.lit(HOT) * F.lit(table.count())))  # fewer than 1 / HOT rows
    rest = table.join(many.select("fp"), "fp", "left_anti").join(found, "fp")
    return table.join(many, "fp").unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"))
