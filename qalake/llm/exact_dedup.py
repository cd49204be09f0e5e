"""Exact dedup by a minimal perfect hash over historical distinct digests.

The history, distinct text digests with the row that stays and the number of rows, is split into shards of bounded size. A
task builds a minimal perfect hash for each shard (levels of bit arrays, as in the published BBHash scheme); its slots
hold the full digest, the winner's locator and the group's size. Further documents look their digest up in their shard;
the slot's digest is compared byte by byte, so that a text outside the history is never taken for a member. Repeats are
added to their slots: the larger id wins, and counts add up. Texts outside the history are grouped separately, by digest,
and can be appended to it.

Without a history of earlier tables, the rows up to the median id are the history, and the rows after them look it up: no
row of the later half whose text was there before is grouped by its digest.

Skew: the history is pre-aggregated before it is shuffled, and a shard with many look-ups (one text may be a third of
all rows) is read by several tasks, each with a copy of the shard's index, whose size is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import MASK64, cut, discard, eights, mix, read, whole_texts

#: Distinct digests in a shard, on average; a shard's index is about 50 bytes for each.
SHARD_DIGESTS = 4_000
#: Look-ups that one task makes in a shard, on average.
SHARD_PROBES = 4_000
LEVELS = 24
INDEX = "shard int, bits binary, sizes array<long>, digests binary, winners binary, counts binary"


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & MASK64)) % np.uint64(size)).astype(np.int64)


def _heads(digests: np.ndarray) -> np.ndarray:
    """The first eight bytes of each 32-byte digest."""
    return eights(digests.reshape(-1))[: digests.size : 32].copy()


def build_hash(digests: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """For distinct digests (n x 32 bytes): the bits of all levels, the levels' sizes, and each slot's digest number.

    A level keeps the digests that meet no other there; its bit is set, and the others go on to the next level. The last
    level is a sorted remainder (slots in order of the digests' bytes), which makes the function total.
    """
    left = np.arange(len(digests))
    heads = _heads(digests)
    bits, sizes, order = [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-max(64, int(1.5 * len(left))) // 8) * 8
        place = _place(heads[left], level, size)
        alone = np.bincount(place, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        fits = alone[place]
        order.append(left[fits][np.argsort(place[fits])])
        left = left[~fits]
    if len(left):
        text = [digests[i].tobytes() for i in left]
        order.append(left[sorted(range(len(left)), key=text.__getitem__)])
    return np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8), sizes, np.concatenate(order) if order else left


def find_slots(bits: np.ndarray, sizes: list[int], digests: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The slot of each probe (m x 32 bytes), after its bytes were compared with the slot's; -1 for nonmembers."""
    flags = np.unpackbits(bits).astype(bool)
    rank = np.concatenate([[0], np.cumsum(flags)])
    slots = np.full(len(probes), -1, np.int64)
    heads, left, base = _heads(probes), np.arange(len(probes)), 0
    for level, size in enumerate(sizes):
        place = base + _place(heads[left], level, size)
        hit = flags[place]
        slots[left[hit]] = rank[place[hit]]
        left, base = left[~hit], base + size
    if len(left) and rank[-1] < len(digests):
        rest = {d.tobytes(): i for i, d in enumerate(digests[rank[-1] :], int(rank[-1]))}
        for i in left:
            slots[i] = rest.get(probes[i].tobytes(), -1)
    known = np.flatnonzero(slots >= 0)
    same = (digests[slots[known]] == probes[known]).all(axis=1)
    slots[known[~same]] = -1
    return slots


def _fixed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(shard: pa.Table) -> pa.Table:
    digests = _fixed(shard.column("digest"))
    bits, sizes, order = build_hash(digests)
    out = [
        [shard.column("shard")[0].as_py()],
        [bits.tobytes()],
        [sizes],
        [digests[order].tobytes()],
        [shard.column("keep_id").to_numpy()[order].tobytes()],
        [shard.column("group_size").to_numpy()[order].tobytes()],
    ]
    types = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["shard", "bits", "sizes", "digests", "winners", "counts"])


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    rows = probes.num_rows
    slot, keep, size = np.full(rows, -1, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if rows and index.num_rows:
        row = {c: index.column(c)[0].as_py() for c in index.column_names}
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        slot = find_slots(np.frombuffer(row["bits"], np.uint8), row["sizes"], digests, _fixed(probes.column("digest")))
        known = slot >= 0
        keep[known] = np.frombuffer(row["winners"], np.int64)[slot[known]]
        size[known] = np.frombuffer(row["counts"], np.int64)[slot[known]]
    return pa.table({"doc_id": probes.column("doc_id"), "digest": probes.column("digest"), "shard": probes.column("shard"), "slot": slot, "keep_id": keep, "group_size": size})


FOUND = "doc_id long, digest binary, shard int, slot long, keep_id long, group_size long"


def _merge(index: pa.Table, repeats: pa.Table) -> pa.Table:
    """A shard's index after repeats (slot, keep_id, group_size) were added: the larger id wins, counts add up."""
    if not index.num_rows:
        return index
    slot = repeats.column("slot").to_numpy()
    winners, counts = (np.frombuffer(index.column(c)[0].as_py(), np.int64).copy() for c in ("winners", "counts"))
    winners[slot] = np.maximum(winners[slot], repeats.column("keep_id").to_numpy())
    counts[slot] += repeats.column("group_size").to_numpy()
    for name, values in (("winners", winners), ("counts", counts)):
        index = index.set_column(index.column_names.index(name), name, pa.array([values.tobytes()], pa.binary()))
    return index


def _look_up(probes: DataFrame, index: DataFrame) -> DataFrame:
    """FOUND of probes (doc_id, digest, shard); slot is -1 for nonmembers. Shards with many probes are dealt to several tasks."""
    tasks = probes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_PROBES).cast("int").alias("tasks"))
    # at most a row for each shard, which SHARD_DIGESTS bounds against the number of rows; joined, not collected
    dealt = probes.join(tasks, "shard").select("doc_id", "digest", "shard", F.pmod(F.monotonically_increasing_id(), F.col("tasks")).cast("int").alias("task"))
    copies = index.join(tasks, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")).drop("tasks")
    return dealt.groupBy("shard", "task").cogroup(copies.groupBy("shard", "task")).applyInArrow(_probe, FOUND)


NULL_ID = -(2**63)


def groups_of(digests: DataFrame) -> DataFrame:
    """Distinct digests with the largest doc_id (NULL_ID where all are null) and the number of rows."""
    return digests.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NULL_ID)).alias("keep_id"), F.count("*").alias("group_size"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    history: distinct rows (digest binary, keep_id, group_size) of earlier texts, which are no rows of docs: its winners and
    counts are merged with those of docs, and a larger id of docs wins. By default the rows of docs up to the median id.

    Only doc_id and text are read: further columns, whatever their names, play no part. Null texts equal the empty text;
    texts of any length are digested whole. Of equal texts the largest doc_id stays (null ids stay only among themselves,
    and then keep_id is null); rows that repeat text and id tie and are all kept rows of one group. Empty tables give no
    rows.
    """
    rows = cut(whole_texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    if history is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        early = F.coalesce(F.col("doc_id") <= F.lit(NULL_ID if middle is None else middle).cast("long"), F.lit(True))
        history, later, earlier = groups_of(rows.filter(early)), rows.filter(~early), rows.filter(early)
    else:
        later, earlier = rows, rows.limit(0)
    history = cut(history.select("digest", F.coalesce("keep_id", F.lit(NULL_ID)).alias("keep_id"), "group_size"), "history")
    shards = max(1, -(-history.count() // SHARD_DIGESTS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    index = cut(history.select("*", shard).groupBy("shard").applyInArrow(_build, INDEX), "index")
    found = cut(_look_up(later.select("*", shard), index), "found")
    repeats = found.filter("slot >= 0")
    others = found.filter("slot < 0").select("doc_id", "digest")
    added = repeats.groupBy("shard", "slot").agg(F.coalesce(F.max("doc_id"), F.lit(NULL_ID)).alias("keep_id"), F.count("*").alias("group_size"))  # at most a row for each slot
    before, index = index, cut(index.groupBy("shard").cogroup(added.groupBy("shard")).applyInArrow(_merge, INDEX), "index")
    discard(history, before)
    members = _look_up(earlier.select("*", shard).unionByName(repeats.select("doc_id", "digest", "shard")), index).select("doc_id", "digest", "keep_id", "group_size")
    apart = others.join(groups_of(others), "digest").select("doc_id", "digest", "keep_id", "group_size")
    out = members.unionByName(apart).withColumn("keep_id", F.expr(f"nullif(keep_id, {NULL_ID + 1}L - 1L)"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def appended(history: DataFrame, result: DataFrame) -> DataFrame:
    """The history after the rows of result, which exact_dedup() gave against it: merged groups in place of theirs, new digests at the end."""
    new = result.select(F.unhex("text_sha256").alias("digest"), "keep_id", "group_size").distinct()
    return history.join(new, "digest", "left_anti").select("digest", "keep_id", "group_size").unionByName(new)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
"""
