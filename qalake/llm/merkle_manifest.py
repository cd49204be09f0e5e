"""Merkle manifest of a dataset: leaves, a tree for each source, a tree over the sources, proofs and their verification.

Rows are put in order by range partitioning, so that a source of any size is sorted by many tasks; a row's place in its source
is its place in its task plus the rows of the source in tasks before, which are few counts. From then on a node is known by
(tree, pos), and a level is one pass of window functions: lag and lead columns at offsets one and two, masked by the node's slot
in its run and by the run's length, give its siblings; rows of slot zero, each run's first child, hash their run into the parent.
A window's partition is a stretch of STRETCH places, a multiple of the run, so that no source is a partition.

Levels are written as tables, each with about a third of the rows of the one below. Proofs are handed down: from the tree over
sources to each source's root, and from level to level to the leaves, by joins on (tree, parent's place), which have at most
three rows a key. A proof is an array of steps, each with what stands left and right of the node; folding a leaf along its
steps gives the root again, or another one where the leaf was tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, discard, read

#: Nodes of a run, and places of a window's partition.
RUN, STRETCH = 3, 3**7
STEPS = "array<struct<left:binary,right:binary>>"


def coded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _text(digest: Column) -> Column:
    """A digest as the text that hashes take; none is empty."""
    return F.coalesce(F.lower(F.hex(digest)), F.lit(""))


def _joined(*digests: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_text(d) for d in digests]), 256))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[coded(c) for c in (doc_id, source, lang, n_chars, text)]), 256))


def tampered_with(doc_id: Column) -> Column:
    """Rows whose text loses its line feeds: those with an even crc32 of the decimal id; not those without an id."""
    return doc_id.isNotNull() & (F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0)


def _numbered(rows: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with pos, their place from 0 on in their group, and n, the group's rows; order begins with the group (null first)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    placed = cut(placed, name)
    parts = placed.groupBy(*groups, "task").agg(F.min("row").alias("first"), F.count("*").alias("size"))
    before = W.partitionBy(*groups).orderBy("task")
    parts = parts.select(
        *[F.col(g).alias(f"of_{g}") for g in groups],
        F.col("task").alias("of_task"),
        (F.sum("size").over(before) - F.col("size") - F.col("first")).alias("shift"),
        F.sum("size").over(W.partitionBy(*groups)).alias("n"),
    )
    same = F.col("task") == F.col("of_task")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return placed.join(parts, same).withColumn("pos", F.col("row") + F.col("shift")).drop("task", "row", "shift", "of_task", *[f"of_{g}" for g in groups])


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, pos, n, digest) with what their run has left and right of them, and, on a run's first child, the parent's digest."""
    w = W.partitionBy("tree", F.floor(F.col("pos") / STRETCH)).orderBy("pos")
    slot = F.col("pos") % RUN
    inside = lambda step: (slot + step >= 0) & (slot + step < F.least(F.lit(RUN), F.col("n") - F.col("pos") + slot))
    at = lambda step: F.when(inside(step), F.lag("digest", -step).over(w) if step < 0 else F.lead("digest", step).over(w))
    side = lambda steps: F.unhex(F.concat(*[_text(at(s)) for s in steps]))
    out = nodes.select("*", side(range(1 - RUN, 0)).alias("left"), side(range(1, RUN)).alias("right"))
    return out.withColumn("parent", F.when(slot == 0, _joined(F.col("digest"), F.col("right"))))


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All levels of all trees, from nodes up; each tree ends with one node, where n is 1."""
    out = []
    while True:
        out.append(cut(with_siblings(nodes), f"{name}{len(out)}"))
        parents = out[-1].filter("parent is not null and n > 1")
        nodes = parents.select("tree", F.floor(F.col("pos") / RUN).alias("pos"), F.ceil(F.col("n") / RUN).alias("n"), F.col("parent").alias("digest"))
        if parents.isEmpty():
            return out


def roots(tree: list[DataFrame]) -> DataFrame:
    """tree, digest, level of the last node of each tree."""
    out = None
    for i, level in enumerate(tree):
        top = level.filter("n = 1").select("tree", "digest", F.lit(i).alias("level"))
        out = top if out is None else out.unionByName(top)
    return out


def handed_down(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level's nodes with their steps to the root, followed by the steps that above (tree, level, steps, ...) has for the root.

    Further columns of above are handed down too.
    """
    more = [c for c in above.columns if c not in ("tree", "level", "steps")]
    below = None
    for i in reversed(range(len(tree))):
        own = above.filter(F.col("level") == i).select(F.col("tree").alias("of_tree"), F.lit(-1).cast("long").alias("of_pos"), "steps", *more)
        known = own if below is None else own.unionByName(below.select(F.col("tree").alias("of_tree"), F.col("pos").alias("of_pos"), "steps", *more))
        to = F.when(F.col("n") == 1, F.lit(-1).cast("long")).otherwise(F.floor(F.col("pos") / RUN))
        step = F.when(F.col("n") == 1, F.array().cast(STEPS)).otherwise(F.array(F.struct("left", "right")).cast(STEPS))
        level = tree[i].drop("parent").withColumn("to", to).withColumn("own", step)
        below = level.join(known, (F.col("tree") == F.col("of_tree")) & (F.col("to") == F.col("of_pos")))
        below = below.withColumn("steps", F.concat("own", "steps")).drop("own", "to", "of_tree", "of_pos", "left", "right")
    return below


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, digest, lambda d, s: _joined(s["left"], d, s["right"]))


def proof(steps: Column) -> Column:
    """Hash of all siblings, level by level, left to right (hexadecimal text)."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), ""), 256)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Proofs of all rows of docs (doc_id, source, lang, n_chars, text) and what verification says once some texts were tampered with.

    Per row: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified. Rows of a source are in the order of their
    id (null first), then of their leaf, so that repeated rows are leaves of their own, side by side. Null sources are one source.
    A source's only row has no siblings in its tree; the only source none above. Nulls are coded apart from empty texts; a text
    of any length is hashed whole. Rows without an id are not tampered with. Further columns are not read. An empty table
    has no rows.
    """
    text, doc_id, rest = F.col("text").cast("string"), F.col("doc_id").cast("long"), [F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    changed = F.when(tampered_with(doc_id) & F.contains(text, F.lit("\n")), leaf(doc_id, *rest, F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = cut(docs.select(doc_id.alias("doc_id"), rest[0].alias("source"), leaf(doc_id, *rest, text).alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("tie")), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    placed = cut(_numbered(leaves, ["source"], order, "sorted").drop("tie"), "placed")
    discard(leaves)
    numbers = placed.filter("pos = 0").select("source")
    sources = cut(_numbered(numbers, [], [F.col("source").asc_nulls_first()], "sources").select("source", F.col("pos").alias("tree")), "trees")
    found, numbers = sources.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source"))
    own = levels(placed.join(found, numbers).drop("of_source"), "level")
    tops = cut(roots(own), "roots")
    upper = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sources.count()).cast("long").alias("n"), "digest")
    upper = levels(upper, "upper")
    root = roots(upper).select("digest").first()
    root = F.lit(root["digest"] if root else None).cast("binary")
    top = F.lit(0).cast("long").alias("tree"), F.lit(len(upper) - 1).alias("level"), F.array().cast(STEPS).alias("steps")
    path = handed_down(upper, docs.sparkSession.range(1).select(*top)).select(F.col("pos").alias("tree"), "steps", F.col("digest").alias("subroot"))
    known = cut(path.join(tops.select("tree", "level"), "tree"), "paths")
    rows = handed_down(own, known)
    folded = fold(F.coalesce("changed", "digest"), F.col("steps"))
    return rows.withColumn("folded", folded).select(
        "doc_id",
        "source",
        _text(F.col("digest")).alias("leaf"),
        _text(F.col("subroot")).alias("subroot"),
        _text(root).alias("root"),
        proof(F.col("steps")).alias("proof_sha256"),
        _text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read(spark, sf_dir, "documents")).drop("source")


def _oracle() -> str:
    code = lambda c: f"coalesce(strlen(cast({c} as varchar))::varchar || ':' || cast({c} as varchar), '-')"
    leaf_of = lambda text: f"sha256({' || '.join(code(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda s: ascii(s)::bigint)), lambda c, b: {bits}), 4294967295)"
    upward = lambda name, first: f"""{name} as (select * from ({first}) t
  union all select tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' order by pos)) from {name} where n > 1 group by tree, level, pos // 3)"""  # noqa: E731
    beside = lambda name: f"""(select a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), '') as l,
    coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from {name} a left join {name} b on a.tree = b.tree and a.level = b.level and a.pos // 3 = b.pos // 3 and a.pos <> b.pos where a.n > 1 group by all)"""  # noqa: E731
    return f"""
with recursive rows as (select doc_id, {leaf_of("text")} as leaf, case when {crc} % 2 = 0 then {leaf_of("replace(text, chr(10), '')")} else {leaf_of("text")} end as other,
    cast(dense_rank() over (order by source nulls first) - 1 as bigint) as tree, cast(row_number() over (partition by source order by doc_id) - 1 as bigint) as pos, count(*) over (partition by source) as n from documents),
{upward("own", "select tree, 0 as level, pos, n, leaf as digest from rows")},
tops as (select tree, level, digest from own where n = 1),
{upward("upper", "select 0::bigint as tree, 0 as level, tree as pos, (select count(*) from tops) as n, digest from tops")},
own_sides as {beside("own")}, upper_sides as {beside("upper")},
steps as (
  select r.doc_id, s.level, s.l, s.r from rows r join own_sides s on s.tree = r.tree and s.pos = r.pos // cast(pow(3, s.level) as bigint)
  union all select r.doc_id, 1000 + s.level, s.l, s.r from rows r join upper_sides s on s.pos = r.tree // cast(pow(3, s.level) as bigint)),
ranked as (select doc_id, row_number() over (partition by doc_id order by level) as i, l, r from steps),
proofs as (select doc_id, count(*) as n, sha256(string_agg(l || r, '' order by i)) as proof_sha256 from ranked group by doc_id),
folds as (select doc_id, 0::bigint as i, other as d from rows union all select f.doc_id, f.i + 1, sha256(k.l || f.d || k.r) from folds f join ranked k on k.doc_id = f.doc_id and k.i = f.i + 1),
root as (select digest as root from upper where n = 1)
select r.doc_id, leaf, t.digest as subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, f.d as folded_root, f.d = root as verified
from rows r join tops t on t.tree = r.tree cross join root left join proofs p on p.doc_id = r.doc_id join folds f on f.doc_id = r.doc_id and f.i = coalesce(p.n, 0)
"""


ORACLE = _oracle()
