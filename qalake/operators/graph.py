"""Topics, entities and sources of questions, as node and edge tables; look-ups are joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qalake.session import stored

from .maintenance import snapshot_upsert

Topics = Sequence[tuple[int, str, Sequence[str]]]


def _hits(text: Column, topics: Topics) -> Column:
    """Array of (topic_id, matches, n) for topics with a keyword in the text."""
    lower = F.lower(text)
    each = [
        F.struct(
            F.lit(i).alias("topic_id"),
            sum((F.contains(lower, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("matches"),
            F.lit(len(words)).alias("n"),
        ) for i, _, words in topics
    ]
    return F.filter(F.array(*each), lambda x: x["matches"] > 0)


def classify_topics(texts: DataFrame, topics: Topics) -> DataFrame:
    """Edges qid, topic_id: a topic fits if any of its keywords is in the text. Topics are a parameter: one pass, no join."""
    return texts.select("qid", F.explode(_hits(F.col("text"), topics)).alias("t")).select("qid", "t.topic_id")


def score_topics(texts: DataFrame, topics: Topics) -> DataFrame:
    """qid, topic_id, score: the share of the topic's keywords in the text."""
    return texts.select("qid", F.explode(_hits(F.col("text"), topics)).alias("t")).select("qid", "t.topic_id", F.round(F.col("t.matches") / F.col("t.n"), 4).alias("score"))


def extract_entities(texts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """qid, type, value, name: matches of the rules (type, pattern with one group, name template with {}), first name wins.

    Values are upper-cased; a (type, value) that several rules or places give is one row.
    """
    def matches(i: int, kind: str, pattern: str, name: str) -> Column:
        entity = lambda m: F.struct(F.lit(kind).alias("type"), F.upper(m).alias("value"), F.lit(i).alias("rule"), F.replace(F.lit(name), F.lit("{}"), F.upper(m)).alias("name"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), entity)

    found = [matches(i, *rule) for i, rule in enumerate(rules)]
    rows = texts.select("qid", F.explode(F.concat(*found)).alias("e")).select("qid", "e.*")
    return rows.groupBy("qid", "type", "value").agg(F.min_by("name", "rule").alias("name"))


def upsert_entities(existing: DataFrame, found: DataFrame) -> DataFrame:
    """entity_id, type, value, name: a known name stays unless it is null. Ids are hashes of (type, value): no numbering pass."""
    new = found.groupBy("type", "value").agg(F.min("name").alias("name"))
    both = existing.select("type", "value", F.col("name").alias("old")).join(new, ["type", "value"], "full")
    return both.select(F.xxhash64("type", "value").alias("entity_id"), "type", "value", F.coalesce("old", "name").alias("name"))


def link(edges: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with new ones in the place of old ones of equal key."""
    return snapshot_upsert(edges, new, keys)


def link_topics(edges: DataFrame, texts: DataFrame, topics: Topics) -> DataFrame:
    return link(edges, score_topics(texts, topics).withColumnRenamed("score", "confidence"), ["qid", "topic_id"])


def link_entities(edges: DataFrame, texts: DataFrame, rules: Sequence[tuple[str, str, str]], confidence: float = 1.0) -> DataFrame:
    new = extract_entities(texts, rules).select("qid", F.xxhash64("type", "value").alias("entity_id"), F.lit(confidence).alias("confidence"))
    return link(edges, new, ["qid", "entity_id"])


def link_sources(edges: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Edges qid, source_id, relevance_score; a source is its entry, else its id, else its url."""
    new = retrieved.select("qid", F.coalesce(F.col("entry_id").cast("string"), F.col("id").cast("string"), "url").alias("source_id"), F.col("score").alias("relevance_score"))
    new = new.filter("source_id is not null").groupBy("qid", "source_id").agg(F.max("relevance_score").alias("relevance_score"))
    return link(edges, new, ["qid", "source_id"])


def link_new_answers(events: DataFrame, topics: Topics, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Edges (qid, kind, target) of answers that were not reused; the others have their original's."""
    texts = events.filter("cache_hit = 'miss'").select(F.col("id").alias("qid"), F.concat_ws(" ", "question", "answer").alias("text"))
    a = classify_topics(texts, topics).select("qid", F.lit("topic").alias("kind"), F.col("topic_id").cast("string").alias("target"))
    b = extract_entities(texts, rules).select("qid", F.lit("entity").alias("kind"), F.concat_ws(":", "type", "value").alias("target"))
    return a.unionByName(b)


def _newest(pairs: DataFrame, order: list[Column], n: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def similar_by_topic(asked: DataFrame, edges: DataFrame, originals: DataFrame, n: int = 5) -> DataFrame:
    """qid, id, rank: the newest answered originals (id, ts) that share a topic with a question.

    Only the n newest originals of each topic can be among a question's n newest, and they are found once for each topic;
    what a question is then joined with is bounded, whatever a topic's size.
    """
    own = edges.join(originals, edges.qid == originals.id).select("topic_id", "id", "ts")
    w = W.partitionBy("topic_id").orderBy(F.desc("ts"), F.desc("id"))
    newest = own.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n + 1)  # one may be the question itself
    pairs = asked.select("qid").join(edges, "qid").join(newest, "topic_id").filter("id <> qid").select("qid", "id", "ts").distinct()
    return _newest(pairs, [F.desc("ts"), F.desc("id")], n).select("qid", "id", "rank")


#: Questions that hold an entity from which on it is frequent: a join on rarer ones makes at most so many pairs for each edge.
RARE = 40
#: Sets of frequent entities of a block, and blocks of each side at least, once there are more than FEW sets.
SETS, BLOCKS, FEW = 32_768, 4, 512


def frequent_entities(edges: DataFrame, rare: int = RARE) -> DataFrame:
    """entity_id, number: entities that more than `rare` questions hold, as a table. Numbers are unique, not dense."""
    counts = edges.groupBy("entity_id").agg(F.count("*").alias("n")).filter((F.col("n") > rare) & F.col("entity_id").isNotNull())
    return stored(counts.select("entity_id", F.monotonically_increasing_id().alias("number")), "frequent")


def _overlaps(n: int):
    """Of a block of question sets (asked, frequent) and one of originals (id, ts, frequent): the n best originals of each set by
    common entities, then the newest.

    The block's originals are listed by entity, in order of time; a set's common entities are counted along its own lists.
    Memory is one number for each original and member, whatever the number of entities.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.array(np.lexsort((-right.column("id").to_numpy(), -right.column("ts").to_numpy()))))
        members = lambda t: (pc.list_parent_indices(t.column("frequent")).to_numpy(), pc.list_flatten(t.column("frequent")).to_numpy())
        place, entity = members(right)
        order = np.argsort(entity, kind="stable")
        place, names = place[order], entity[order]
        of, wanted = members(left)
        begin, end = np.searchsorted(names, wanted), np.searchsorted(names, wanted, "right")
        cut = np.searchsorted(of, np.arange(left.num_rows + 1))
        out: tuple[list, list, list] = ([], [], [])
        for i in range(left.num_rows):
            lists = [place[begin[j] : end[j]] for j in range(cut[i], cut[i + 1])]
            if not lists:
                continue
            common = np.bincount(np.concatenate(lists), minlength=1)
            reached = np.cumsum(np.bincount(common)[:0:-1])  # originals with so many common entities or more, from the most down
            if not len(reached):
                continue
            least = len(reached) - min(int(np.searchsorted(reached, n)), len(reached) - 1)
            best = np.flatnonzero(common >= least)  # in order of time
            best = best[np.argsort(-common[best], kind="stable")[:n]]
            for x, y in zip(out, (np.full(len(best), i), best, common[best]), strict=True):
                x.append(y)
        row, at, matches = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        columns = [left.column("asked").take(pa.array(row)), right.column("id").take(pa.array(at)), right.column("ts").take(pa.array(at)), pa.array(matches)]
        return pa.table(columns, names=["asked", "id", "ts", "matches"])

    return work


def similar_by_entity(asked: DataFrame, edges: DataFrame, originals: DataFrame, n: int = 5, rare: int = RARE) -> DataFrame:
    """qid, id, matches, rank: originals (id, ts: long) by the number of entities shared, then the newest. edges: qid, entity_id.

    Rare entities come first: who shares one is found by a join on them, whose lists are short, and common frequent entities
    are counted in on each pair. Then the bound: an original that shares no rare entity can't share more than the
    question's frequent ones; if n others share more, the question is done. What is left depends on the sets of frequent
    entities alone: of originals with equal ones only the n + 1 newest can count (one may be the question itself), and
    equal sets of questions are asked once. Blocks of both meet in tasks, and give n + 1 rows for each set, so that rows that
    hold an entity of a third of all questions are never joined on it. What is joined grows with the edges, what is sent
    to blocks with the sets times the number of blocks, and a task's memory with its block; only counting, a few
    nanoseconds for each pair of distinct sets, grows with their square.
    """
    edges = stored(edges.select("qid", "entity_id").distinct(), "entities")
    marked = edges.join(frequent_entities(edges, rare), "entity_id", "left")
    sets = marked.groupBy("qid").agg(F.array_sort(F.collect_list("number")).alias("frequent"), F.collect_list(F.when(F.col("number").isNull(), F.col("entity_id"))).alias("rare"))
    sets = stored(sets, "sets")  # a row for each question, with its own entities
    ours = asked.select("qid").distinct().join(sets, "qid")
    theirs = originals.select("id", F.col("ts").cast("long").alias("ts")).join(sets.select(F.col("qid").alias("id"), F.col("frequent").alias("held"), F.col("rare").alias("others")), "id")
    left = ours.select("qid", F.col("frequent").alias("own"), F.explode("rare").alias("entity_id"))
    met = left.join(theirs.select("id", "ts", "held", F.explode("others").alias("entity_id")), "entity_id").filter("id <> qid")
    pairs = met.groupBy("qid", "id").agg(F.count("*").alias("rare"), F.first("ts").alias("ts"), F.first("own").alias("own"), F.first("held").alias("held"))
    best = [F.desc("matches"), F.desc("ts"), F.desc("id")]
    first = stored(_newest(pairs.select("qid", "id", "ts", (F.col("rare") + F.size(F.array_intersect("own", "held"))).alias("matches")), best, n), "first")
    enough = first.filter(F.col("rank") == n).select("qid", F.col("matches").alias("reached"))
    open_ones = ours.join(enough, "qid", "left").filter((F.size("frequent") > 0) & (F.coalesce("reached", F.lit(0)) <= F.size("frequent"))).select("qid", "frequent")
    newest = W.partitionBy("held").orderBy(F.desc("ts"), F.desc("id"))
    groups = theirs.filter(F.size("held") > 0).select("id", "ts", F.col("held").alias("frequent"), F.row_number().over(newest).alias("place")).filter(F.col("place") <= n + 1).drop("place")
    asked_sets = open_ones.select("frequent").distinct().withColumn("asked", F.to_json("frequent"))
    asked_sets, groups = stored(asked_sets, "asked"), stored(groups, "groups")
    a, b = (max(BLOCKS if n > FEW else 1, -(-n // SETS)) for n in (asked_sets.count(), groups.count()))
    left = asked_sets.withColumn("a", F.pmod(F.xxhash64("asked"), F.lit(a)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    right = groups.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_overlaps(n + 1), "asked string, id long, ts long, matches long")
    found = _newest(found.withColumnRenamed("asked", "qid"), best, n + 1).withColumnRenamed("qid", "asked").drop("rank")
    rest = open_ones.withColumn("asked", F.to_json("frequent")).join(found, "asked").filter("id <> qid").select("qid", "id", "ts", "matches")
    both = first.drop("rank").unionByName(rest).groupBy("qid", "id").agg(F.max("ts").alias("ts"), F.max("matches").alias("matches"))
    return _newest(both, best, n).select("qid", "id", "matches", "rank")


def similar_by_both(topic_edges: DataFrame, entity_edges: DataFrame, events: DataFrame, topic_id: int, entity_id) -> DataFrame:
    """Verified events with a topic and an entity."""
    t = topic_edges.filter(F.col("topic_id") == topic_id).select(F.col("qid").alias("id"))
    e = entity_edges.filter(F.col("entity_id") == entity_id).select(F.col("qid").alias("id"))
    return events.filter("verified").join(t, "id", "left_semi").join(e, "id", "left_semi")


def find_enhanced(by_entity: DataFrame, by_topic: DataFrame, reviews: DataFrame, n: int = 5) -> DataFrame:
    """qid, id, rank: entity matches first and topic matches to fill up, without repeats; verified ones move to the front."""
    both = by_entity.select("qid", "id", F.lit(1).alias("entity"), "rank").unionByName(by_topic.select("qid", "id", F.lit(0).alias("entity"), "rank"))
    once = both.groupBy("qid", "id").agg(F.max(F.struct("entity", (-F.col("rank")).alias("back"))).alias("x")).select("qid", "id", "x.entity", (-F.col("x.back")).alias("old"))
    w = W.partitionBy("qid").orderBy(F.desc("entity"), "old", "id")
    kept = once.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= n)
    final = W.partitionBy("qid").orderBy(F.desc("verified"), F.desc("entity"), "i")
    return kept.join(reviews, "id", "left").withColumn("verified", F.coalesce("verified", F.lit(False))).select("qid", "id", F.row_number().over(final).alias("rank"), "verified")


def weighted_rank(scored: DataFrame, up: float = 1.5, down: float = 0.5) -> DataFrame:
    """Scores raised for verified and lowered for flagged answers."""
    weight = F.when(F.col("verified"), up).otherwise(1.0) * F.when(F.col("flagged"), down).otherwise(1.0)
    return scored.withColumn("weighted", F.round(F.col("score") * weight, 6))


def mark_verified(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events with the review's marks where there is one. reviews: id, verified, flagged, flag_reason."""
    r = reviews.select("id", F.col("verified").alias("rv"), F.col("flagged").alias("rf"), "flag_reason")
    return events.join(r, "id", "left").withColumn("verified", F.coalesce("rv", "verified", F.lit(False))).withColumn("flagged", F.coalesce("rf", "flagged", F.lit(False))).drop("rv", "rf")


def topic_stats(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """Questions of each topic, also of those without any, and all edges."""
    n = edges.groupBy("topic_id").agg(F.count("*").alias("n"))
    return topics.join(n, topics.id == n.topic_id, "left").select("id", "slug", F.coalesce("n", F.lit(0)).alias("questions"), F.coalesce(F.sum("n").over(W.partitionBy()), F.lit(0)).alias("edges"))
