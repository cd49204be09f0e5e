"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A source's documents are each wanted target / source size times: so many whole copies, and one more with a fractional
probability, the same for all of them. Fractions are rounded in pairs: one side gains and the other loses the same mass of
words, at random, up with a chance of down / (up + down), until one side is whole. That keeps every document's expected copies
and the source's mass, whatever meets whom.

First pairs: a document and the pool of those that come after it, which share one fraction, largest documents first. The
document ends at 0 or 1, unless it is larger than what the pool can give or take, and the pool goes on with the fraction
that is left; so a large document is made up for by all smaller ones, and the last one, whose fraction is what is left over, is
the smallest. Documents of more than a HEAVY-th of their source, fewer than HEAVY, are paired with the pool of all others of
the source; the others are dealt by a hash of the id into groups of about GROUP, each a pool of its own. What groups leave
over are single fractional documents: these residuals are paired with each other, group by group and level by level, in a
reduction tree, until a source has one, which is drawn. It has at most a HEAVY-th of the source's words, unless a heavy document
is more than all smaller ones can make up for: then keeping its chance comes before the source's total.

A source with a third of all rows is as many small groups; levels grow with the logarithm of the rows, and are the same steps
at every size. All draws are hashes of ids: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import cut, read

#: Documents that meet in one group, on average.
GROUP = 48
#: A document of more than this part of its source is heavy.
HEAVY = 100
SEED = 8
MOST = 3.0
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`: each word and the space behind it become one character; the space before the first goes."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.length(F.translate(marks, SPACES, "")).cast("long")


def ordered(sizes: DataFrame) -> DataFrame:
    """sizes with i, each source's number by code point, null last: numbers within ranges, after those of the ranges before."""
    rows = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    rows = cut(rows.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")), "ranges")
    before = rows.groupBy("range").agg(F.count("*").alias("n"))  # one row for each range
    before = before.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "range").withColumn("i", F.col("k") + F.col("before")).drop("range", "k", "before")


def targets(sizes: DataFrame, weights=(1, 2, 3), most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target. sizes: source, source_size, n_docs, one row per source.

    Sources by code point, null last, weigh as weights repeat; targets share all sizes, and a target over `most` times
    its source's size stops there and the excess is shared again, until none is above. Sources that stopped stay so,
    since the share of a weight only rises; a round is one sum over all sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    rows = cut(ordered(sizes).select("source", "source_size", "n_docs", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "weights")
    share, full = 0.0, -1
    while True:
        stopped = F.col("cap") < share * F.col("weight")
        rest = F.sum("source_size") - F.coalesce(F.sum(F.when(stopped, F.col("cap"))), F.lit(0.0))
        got = rows.agg(rest.alias("rest"), F.sum(F.when(~stopped, F.col("weight"))).alias("open"), F.count_if(stopped).alias("full")).first()
        if got.full == full or not got.open:
            break
        share, full = max(share, got.rest / got.open), got.full
    return rows.select("source", "source_size", "n_docs", F.least("cap", F.lit(share) * F.col("weight")).alias("target"))


def _draw(*parts: Column) -> Column:
    """A number from [0, 1) that the parts fix."""
    return (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(SEED)), 11)) / F.lit(float(1 << 53))


FIELDS = ["first", "doc_id", "size", "source_size", "target", "whole", "p", "tie", "salt"]
NONE = "cast(null as struct<first:bigint,doc_id:bigint,size:bigint,source_size:bigint,target:double,whole:bigint,p:double,tie:bigint,salt:bigint>)"


_DONE = f"cast(array() as array<{NONE[len('cast(null as '):-1]}>)"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(items: Column, p: Column, pool: Column) -> Column:
    """Fold of sorted structs of FIELDS that share the fraction p, and a pool of further words that do: struct(p: what is left for the
    pool, held: the fractional one left or null, done: the others, p 0 or 1)."""
    size = F.aggregate(items, pool.cast("long"), lambda n, x: n + x["size"])
    start = F.struct(p.cast("double").alias("p"), size.alias("rest"), F.expr(NONE).alias("held"), F.expr(_DONE).alias("done"))
    one = F.lit(1.0)

    def room(state: Column, x: Column) -> Column:
        """What x and the pool behind it can give each other; none once the pool has ended, and those still to come with it."""
        p, rest = state["p"], state["rest"] - x["size"]
        is_open = (p > 0.0) & (p < 1.0) & (rest > 0)
        up, down = F.least((one - p) * x["size"], p * rest), F.least(p * x["size"], (one - p) * rest)
        return F.struct(p.alias("p"), rest.alias("rest"), is_open.alias("open"), up.alias("up"), down.alias("down"))

    def drawn(x: Column, v: Column) -> Column:
        """The mass that x gains or loses, and whether x is whole then."""
        rise = _draw(x["doc_id"], x["tie"], x["salt"], F.lit("pool")) * (v["up"] + v["down"]) < v["down"]
        up_ends, down_ends = (one - v["p"]) * x["size"] <= v["p"] * v["rest"], v["p"] * x["size"] <= (one - v["p"]) * v["rest"]
        return F.when(rise, F.struct(v["up"].alias("moved"), up_ends.alias("ends"), one.alias("bound"))).otherwise(F.struct((-v["down"]).alias("moved"), down_ends.alias("ends"), F.lit(0.0).alias("bound")))

    def fractions(x: Column, v: Column, w: Column) -> Column:
        """The fractions of x and of the pool: the one that reaches its bound is set to it exactly."""
        own = F.when(w["ends"], w["bound"]).otherwise(v["p"] + w["moved"] / x["size"])
        left = F.when(w["ends"], F.greatest(F.lit(0.0), F.least(one, v["p"] - w["moved"] / v["rest"]))).otherwise(one - w["bound"])
        as_it_is = F.struct(v["p"].alias("own"), v["p"].alias("left"))
        return F.when(v["open"], F.struct(own.alias("own"), left.alias("left"))).otherwise(as_it_is)

    def after(state: Column, x: Column, v: Column, f: Column) -> Column:
        mine = F.array(x.withField("p", f["own"]))
        held = (f["own"] > 0.0) & (f["own"] < 1.0)
        done = F.concat(state["done"], F.when(held, F.expr(_DONE)).otherwise(mine))
        return F.struct(f["left"].alias("p"), v["rest"].alias("rest"), F.when(held, F.get(mine, F.lit(0))).otherwise(state["held"]).alias("held"), done.alias("done"))

    def step(state: Column, x: Column) -> Column:
        return _let(room(state, x), lambda v: _let(drawn(x, v), lambda w: _let(fractions(x, v, w), lambda f: after(state, x, v, f))))

    return F.aggregate(items, start, step)


def pivot(items: Column, level: int) -> Column:
    """Fold of sorted structs of FIELDS, each paired with the one held: struct(held: the fractional one left or null, done: the others, p 0 or 1)."""
    start = F.struct(F.expr(NONE).alias("held"), F.expr(_DONE).alias("done"))

    def step(state: Column, x: Column) -> Column:
        y = state["held"]
        # words go from y to x or from x to y; p changes by words / size
        up = F.least((F.lit(1.0) - x["p"]) * x["size"], y["p"] * y["size"])
        down = F.least(x["p"] * x["size"], (F.lit(1.0) - y["p"]) * y["size"])
        rise = _draw(x["doc_id"], x["tie"], x["salt"], y["doc_id"], y["tie"], y["salt"], F.lit(level)) * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        # the one that reaches its bound is set to it exactly
        x_ends = F.when(rise, (F.lit(1.0) - x["p"]) * x["size"] <= y["p"] * y["size"]).otherwise(x["p"] * x["size"] <= (F.lit(1.0) - y["p"]) * y["size"])
        bound = F.when(x_ends == rise, 1.0).otherwise(0.0)
        x_new = x.withField("p", F.when(x_ends, bound).otherwise(x["p"] + moved / x["size"]))
        y_new = y.withField("p", F.when(~x_ends, bound).otherwise(y["p"] - moved / y["size"]))
        ended, left = F.when(x_ends, x_new).otherwise(y_new), F.when(x_ends, y_new).otherwise(x_new)
        whole = (left["p"] <= 0.0) | (left["p"] >= 1.0)
        both = F.struct(F.when(~whole, left).alias("held"), F.concat(state["done"], F.when(whole, F.array(ended, left)).otherwise(F.array(ended))).alias("done"))
        return F.when(y.isNull(), F.struct(x.alias("held"), state["done"].alias("done"))).otherwise(both)

    return F.aggregate(items, start, step)


def mix_sources(docs: DataFrame, weights=(1, 2, 3), most: float = MOST, group: int = GROUP, heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken, tie (the text's hash).

    Only doc_id, text and source are read: further columns, whatever their names, play no part. Null texts and texts of
    white space have size 0 and are taken 0 words; texts of any length are counted whole; null sources are one source, the
    last. Null ids are ids. Rows that repeat an id are told apart by a hash of their text, identical rows by numbers; each is
    taken by itself. Draws do not depend on the rows' order, so ties have no say. Empty tables give no rows; a table
    without any word has targets 0.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        F.xxhash64("text").alias("tie"),
    )
    rows = rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("times"))
    rows = cut(rows.select("doc_id", "source", "size", "tie", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("salt")), "sizes")
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_docs")), weights, most)
    sizes = cut(sizes, "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # sources are not bounded by the rows' number; the join is left to the optimizer, and rows of a hot source are split by it
    rows = rows.join(sizes, rows.source.eqNullSafe(sizes.source)).select(rows.source, "doc_id", "size", "source_size", "target", "n_docs", "tie", "salt", wanted.alias("wanted"))
    rows = rows.withColumn("whole", F.floor("wanted").cast("long")).withColumn("p", F.col("wanted") - F.col("whole")).withColumn("first", -F.col("size"))
    plain = (F.col("p") <= 0.0) | (F.col("size") == 0)
    done = rows.filter(plain).select("source", F.struct(*[F.col(c) if c != "p" else F.lit(0.0).alias("p") for c in FIELDS]).alias("d"))
    large = F.col("size") * heavy > F.col("source_size")
    rest = rows.filter(~plain).select("source", "n_docs", large.alias("large"), F.struct(*FIELDS).alias("d"))
    words = F.coalesce(F.sum(F.when(~F.col("large"), F.col("d.size"))), F.lit(0))
    of_source = rest.groupBy("source").agg(F.array_sort(F.collect_list(F.when(F.col("large"), F.col("d")))).alias("items"), words.alias("pool"), F.first("d.p").alias("p"))
    of_source = cut(of_source.select(F.col("source").alias("of"), settle(F.col("items"), F.col("p"), F.col("pool")).alias("s")), "heavy")
    done = done.unionByName(of_source.select(F.col("of").alias("source"), F.explode("s.done").alias("d")))
    light = rest.filter("not large").join(of_source.select("of", F.col("s.p").alias("now")), rest["source"].eqNullSafe(F.col("of")))
    n_groups = lambda level: F.greatest(F.lit(1), F.ceil(F.col("n_docs") / float(group ** (level + 1)))).cast("int")
    own = lambda level: F.pmod(F.xxhash64("d.doc_id", "d.tie", "d.salt", F.lit(level)), n_groups(level)).alias("g")
    met = light.groupBy("source", "n_docs", own(0)).agg(F.array_sort(F.collect_list("d")).alias("items"), F.first("now").alias("now"))
    met = cut(met.select("source", "n_docs", settle(F.col("items"), F.col("now"), F.lit(0)).alias("s")), "groups")
    done = done.unionByName(met.select("source", F.explode("s.done").alias("d")))
    over = of_source.filter("s.held is not null").select(F.col("of").alias("source"), F.col("s.held").alias("d"))
    over = over.join(sizes.select(F.col("source").alias("of"), "n_docs"), over["source"].eqNullSafe(F.col("of"))).drop("of")
    at = over.select("source", "n_docs", "d").unionByName(met.filter("s.held is not null").select("source", "n_docs", F.col("s.held").alias("d")))
    most_docs, level = sizes.agg(F.max("n_docs")).first()[0] or 0, 1
    while True:  # residuals of a level's groups, until each source is one group
        tree = at.groupBy("source", "n_docs", own(level)).agg(F.array_sort(F.collect_list("d")).alias("items"))
        tree = cut(tree.select("source", "n_docs", pivot(F.col("items"), level).alias("s")), f"level{level}")
        done = done.unionByName(tree.select("source", F.explode("s.done").alias("d")))
        at = tree.filter("s.held is not null").select("source", "n_docs", F.col("s.held").alias("d"))
        if most_docs <= group ** (level + 1):
            break
        level += 1
    drawn = F.when(_draw(F.col("d.doc_id"), F.col("d.tie"), F.col("d.salt"), F.lit(-1)) < F.col("d.p"), 1.0).otherwise(0.0)
    done = done.unionByName(at.select("source", F.col("d").withField("p", drawn).alias("d")))
    copies = F.when(F.col("d.size") == 0, 0).otherwise(F.col("d.whole") + F.col("d.p").cast("long"))
    return done.select("source", "d.*", copies.cast("long").alias("copies")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "tie"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
