"""Evaluation of question runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qalake.functions.rules import first_match
from qalake.functions.times import micros


def eval_by_category(results: DataFrame) -> DataFrame:
    """Successes and questions by category, and in all (category null)."""
    return results.rollup("category").agg(F.count("*").alias("total"), F.count_if(F.col("success")).alias("successes")).withColumn("rate", F.round(F.col("successes") / F.col("total"), 4))


def eval_confidence(results: DataFrame, low: float = 0.5) -> DataFrame:
    c = F.avg("confidence")
    table = results.groupBy("category").agg(
        F.count("*").alias("n"),
        F.round(c, 4).alias("mean"),
        F.count_if(F.col("confidence") < low).alias("low"),
        F.count_if(F.col("confidence").isNull()).alias("no_info"),
    )
    return table.withColumn("tier", first_match([(F.col("mean") >= 0.6, "strong"), (F.col("mean") >= low, "moderate")], "weak"))


def eval_score_dist(results: DataFrame, high: float = 0.7, low: float = 0.5) -> DataFrame:
    c = F.col("confidence")
    band = first_match([(c.isNull(), "none"), (c >= high, "high"), (c >= low, "medium")], "low")
    return results.groupBy(band.alias("band")).agg(F.count("*").alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def merge_runs(earlier: DataFrame, new: DataFrame, resume_at: int) -> DataFrame:
    return earlier.filter(F.col("number") < resume_at).unionByName(new.filter(F.col("number") >= resume_at))


def latency_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles, sorted[int(n * p)], and moments, of counts by value: equal values meet before they are shuffled.

    What is ordered is a key's distinct values, not its rows.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys).orderBy("v")
    ranked = counts.withColumn("after", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
    at = lambda p: F.min(F.when(F.col("after") > F.floor(F.col("n") * p), F.col("v")))
    r = lambda c, name: F.round(c, 4).alias(name)
    total, mean = F.sum("c"), F.sum(F.col("v") * F.col("c")) / F.sum("c")
    spread = F.sum(F.col("v") * F.col("v") * F.col("c")) - F.sum(F.col("v") * F.col("c")) * mean
    return ranked.groupBy(*keys).agg(
        total.alias("n"), r(mean, "mean"), r(F.expr("percentile(v, 0.5, c)"), "median"), r(F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1))).otherwise(0.0), "std"),
        r(F.min("v"), "min"), r(F.max("v"), "max"), r(at(0.95), "p95"), r(at(0.99), "p99"),
    )


def throughput(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Queries a second: rows over the time from the first start to the last end."""
    span = micros(F.max(end)) - micros(F.min(start))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(span > 0, F.round(F.count("*") * 1e6 / span, 6)).alias("per_second"))


def eval_expectation(probe: DataFrame, k: int) -> DataFrame:
    """One row: questions, whether the first neighbour is as expected, hits among k, mean reciprocal rank. probe: qid, rank, hit."""
    first = probe.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("hit").cast("int"))).alias("top"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("at"))
    share = lambda c: F.round(F.avg(c), 4)
    hit: Column = (F.coalesce("at", F.lit(10**9)) <= k).cast("int")
    return first.agg(F.count("*").alias("questions"), share(F.coalesce("top", F.lit(0))).alias("top_rate"), share(hit).alias("hit_rate"), share(F.coalesce(1 / F.col("at"), F.lit(0.0))).alias("mrr"))
