"""Daily roll-ups of events: counts, sums and mergeable sketches, from which figures of any span of days follow.

A row stands for a day and a group. It holds a KLL sketch of the response times and an HLL sketch of the visitors, both of
bounded size, so that a report over a year reads some hundred rows a group and no events. Counts and means are exact;
quantiles and numbers of distinct visitors are within `rank_error` and `distinct_error`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .traffic import day_of, is_type

#: Items that a KLL sketch keeps at its top level, and bits of an HLL sketch's registers.
KLL_K, HLL_BITS = 1000, 14
SUMS = ("pageviews", "chats", "timed", "sum_ms", "sum_answer", "n_answer", "sum_prompt", "n_prompt", "succeeded", "judged")


def rank_error(k: int = KLL_K) -> float:
    """By how much the rank of a KLL sketch's quantile is off, at most, in 99 of 100 sketches (fixed values of its authors)."""
    return 2.296 / k**0.9021


def distinct_error(bits: int = HLL_BITS) -> float:
    """Relative standard error of an HLL sketch."""
    return 1.04 / 2 ** (bits / 2)


def daily_rollup(events: DataFrame, by: Column | None = None, k: int = KLL_K, bits: int = HLL_BITS) -> DataFrame:
    """day, part (the value of `by`, 'all' without one), counts, sums, latency (KLL), visitors (HLL).

    Sketches are filled where events are read and merged by the shuffle. Chats without a response time count as chats and
    in no sum; groups without any have no latency.
    """
    timed = is_type("chat_question") & F.col("response_ms").isNotNull()
    own = lambda c: F.when(timed, F.col(c))
    total = lambda c: F.coalesce(F.sum(own(c)), F.lit(0)).cast("double")
    part = F.lit("all") if by is None else F.coalesce(by.cast("string"), F.lit("unknown"))
    rows = events.groupBy(day_of().alias("day"), part.alias("part")).agg(
        F.count_if(is_type("pageview")).alias("pageviews"), F.count_if(is_type("chat_question")).alias("chats"), F.count_if(timed).alias("timed"),
        total("response_ms").alias("sum_ms"), total("answer_chars").alias("sum_answer"), F.count(own("answer_chars")).alias("n_answer"),
        total("prompt_chars").alias("sum_prompt"), F.count(own("prompt_chars")).alias("n_prompt"), total("success").alias("succeeded"), F.count(own("success")).alias("judged"),
        F.kll_sketch_agg_double(own("response_ms").cast("double"), k).alias("latency"), F.hll_sketch_agg(F.when(is_type("pageview"), F.col("sid").cast("string")), bits).alias("visitors"),
    )
    return rows.withColumn("latency", F.when(F.col("timed") > 0, F.col("latency")))


def save_days(rollup: DataFrame, path: str) -> None:
    """Write days of a roll-up, each a folder; days that are there already are replaced, others stay. So a day can be rolled up again."""
    rollup.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


def span(rollup: DataFrame, since: str | None = None, until: str | None = None, whole: bool = False, k: int = KLL_K) -> DataFrame:
    """The roll-up of days since <= day <= until as one row a part (with `whole`, one row in all): sums of sums, sketches merged."""
    if since:
        rollup = rollup.filter(F.col("day") >= since)
    if until:
        rollup = rollup.filter(F.col("day") <= until)
    merged = rollup.groupBy((F.lit("all") if whole else F.col("part")).alias("part"))
    return merged.agg(*[F.sum(c).alias(c) for c in SUMS], F.kll_merge_agg_double("latency", k).alias("latency"), F.hll_union_agg("visitors").alias("visitors"))


def figures(rollup: DataFrame, quantile: float = 0.95) -> DataFrame:
    """What reports show of rows of a roll-up, of one day or a span: part, day where there is one, counts, means, a quantile, visitors."""
    mean = lambda s, n: F.when(F.col(n) > 0, F.round(F.col(s) / F.col(n), 4))
    day = ["day"] if "day" in rollup.columns else []
    return rollup.select(
        *day, "part", "pageviews", "chats", F.col("timed").alias("n"), mean("sum_ms", "timed").alias("average_ms"), mean("sum_answer", "n_answer").alias("answer_chars"),
        mean("sum_prompt", "n_prompt").alias("prompt_chars"), F.when(F.col("judged") > 0, F.round(100 * F.col("succeeded") / F.col("judged"), 4)).alias("success_rate"),
        F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("latency", F.lit(quantile))).alias("quantile_ms"), F.hll_sketch_estimate("visitors").alias("visitors"),
    )


def rank_gap(events: DataFrame, found: DataFrame, by: Column, quantile: float = 0.95) -> DataFrame:
    """part and gap: how far the exact ranks of found.quantile_ms among the events' response times miss the quantile (0: it is one)."""
    times = events.filter(is_type("chat_question") & F.col("response_ms").isNotNull()).select(F.coalesce(by.cast("string"), F.lit("unknown")).alias("part"), "response_ms")
    rows = times.join(found.filter("n > 0").select("part", "quantile_ms"), "part")
    ranks = rows.groupBy("part").agg(F.avg((F.col("response_ms") < F.col("quantile_ms")).cast("int")).alias("below"), F.avg((F.col("response_ms") <= F.col("quantile_ms")).cast("int")).alias("upto"))
    return ranks.select("part", F.greatest(F.col("below") - quantile, quantile - F.col("upto"), F.lit(0.0)).alias("gap"))
