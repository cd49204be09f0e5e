"""Token, latency and timeline reports over chat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traffic import day_of, is_type, recent_events

#: Fields of the JSON that events carry in meta.
META = (
    "question string, answer string, cache_hit string, semantic_similarity double, sources array<struct<id:string,title:string,url:string,section:string>>, "
    "citations_count int, chunks_retrieved int, retrieved_docs int, model_used string, token_usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"
)


def avg(column: str, digits: int = 4) -> Column:
    return F.round(F.avg(column), digits)


def chats(events: DataFrame, as_of: str, days: int) -> DataFrame:
    return recent_events(events, as_of, days).filter(is_type("chat_question"))


def with_tokens(events: DataFrame, as_of: str, days: int) -> DataFrame:
    return chats(events, as_of, days).filter(F.col("openai_total_tokens").isNotNull())


def token_summary(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return with_tokens(events, as_of, days).agg(
        F.count("*").alias("n"), F.sum("openai_total_tokens").alias("total"), avg("openai_total_tokens").alias("average"), F.sum("openai_prompt_tokens").alias("prompt"),
        F.sum("openai_completion_tokens").alias("completion"), F.countDistinct("model_used").alias("models"), F.countDistinct("api_provider").alias("providers"),
    )


def latest_days(daily: DataFrame, n: int = 30) -> DataFrame:
    return daily.orderBy(F.desc("day")).limit(n)


def token_daily(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    daily = with_tokens(events, as_of, days).groupBy(day_of().alias("day"))
    return latest_days(daily.agg(F.sum("openai_total_tokens").alias("total"), avg("openai_total_tokens").alias("average"), F.count("*").alias("n")))


def model_breakdown(events: DataFrame, as_of: str, days: int = 30, n: int = 10) -> DataFrame:
    groups = chats(events, as_of, days).groupBy("model_used", "api_provider")
    table = groups.agg(F.count("*").alias("n"), F.sum("openai_total_tokens").alias("total"), avg("openai_total_tokens").alias("average"))
    return table.orderBy(F.desc_nulls_last("total"), F.asc_nulls_last("model_used"), F.asc_nulls_last("api_provider")).limit(n)


def completion_share(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    summary = token_summary(events, as_of, days)
    return summary.select(F.round(100.0 * F.col("completion") / F.greatest("total", F.lit(1)), 4).alias("completion_share"))


def _latency() -> list[Column]:
    """Exact percentile; approx_percentile is the choice where groups have more values than a task holds."""
    return [
        F.count("*").alias("n"), avg("response_ms").alias("average_ms"), F.round(F.expr("percentile(response_ms, 0.95)"), 4).alias("p95_ms"),
        avg("answer_chars").alias("answer_chars"), avg("prompt_chars").alias("prompt_chars"), F.round(100 * F.avg("success"), 4).alias("success_rate"),
    ]


def latency_summary(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return chats(events, as_of, days).filter("response_ms is not null").agg(*_latency())


def latency_by_provider(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    groups = chats(events, as_of, days).filter("response_ms is not null").groupBy(F.coalesce("api_provider", F.lit("unknown")).alias("provider"))
    return groups.agg(*_latency())


def latency_daily(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    groups = chats(events, as_of, days).filter("response_ms is not null").groupBy(day_of().alias("day"))
    return latest_days(groups.agg(*_latency()[:3]))


def timeline_page(events: DataFrame, cache_mode: str | None = None, limit: int = 100, offset: int = 0, preview: int = 200) -> DataFrame:
    """A page of chats, newest first, from the JSON in meta; at most 100 rows."""
    m = F.from_json("meta", META)
    rows = events.filter(is_type("chat_question")).select("id", "ts", "success", "response_ms", m.alias("m"))
    rows = rows.select(
        "id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.left(F.coalesce("m.question", F.lit("")), F.lit(preview)).alias("question"),
        F.coalesce("m.cache_hit", F.lit("miss")).alias("cache_hit"), F.round(F.coalesce("m.semantic_similarity", F.lit(0.0)), 4).alias("similarity"),
        F.coalesce("m.retrieved_docs", "m.chunks_retrieved", F.lit(0)).alias("chunks"), F.coalesce("m.token_usage.total_tokens", F.lit(0)).alias("tokens"),
        F.coalesce("response_ms", F.lit(0)).alias("response_ms"), "ts",
    )
    if cache_mode:
        rows = rows.filter(F.col("cache_hit") == cache_mode)
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(min(limit, 100)).drop("ts")


def cache_window_stats(events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Reuse in the last hours. Hits of further tiers count in none of the two."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(hours)} hours")
    hit = lambda kind: F.count_if(F.coalesce("cache_hit", F.lit("miss")) == kind)
    table = events.filter(is_type("chat_question") & (F.col("ts") >= start)).agg(
        F.count("*").alias("total"),
        hit("exact").alias("exact"),
        hit("semantic").alias("semantic"),
        hit("miss").alias("miss"),
        avg("response_ms").alias("average_ms"),
        F.coalesce(F.sum("openai_total_tokens"), F.lit(0)).alias("tokens"),
    )
    rate = F.when(F.col("total") > 0, F.round((F.col("exact") + F.col("semantic")) / F.col("total"), 4)).otherwise(F.lit(0.0))
    return table.withColumn("hit_rate", rate)


def hour_of(ts: str = "ts") -> Column:
    return F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:mm:ss")


def cache_hourly(events: DataFrame) -> DataFrame:
    hits = F.count_if(F.coalesce("cache_hit", F.lit("miss")) != "miss")
    return events.filter(is_type("chat_question")).groupBy(hour_of().alias("hour")).agg(F.count("*").alias("questions"), hits.alias("hits"))


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value)


def cost_rollup(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Average cost of a chat by model, its share of chats, and the weighted mean over all. prices: model_used, per_1k."""
    from pyspark.sql import Window as W

    used = events.filter(is_type("chat_question")).join(prices, "model_used")
    table = used.groupBy("model_used").agg(F.count("*").alias("n"), F.avg(F.coalesce("openai_total_tokens", F.lit(0)) * F.col("per_1k") / 1000).alias("cost"))
    every = W.partitionBy()
    return table.select(
        "model_used",
        "n",
        F.round("cost", 6).alias("cost"),
        F.round(F.col("n") / F.sum("n").over(every), 6).alias("share"),
        F.round(F.sum(F.col("n") * F.col("cost")).over(every) / F.sum("n").over(every), 6).alias("mean_cost"),
    )
