"""Streams with several sinks, and live forms of the per-visitor reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.operators.maintenance import ingest_events

ACCEPTED, REJECTED = "accepted", "rejected"


def two_sinks(base: str) -> Callable[[DataFrame, int], None]:
    """What writes a micro-batch of posted events to both tables under base.

    A batch has a folder of its own in each, by its number: one that is run again, since the driver was lost after it wrote and
    before it committed, replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        judged = ingest_events(batch)
        judged.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{base}/{ACCEPTED}/batch={number}")
        judged.filter("reason is not null").write.mode("overwrite").parquet(f"{base}/{REJECTED}/batch={number}")

    return write


def ingest_stream(posted: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Drain a stream of posted events (id, type, path, meta, ...) into accepted and rejected ones; both tables, with their batch."""
    query = posted.writeStream.foreachBatch(two_sinks(base)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_sinks(posted.sparkSession, base)


def read_sinks(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{base}/{ACCEPTED}"), spark.read.parquet(f"{base}/{REJECTED}")


def rate_windows(requests: DataFrame, above: int = 10, delay: str = "10 minutes") -> DataFrame:
    """ip, started, n: each hour, begun at any full minute, in which an address made more than `above` requests.

    For dashboards: sliding windows in the state store, given out when the watermark has passed them. A request is in sixty
    windows; sums are taken before the shuffle.
    """
    w = F.window("ts", "1 hour", "1 minute")
    table = requests.withWatermark("ts", delay).groupBy("ip", w.alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > above)
    return table.select("ip", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def session_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of sid, as flags.session_activity gives them, once the watermark has passed their end."""
    table = events.withWatermark("ts", delay).groupBy("sid", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table.select("sid", stamp("w.start").alias("started"), stamp("w.end").alias("ended"), "n")
