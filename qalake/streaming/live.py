"""Structured Streaming forms of the reports, and the runs that drain a source into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from qalake.session import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 4) -> DataFrame:
    """The events table as a stream; times become timestamps, as watermarks need them."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch)
    single = any(f.endswith("/events.parquet") for f in table.inputFiles())  # streams read folders
    rows = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else source.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(chats: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Questions and hits by hour; an hour is given out when the watermark has passed it."""
    return chats.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("questions"),
        F.count_if(F.coalesce("cache_hit", F.lit("miss")) != "miss").alias("hits"),
    ).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "questions", "hits")


def daily_traffic(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pageviews by day, with an approximate number of visitors."""
    views = events.filter("type = 'pageview'").withWatermark("ts", delay)
    return views.groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("pageviews"),
        F.approx_count_distinct("sid", 0.01).alias("uniques"),
    ).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "pageviews", "uniques")


def new_visitors(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each address's first event within the watermark's time."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ip"])


class FirstInWindow(StatefulProcessor):
    """Keeps one time for each key, when its open window began, until the watermark has passed the window's end."""

    def __init__(self, hours: int):
        self.span = pd.Timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at timestamp")

    def handleInputRows(self, key, rows, timerValues):
        """Of a batch's rows of the key, only ids and times are held."""
        parts = [(frame.ts.to_numpy(), frame.qid.to_numpy()) for frame in rows]
        ts, qid = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((qid, ts))
        ts, qid = ts[order], qid[order]
        span = self.span.to_timedelta64()
        kept = np.zeros(len(ts), bool)
        opened = np.datetime64(self.open.get()[0]) if self.open.exists() else None
        at = 0 if opened is None else int(np.searchsorted(ts, opened + span))
        while at < len(ts):  # a step for each window
            kept[at], opened = True, ts[at]
            at = int(np.searchsorted(ts, opened + span))
        self.open.update((pd.Timestamp(opened).to_pydatetime(),))
        self.handle.registerTimer(int(pd.Timestamp(opened + span).timestamp() * 1000))
        yield pd.DataFrame({"key": key[0], "qid": qid, "kept": kept})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """A timer of an earlier window finds a later one open, which stays."""
        end = pd.Timestamp(self.open.get()[0]) + self.span if self.open.exists() else None
        if end is not None and int(end.timestamp() * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="str"), "qid": pd.Series([], dtype="int64"), "kept": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def ttl_dedup(questions: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """key, qid, kept of a stream (key, qid, ts): the stateful form of reuse.ttl_dedup. Rows later than `delay` are left out."""
    rows = questions.withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(FirstInWindow(hours), "key string, qid long, kept boolean", "append", "EventTime")


def drain(stream: DataFrame, name: str, each: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has now, into a table in the shared folder.

    each: what is made of every micro-batch; a batch writes a folder of its own, so that one that is run again replaces it.
    """
    return drained(stream, name, each, mode)[0]


def drained(stream: DataFrame, name: str, each: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> tuple[DataFrame, int]:
    """The table that drain() gives, and the rows that the query's operators dropped because they came too late."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if each is None and mode == "append":
        query = writer.format("parquet").start(f"{base}/out")
        schema = stream.schema
    else:

        def write(batch: DataFrame, number: int) -> None:
            out = each(batch) if each else batch
            folder = f"{base}/out/batch={number if mode == 'append' else 0}"
            out.write.mode("overwrite").parquet(folder)

        query = writer.foreachBatch(write).start()
        schema = None
    query.awaitTermination()
    late = sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
    if schema is None:
        return spark.read.parquet(f"{base}/out").drop("batch"), late
    return spark.read.schema(schema).parquet(f"{base}/out"), late
