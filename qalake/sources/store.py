"""An event store: Parquet in a folder for each day, so that reports read the days they ask for and deletes rewrite the days they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.session import remove_folder

#: Files of a day that one write makes, at most: a day's rows are dealt out by id.
FILES = 8


def _with_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def _save(rows: DataFrame, path: str, mode: str, files: int) -> None:
    """Days of rows, each in up to `files` files; in mode overwrite, days that rows has none of stay as they are."""
    dealt = rows.repartition("day", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("day", "ts")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def append_events(events: DataFrame, path: str, files: int = FILES) -> None:
    """Add events (id, ts, ...) to the store."""
    _save(_with_day(events), path, "append", files)


def stored_events(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events with since <= ts < until. The same bounds on the day let the scan skip folders."""
    rows = spark.read.option("basePath", path).parquet(path).withColumn("day", F.col("day").cast("string"))
    if since:
        rows = rows.filter((F.col("day") >= since[:10]) & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    if until:
        rows = rows.filter((F.col("day") <= until[:10]) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return rows


def delete_before(spark: SparkSession, path: str, before: str, only: Column | None = None, files: int = FILES) -> dict[str, list[str]]:
    """Delete events older than a time (of those that `only` holds for), and say what was done to which days.

    Days with nothing left are dropped as folders; days that keep some rows are written anew, by dynamic overwrite of
    their own folders; days without a row to delete are not touched. Without `only`, whole days before are dropped unread.
    A driver that is lost halfway leaves days as they were or as they are to be: the delete can be run again.
    """
    gone = F.coalesce((F.col("ts") < F.lit(before).cast("timestamp_ntz")) & (F.lit(True) if only is None else only), F.lit(False))
    rows = stored_events(spark, path).filter(F.col("day") <= before[:10])
    dropped: list[str] = []
    if only is None:
        dropped = [r["day"] for r in rows.filter(F.col("day") < before[:10]).select("day").distinct().collect()]  # a row for each day
        rows = rows.filter(F.col("day") == before[:10])
    counts = rows.groupBy("day").agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("kept")).filter("gone > 0").collect()
    rewritten = [r["day"] for r in counts if r["kept"]]
    dropped += [r["day"] for r in counts if not r["kept"]]
    if rewritten:
        _save(rows.filter(F.col("day").isin(rewritten)).filter(~gone), path, "overwrite", files)
    for day in dropped:
        remove_folder(spark, f"{path}/day={day}")
    return {"dropped": sorted(dropped), "rewritten": sorted(rewritten)}
