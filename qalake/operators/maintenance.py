"""Upserts, deletes and other upkeep of tables that are rewritten as snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: What an event log accepts.
EVENT_TYPES, MAX_PATH = ("pageview", "chat_question"), 2048


def snapshot_upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Rows of new in the place of old ones with equal keys; columns in keep_if_null keep an old value where the new is null.

    One shuffle on the keys (a full join); columns that one side lacks are null there. new has a row for each key at most.
    """
    columns = [*dict.fromkeys([*old.columns, *new.columns])]
    marked = lambda df, m: df.select(*[F.col(c).alias(f"{m}_{c}" if c not in keys else c) for c in df.columns], F.lit(True).alias(f"{m}_there"))
    both = marked(old, "old").join(marked(new, "new"), keys, "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        before = F.col(f"old_{c}") if c in old.columns else F.lit(None)
        after = F.col(f"new_{c}") if c in new.columns else F.lit(None)
        return F.when(F.col("new_there"), F.coalesce(after, before) if c in keep_if_null else after).otherwise(before).alias(c)

    return both.select(*[value(c) for c in columns])


def latest_of(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version for each key."""
    w = W.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def ingest_events(posted: DataFrame, types: Sequence[str] = EVENT_TYPES, max_path: int = MAX_PATH) -> DataFrame:
    """Posted events with a reason where they are rejected, and meta as JSON (plain text becomes a JSON string)."""
    reason = F.when(F.col("type").isNull() | ~F.col("type").isin(*types), "bad_type").when(F.length("path") > max_path, "path_too_long")
    meta = F.when(F.get_json_object("meta", "$").isNotNull(), F.col("meta")).otherwise(F.to_json(F.struct(F.col("meta").alias("text"))))
    return posted.select("*", reason.alias("reason")).withColumn("meta", F.when(F.col("meta").isNotNull(), meta))


def build_chat_event(responses: DataFrame) -> DataFrame:
    """Event rows from responses with usage, perf and model_info structs."""
    usage = F.when(F.col("usage.total_tokens") > 0, F.col("usage"))
    meta = F.struct("question", F.coalesce("cache_hit", F.lit("miss")).alias("cache_hit"), F.size("sources").alias("chunks_retrieved"), usage.alias("token_usage"))
    return responses.select(
        "id",
        F.lit("chat_question").alias("type"),
        F.coalesce("perf.provider", "usage.provider", "model_info.provider").alias("api_provider"),
        F.col("usage.total_tokens").alias("openai_total_tokens"),
        F.length("question").alias("prompt_chars"),
        F.length("answer").alias("answer_chars"),
        F.when(F.col("answer").isNotNull(), 1).otherwise(0).alias("success"),
        F.to_json(meta).alias("meta"),
    )


def evolve_schema(rows: DataFrame, wanted: T.StructType) -> DataFrame:
    """Rows with all wanted columns, missing ones null, and further ones after them."""
    empty = rows.sparkSession.createDataFrame([], wanted)
    return empty.unionByName(rows, allowMissingColumns=True)


def migrate_kv(counters: DataFrame, existing: DataFrame) -> DataFrame:
    """key, value (JSON) of counters (one row: numbers, arrays and maps), for keys that are not there yet."""
    rows = None
    for c in counters.columns:
        kind = counters.schema[c].dataType
        value = F.to_json(F.array_sort(c)) if isinstance(kind, T.ArrayType) else F.to_json(c) if isinstance(kind, T.MapType) else F.col(c).cast("string")
        own = counters.select(F.lit(c).alias("key"), value.alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(existing.select("key"), "key", "left_anti")


def delete_rows(rows: DataFrame, *, ids: DataFrame | None = None, key: str = "id", prefix: str | None = None, before: str | None = None, only: Column | None = None) -> DataFrame:
    """What is left: without rows of these ids, with this id prefix, or older than a time. only: what may be deleted."""
    may = F.lit(True) if only is None else only
    if prefix is not None:
        rows = rows.filter(~(F.col(key).cast("string").startswith(prefix) & may))
    if before is not None:
        rows = rows.filter(~((F.col("ts") < F.lit(before).cast("timestamp")) & may))
    if ids is not None:
        gone = rows.filter(may).select(key).join(ids.select(key), key, "left_semi").distinct()
        rows = rows.join(gone, key, "left_anti")
    return rows


def export_row(rows: DataFrame, key: str, value) -> DataFrame:
    """One record as JSON."""
    return rows.filter(F.col(key) == value).select(F.to_json(F.struct(*rows.columns)).alias("record"))


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Numbers of inserted, replaced and untouched rows of an upsert."""
    o, n = old.select(key, F.lit(1).alias("o")), new.select(key, F.lit(1).alias("n"))
    return o.join(n, key, "full").agg(
        F.count_if(F.col("o").isNull()).alias("inserted"),
        F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("replaced"),
        F.count_if(F.col("n").isNull()).alias("kept"),
    )
