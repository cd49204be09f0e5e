"""Traffic reports over an event log. `as_of` takes the place of the present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def since(as_of: str, days: int) -> Column:
    """ts is not before as_of - days. The bound is a constant without a zone: next to stored times nothing is cast, and scans skip by it."""
    return F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")


def recent_events(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Events of the last days; a plain comparison on ts, which scans push down."""
    return events.filter(since(as_of, days))


def is_type(kind: str) -> Column:
    return F.col("type") == kind


def traffic_totals(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return recent_events(events, as_of, days).agg(
        F.count_if(is_type("pageview")).alias("pageviews"),
        F.countDistinct(F.when(is_type("pageview"), F.col("sid"))).alias("uniques"),
        F.count_if(is_type("chat_question")).alias("chat_questions"),
    )


def _count_of(value: Column) -> Column:
    """A stored counter: digits as a number, anything else 0."""
    return F.when(value.rlike("^[0-9]+$"), value.cast("long")).otherwise(F.lit(0))


def legacy_totals(kv: DataFrame) -> DataFrame:
    value = lambda key, of: F.coalesce(F.max(F.when(F.col("key") == key, of)), F.lit(0)).cast("long")
    size = F.size(F.from_json("value", T.ArrayType(T.StringType())))
    return kv.agg(
        value("ask_count", _count_of(F.col("value"))).alias("ask_count"),
        value("visit_count", _count_of(F.col("value"))).alias("visit_count"),
        value("unique_visitors", F.greatest(size, F.lit(0))).alias("unique_count"),
    )


def ratio(part: Column, whole: Column, factor: float = 1.0, digits: int = 4) -> Column:
    """factor * part / whole, 0 where whole is 0."""
    return F.when(whole > 0, F.round(part * factor / whole, digits)).otherwise(F.lit(0.0))


def combined_totals(events: DataFrame, kv: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Sums of new and legacy totals with engagement rate and questions per user. Both sides are one row."""
    both = traffic_totals(events, as_of, days).crossJoin(legacy_totals(kv))
    sums = both.select(
        (F.col("chat_questions") + F.col("ask_count")).alias("asks"),
        (F.col("pageviews") + F.col("visit_count")).alias("visits"),
        (F.col("uniques") + F.col("unique_count")).alias("visitors"),
    )
    return sums.select("*", ratio(F.col("asks"), F.col("visits"), 100.0).alias("engagement_rate"), ratio(F.col("asks"), F.col("visitors")).alias("questions_per_user"))


def day_of(ts: str = "ts") -> Column:
    return F.to_date(ts).cast("string")


def traffic_by_day(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return (
        recent_events(events, as_of, days)
        .groupBy(day_of().alias("day"))
        .agg(F.count_if(is_type("pageview")).alias("pageviews"), F.count_if(is_type("chat_question")).alias("chats"), F.countDistinct(F.when(is_type("pageview"), F.col("sid"))).alias("uniques"))
        .orderBy("day")
    )


def top_values(events: DataFrame, column: str, missing: str, n: int = 10) -> DataFrame:
    """The n most frequent values; equal counts by value."""
    return events.groupBy(F.coalesce(column, F.lit(missing)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def location_counts(events: DataFrame) -> DataFrame:
    return events.filter(is_type("visitor_location") & F.col("location").isNotNull()).groupBy("location").agg(F.count("*").alias("n"))


def legacy_location_counts(kv: DataFrame, key: str = "locations") -> DataFrame:
    parsed = F.from_json("value", T.MapType(T.StringType(), T.LongType()))
    return kv.filter(F.col("key") == key).select(F.explode(parsed).alias("location", "n"))


def location_totals(events: DataFrame, kv: DataFrame) -> DataFrame:
    both = location_counts(events).unionByName(legacy_location_counts(kv))
    return both.groupBy("location").agg(F.sum("n").alias("n")).filter("n > 0")


def location_class(location: Column) -> Column:
    return (
        F.when(location == "Local", "local").when(location == "Unknown", "unknown").when(location.startswith("International-"), "international")
        .when(location.rlike("^[A-Za-z]{2}$"), "us_state").otherwise("other")
    )


def location_classes(totals: DataFrame) -> DataFrame:
    """Counts by class, with upper-case states summed, and what is tracked in all."""
    return totals.groupBy(location_class(F.col("location")).alias("class")).agg(
        F.sum("n").alias("n"),
        F.countDistinct(F.upper("location")).alias("places"),
    ).withColumn("total_tracked", F.sum("n").over(W.partitionBy()))


def state_counts(totals: DataFrame) -> DataFrame:
    states = totals.filter(location_class(F.col("location")) == "us_state")
    return states.groupBy(F.upper("location").alias("state")).agg(F.sum("n").alias("n"))


def top_states(totals: DataFrame, n: int = 6) -> DataFrame:
    """The n largest states with the number of states and the total; states are at most some hundreds of rows."""
    every = W.partitionBy()
    return state_counts(totals).select("state", "n", F.count("*").over(every).alias("states"), F.sum("n").over(every).alias("us_total")).orderBy(F.desc("n"), "state").limit(n)


def state_intensity(totals: DataFrame) -> DataFrame:
    return state_counts(totals).select("state", F.round(F.col("n") / F.max("n").over(W.partitionBy()), 6).alias("intensity"))


def ip_number(ip: Column) -> Column:
    part = F.split(ip, r"\.")
    return sum((F.try_element_at(part, F.lit(i + 1)).try_cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))


def private_ip(ip: Column) -> Column:
    """Loopback and RFC 1918 addresses."""
    return ip.rlike(r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def classify_ip(addresses: DataFrame, ranges: DataFrame, bucket_bits: int = 24) -> DataFrame:
    """Location of each address: Local, the region of the range it is in, or Unknown.

    A range join by buckets: each range is listed under the buckets of 2^bucket_bits addresses that it meets, and an
    address looks only at its own, so that no address is compared with all ranges.
    """
    size = 1 << bucket_bits
    a = addresses.select("ip").distinct().withColumn("number", ip_number(F.col("ip"))).withColumn("bucket", F.floor(F.col("number") / size))
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    joined = a.join(r, (a.bucket == r.bucket) & a.number.between(r.lo, r.hi), "left")
    return joined.select("ip", F.when(private_ip(F.col("ip")), "Local").otherwise(F.coalesce("region", F.lit("Unknown"))).alias("place"))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """The first address that a proxy forwarded, else the peer's."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.nullif(first, F.lit("")), remote)


def lifetime_counters(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count_if(is_type("chat_question")).alias("asks"), F.count_if(is_type("pageview")).alias("visits"), F.countDistinct("ip").alias("unique_visitors"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_visit"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_update"),
    )


def service_start(events: DataFrame, as_of: str) -> DataFrame:
    """The first event's time, or 30 days before as_of."""
    start = F.coalesce(F.min("ts"), F.lit(as_of).cast("timestamp") - F.expr("interval 30 days"))
    return events.agg(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("started"))
