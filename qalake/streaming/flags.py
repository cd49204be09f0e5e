"""Per-visitor flags over a request log (id, ip, ts, prompt), in the order of time and id.

Requests of one instant count in the order of their ids: the sixth of a burst is flagged, not all six. An address' log is
dealt out by hour, so that an address behind which a third of all requests stand is as many keys as there are hours; what an
hour needs to know of earlier ones (requests of the last hour, short prompts so far, the last prompt, when it was last
repeated) comes from a few values for each address and hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qalake.functions.times import micros
from qalake.session import stored

MINUTE = 60_000_000
HOUR = 60 * MINUTE
BURST, SHORT, REPEATS, SHORT_CHARS = 5, 3, 2, 5
#: Hourly limits and the requests above which they hold.
TIERS = ((20, 5), (10, 15))
NORMAL_LIMIT, EXEMPT_LIMIT = 250, 10_000


def _in_order(*frame: int) -> W:
    """An address' requests of an hour, in order; with a frame, if one is given."""
    w = W.partitionBy("ip", "__hour").orderBy("__t", "id")
    return w.rowsBetween(*frame) if frame else w


def _hours_before() -> W:
    return W.partitionBy("ip").orderBy("__hour").rowsBetween(W.unboundedPreceding, -1)


def _by_hour(requests: DataFrame) -> DataFrame:
    return requests.withColumn("__t", micros("ts")).withColumn("__hour", F.floor(F.col("__t") / HOUR))


def _with_last_hour(requests: DataFrame) -> DataFrame:
    """Each request in its own hour and, as what came before, in the next one."""
    rows = _by_hour(requests).withColumn("__at", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.withColumn("__hour", F.col("__hour") + F.col("__at"))


def _known(rows: DataFrame, hours: DataFrame, back: int = 0) -> DataFrame:
    """rows with the columns of hours (ip, __hour, ...), of so many hours back where there are any."""
    hours = hours.withColumnsRenamed({"ip": "__of", "__hour": "__when"})
    return rows.join(hours, rows["ip"].eqNullSafe(hours["__of"]) & (rows["__hour"] - back == hours["__when"]), "left").drop("__of", "__when")


def burst_flags(requests: DataFrame) -> DataFrame:
    """burst: the sixth request or a later one of an address within less than 60 seconds."""
    sixth = F.col("__t") - F.lag("__t", BURST).over(_in_order()) < MINUTE
    rows = _with_last_hour(requests).withColumn("burst", F.coalesce(sixth, F.lit(False)))
    return rows.filter("__at = 0").select(*requests.columns, "burst")


def short_prompt_flags(requests: DataFrame, counted: Column | None = None) -> DataFrame:
    """short: from the fourth prompt of under five characters on, which is never reset. counted: the requests that count (all)."""
    is_short = (F.length(F.trim(F.coalesce("prompt", F.lit("")))) < SHORT_CHARS) & (F.lit(True) if counted is None else counted)
    rows = _by_hour(requests).withColumn("__short", is_short.cast("int"))
    hours = rows.groupBy("ip", "__hour").agg(F.sum("__short").alias("n")).select("ip", "__hour", F.sum("n").over(_hours_before()).alias("__had"))
    n = F.coalesce("__had", F.lit(0)) + F.sum("__short").over(_in_order(W.unboundedPreceding, 0))
    return _known(rows, hours).withColumn("short", (F.col("__short") == 1) & (n > SHORT)).select(*requests.columns, "short")


def repeat_flags(requests: DataFrame, counted: Column | None = None) -> DataFrame:
    """repeat: the third time within ten minutes that a prompt equals the one before. counted: the requests that count (all)."""
    rows = _by_hour(requests).withColumn("__counted", F.lit(True) if counted is None else counted)
    last = F.max_by(F.struct("prompt"), F.when(F.col("__counted"), F.struct("__t", "id")))
    hours = rows.filter("__counted").groupBy("ip", "__hour").agg(last.alias("x"))
    every = rows.select("ip", "__hour").distinct()
    hours = _known(every, hours).select("ip", "__hour", F.last("x", ignorenulls=True).over(_hours_before()).alias("__had"))
    before = F.coalesce(F.last(F.when(F.col("__counted"), F.struct("prompt")), ignorenulls=True).over(_in_order(W.unboundedPreceding, -1)), F.col("__had"))
    rows = _known(rows, hours).withColumn("__before", before)
    same = F.coalesce(F.col("__counted") & (F.col("prompt") == F.col("__before")["prompt"]), F.lit(False))
    rows = rows.withColumn("__same", same).withColumn("__one", F.last(F.when(F.col("__same"), F.col("__t")), ignorenulls=True).over(_in_order(W.unboundedPreceding, -1)))
    rows = rows.withColumn("__two", F.last(F.when(F.col("__same"), F.coalesce("__one", F.lit(-1))), ignorenulls=True).over(_in_order(W.unboundedPreceding, -1)))
    # an hour's last two repetitions; the third of ten minutes needs no more, and none of an hour further back
    ends = rows.filter("__same").groupBy("ip", "__hour").agg(F.max_by(F.struct("__t", "__one"), F.struct("__t", "id")).alias("__end"))
    second = F.when(F.col("__one").isNull(), F.col("__end")["__one"]).when(F.col("__two") < 0, F.col("__end")["__t"]).otherwise(F.col("__two"))
    soon = F.coalesce(F.col("__t") - second < 10 * MINUTE, F.lit(False))
    return _known(rows, ends, 1).withColumn("repeat", F.col("__same") & soon).select(*requests.columns, "repeat")


def abuse_reason(requests: DataFrame, exempt: Sequence[str] = ()) -> DataFrame:
    """reason: burst, short or repeat; null for exempt addresses.

    A request that is flagged goes no further: one in a burst is no short prompt and no prompt before the next, and one of
    too many short prompts is no prompt before the next. The steps are written as tables, since each is read twice.
    """
    rows = stored(short_prompt_flags(stored(burst_flags(requests), "bursts"), ~F.col("burst")), "shorts")
    rows = repeat_flags(rows, ~F.col("burst") & ~F.col("short"))
    reason = F.coalesce(*[F.when(F.col(c), c) for c in ("burst", "short", "repeat")])
    return rows.withColumn("reason", F.when(~F.col("ip").isin(*exempt), reason) if exempt else reason)


def limit_for(in_hour: Column) -> Column:
    limit = F.lit(NORMAL_LIMIT)
    for above, value in reversed(TIERS):
        limit = F.when(in_hour > above, value).otherwise(limit)
    return limit


def rate_tier(requests: DataFrame, exempt: Sequence[str] = ()) -> DataFrame:
    """in_hour: requests of the address within the last hour, this one included; limit: those an hour that it may make."""
    older = F.count("*").over(W.partitionBy("ip", "__hour").orderBy("__t").rangeBetween(W.unboundedPreceding, -HOUR))
    rows = _with_last_hour(requests).withColumn("in_hour", F.row_number().over(_in_order()) - older).filter("__at = 0").select(*requests.columns, "in_hour")
    limit = limit_for(F.col("in_hour"))
    return rows.withColumn("limit", F.when(F.col("ip").isin(*exempt), EXEMPT_LIMIT).otherwise(limit) if exempt else limit)


def first_seen(requests: DataFrame) -> DataFrame:
    """is_new: an address's first request."""
    return requests.withColumn("is_new", F.row_number().over(W.partitionBy("ip").orderBy("ts", "id")) == 1)


def session_activity(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of sid: events with no longer gap between them."""
    table = events.groupBy("sid", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table.select("sid", stamp("w.start").alias("started"), stamp("w.end").alias("ended"), "n")
