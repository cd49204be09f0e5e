"""Request flags in order of time and id: batch forms and the live state machine against a plain loop."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from qalake.streaming import flags, guard, live

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, ip string, ts timestamp, prompt string"


def log(seed, n, addresses, seconds):
    """Whole seconds, so that many requests share an instant; ids are not in the order of time."""
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    prompts = ["hi", "a long prompt", "a long prompt", "another one", " x ", None, ""]
    return [(i, f"10.0.0.{rng.randrange(addresses)}", T0 + timedelta(seconds=rng.randrange(seconds)), rng.choice(prompts)) for i in ids]


def plain(rows):
    """id: (reason, in_hour), request by request."""
    out, known = {}, {}
    for i, ip, ts, prompt in sorted(rows, key=lambda r: (r[2], r[0])):
        k = known.setdefault(ip, {"times": [], "shorts": 0, "last": None, "same": []})
        k["times"] = [t for t in k["times"] if ts - t < timedelta(hours=1)] + [ts]
        reason = None
        if sum(ts - t < timedelta(minutes=1) for t in k["times"]) > 5:
            reason = "burst"
        if reason is None and len((prompt or "").strip()) < 5:
            k["shorts"] += 1
            reason = "short" if k["shorts"] > 3 else None
        if reason is None:
            if prompt is not None and prompt == k["last"]:
                k["same"] = [t for t in k["same"] if ts - t < timedelta(minutes=10)] + [ts]
                reason = "repeat" if len(k["same"]) > 2 else None
            if reason is None:
                k["last"] = prompt
        out[i] = (reason, len(k["times"]))
    return out


@pytest.mark.parametrize("seed,n,addresses,seconds", [(1, 400, 2, 3 * 3600), (2, 300, 1, 600), (3, 500, 30, 20 * 3600), (4, 60, 1, 4 * 3600)])
def test_batch_flags_in_order(spark, seed, n, addresses, seconds):
    rows = log(seed, n, addresses, seconds)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    assert {r.id: r.reason for r in flags.abuse_reason(df).collect()} == {i: w[0] for i, w in want.items()}
    assert {r.id: r.in_hour for r in flags.rate_tier(df).collect()} == {i: w[1] for i, w in want.items()}


def test_ties(spark):
    burst = spark.createDataFrame([(i, "1.1.1.1", T0, f"prompt {i}") for i in range(6)], SCHEMA)
    assert [r.id for r in flags.burst_flags(burst).filter("burst").collect()] == [5]
    same = spark.createDataFrame([(i, "1.1.1.1", T0, "the same") for i in range(4)], SCHEMA)
    assert [r.id for r in flags.repeat_flags(same).filter("repeat").collect()] == [3]
    hour = spark.createDataFrame([(i, "1.1.1.1", T0, "x") for i in range(12)], SCHEMA)
    assert [r.in_hour for r in flags.rate_tier(hour).orderBy("id").collect()] == list(range(1, 13))
    assert [r.limit for r in flags.rate_tier(hour).orderBy("id").collect()] == [250] * 10 + [15] * 2


def stream_of(spark, tmp_path, batches):
    """A stream that reads a file of rows in each micro-batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        for name in os.listdir(f"{tmp_path}/in/part={n}"):
            os.utime(f"{tmp_path}/in/part={n}/{name}", (1_700_000_000 + 100 * n,) * 2)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    return source.parquet(f"{tmp_path}/in")


def test_live_flags_equal_the_batch_form(spark, tmp_path):
    """Rows of a micro-batch come in any order, and up to ten minutes late, across micro-batches."""
    rng = random.Random(9)
    rows = sorted(log(5, 600, 4, 2 * 3600), key=lambda r: r[2] + timedelta(seconds=rng.randrange(590)))
    parts = [rows[i : i + 120] for i in range(0, 600, 120)]
    for p in parts:
        rng.shuffle(p)
    end = max(r[2] for r in rows)
    table, late = live.drained(guard.request_guard(stream_of(spark, tmp_path, parts), ["10.0.0.3"]), "guard")
    got = {r.id: (r.reason, r.in_hour, r.limit) for r in table.collect()}
    want = {}
    for i, ip, ts, _ in rows:
        if ts <= end - timedelta(minutes=10):
            reason, n = plain_of(rows)[i]
            want[i] = (None, n, 10_000) if ip == "10.0.0.3" else (reason, n, 5 if n > 20 else 15 if n > 10 else 250)
    assert late == 0 and got == want and {r for r, *_ in got.values()} >= {"burst", "short", "repeat", None}


def plain_of(rows, cache={}):  # noqa: B006
    if "x" not in cache:
        cache["x"] = plain(rows)
    return cache["x"]


def test_late_requests_are_left_out_and_counted(spark, tmp_path):
    first = [(i, "1.1.1.1", T0 + timedelta(minutes=i), "a prompt") for i in range(60)]
    more = [(60, "1.1.1.1", T0 + timedelta(minutes=60), "a prompt")]  # a watermark tells what is late from the next batch on
    then = [(100, "1.1.1.1", T0 + timedelta(minutes=30), "late"), (101, "1.1.1.1", T0 + timedelta(minutes=55), "in time")]
    last = [(102, "2.2.2.2", T0 + timedelta(hours=40 * 24), "much later"), (103, "1.1.1.1", T0 + timedelta(hours=40 * 24), "hi")]
    end = [(104, "3.3.3.3", T0 + timedelta(hours=41 * 24), "the end")]
    table, late = live.drained(guard.request_guard(stream_of(spark, tmp_path, [first, more, then, last, end]), forget=24), "guard")
    got = {r.id: r.in_hour for r in table.collect()}
    assert late == 1 and 100 not in got and got[101] == 57 and got[59] == 61 and got[60] == 61 and got[103] == 1 and 104 not in got


def test_state_is_forgotten():
    seen = guard.Seen()
    verdicts = [seen.judge(guard.HOUR * i, "hi")[0] for i in range(5)]
    assert verdicts == [None, None, None, "short", "short"] and len(seen.times) == 1


def test_hours_are_the_keys_of_a_hot_address(spark):
    df = spark.createDataFrame(log(1, 10, 1, 10), SCHEMA)
    plan = flags.burst_flags(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ip" in plan and "__hour" in plan.split("hashpartitioning(ip", 1)[1][:40]
    assert flags.burst_flags(df.filter(F.lit(False))).count() == 0
