"""Event store, ingest into two tables, the embedding memo, and live windows with late rows."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from qalake.operators import maintenance, retrieval
from qalake.sources import store
from qalake.streaming import flags, live, sinks

from .test_guard import stream_of

T0 = datetime(2024, 3, 1)


def events(spark, days=6, each=40):
    rows = spark.range(days * each).selectExpr("id", f"timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(cast(id div {each} as int), cast(id % 24 as int)) as ts")
    return rows.withColumn("type", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_store_reads_and_rewrites_only_what_it_must(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append_events(events(spark), path, 2)
    span = store.stored_events(spark, path, "2024-03-02 06:00:00", "2024-03-04 00:00:00")
    plan = span._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    want = {r.id for r in events(spark).filter("ts >= '2024-03-02 06:00:00' and ts < '2024-03-04'").collect()}
    assert {r.id for r in span.collect()} == want
    before = files(path)
    done = store.delete_before(spark, path, "2024-03-03 12:00:00", files=2)
    assert done == {"dropped": ["2024-03-01", "2024-03-02"], "rewritten": ["2024-03-03"]}
    after = files(path)
    assert {f for f in before if "day=2024-03-0" in f and f.split("day=")[1][:10] > "2024-03-03"} <= after
    assert not [f for f in after if f.split("day=")[1][:10] < "2024-03-03"]
    left = {r.id for r in events(spark).filter("ts >= '2024-03-03 12:00:00'").collect()}
    assert {r.id for r in store.stored_events(spark, path).collect()} == left
    some = store.delete_before(spark, path, "2024-03-05 00:00:00", F.col("type") == "a", 2)
    assert some == {"dropped": [], "rewritten": ["2024-03-03", "2024-03-04"]}
    assert store.delete_before(spark, path, "2024-03-05 00:00:00", F.col("type") == "a", 2) == {"dropped": [], "rewritten": []}
    want = {r.id for r in events(spark).filter("ts >= '2024-03-03 12:00:00' and (type <> 'a' or ts >= '2024-03-05')").collect()}
    assert {r.id for r in store.stored_events(spark, path).collect()} == want


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    posted = spark.createDataFrame([(1, "pageview", "/a", "x"), (2, None, "/b", None), (3, "chat_question", "y" * 3000, "{}"), (4, "other", "/c", "{}")], "id long, type string, path string, meta string")
    write = sinks.two_sinks(str(tmp_path / "in"))
    for number, rows in ((0, posted), (1, posted.filter("id < 3")), (1, posted.filter("id < 3")), (0, posted)):
        write(rows, number)
    accepted, rejected = sinks.read_sinks(spark, str(tmp_path / "in"))
    assert sorted((r.batch, r.id) for r in accepted.collect()) == [(0, 1), (1, 1)]
    assert sorted((r.batch, r.id, r.reason) for r in rejected.collect()) == [(0, 2, "bad_type"), (0, 3, "path_too_long"), (0, 4, "bad_type"), (1, 2, "bad_type")]
    judged = maintenance.ingest_events(posted)
    assert accepted.filter("batch = 0").count() == judged.filter("reason is null").count()


def test_memo_encodes_each_text_once(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.mkdir(log)

    def encode(texts):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(texts))
        return [[float(len(t))] for t in texts]

    def calls():
        found = [open(f"{log}/{f}").read().split("\n") for f in os.listdir(log)]
        for f in os.listdir(log):
            os.remove(f"{log}/{f}")
        return found

    memo = str(tmp_path / "memo")
    one = spark.createDataFrame([(f"Text {i % 70}",) for i in range(200)] + [(None,)], "text string")
    rows, n = retrieval.embed_texts(one, encode, memo, "m", 8, 1000)
    made = calls()
    assert n == 70 and rows.count() == 70 and sorted(t for c in made for t in c) == sorted(f"text {i}" for i in range(70)) and max(map(len, made)) == 8
    two = one.unionByName(spark.createDataFrame([("more",), ("TEXT 1",)], "text string"))
    rows, n = retrieval.embed_texts(two, encode, memo, "m", 8, 1000)
    assert n == 1 and calls() == [["more"]] and {r.embedding[0] for r in rows.collect()} == {4.0, 6.0, 7.0}
    assert retrieval.embed_texts(two, encode, memo, "m", 8, 1000)[1] == 0 and calls() == []
    assert retrieval.embed_texts(one.limit(1), encode, memo, "other model", 8, 1000)[1] == 1


def test_live_sessions_and_visitors_with_late_rows(spark, tmp_path):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    first = [(i, "s1", at(10 * i), "") for i in range(4)] + [(10, "s2", at(5), "")]
    more = [(20, "s1", at(200), ""), (21, "s2", at(190), "")]
    then = [(30, "s2", at(195), ""), (31, "s3", at(205), "")]
    late = [(40, "s1", at(20), "too late"), (41, "s1", at(210), ""), (42, "s9", at(1), "too late")]
    end = [(50, "s4", at(2000), "")]
    source = stream_of(spark, tmp_path, [first, more, then, late, end]).withColumnRenamed("ip", "sid")
    table, dropped = live.drained(sinks.session_stream(source), "sessions")
    in_time = [r for r in first + more + then + late + end if r[3] != "too late"]
    rows = spark.createDataFrame([(r[1], r[2]) for r in in_time], "sid string, ts timestamp")
    closed = flags.session_activity(rows).filter("sid <> 's4'")
    assert dropped == 2 and sorted(map(tuple, table.collect())) == sorted(map(tuple, closed.collect()))
    visitors, dropped = live.drained(live.new_visitors(source.withColumnRenamed("sid", "ip"), "1 hour").select("ip"), "visitors")
    # s1 is new again once the watermark has passed its first request by an hour; s2 came back before
    assert dropped == 2 and sorted(r.ip for r in visitors.collect()) == ["s1", "s1", "s2", "s3", "s4"]


def test_rate_windows(spark, tmp_path):
    rows = [(i, "a", T0 + timedelta(minutes=i), "") for i in range(20)] + [(100, "b", T0, "")]
    source = stream_of(spark, tmp_path, [rows, [(200, "c", T0 + timedelta(hours=9), "")]])
    got = {r.started: r.n for r in live.drain(sinks.rate_windows(source), "rates").collect()}
    want = {}
    for start in range(-60, 30):
        n = sum(start <= i < start + 60 for i in range(20))
        if n > 10:
            want[(T0 + timedelta(minutes=start)).strftime("%Y-%m-%d %H:%M:%S")] = n
    assert got == want
