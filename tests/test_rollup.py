"""Daily sketches: merged spans against exact figures, days rolled up again, groups without response times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qalake.operators import rollup


def log(spark, days=20, each=3000):
    """Response times that differ by day, some null; visitors that come back on other days."""
    rows = spark.range(days * each).selectExpr(
        "id", f"cast(id div {each} as int) as d", "case when id % 3 = 0 then 'pageview' else 'chat_question' end as type", "cast(pmod(xxhash64(id), 9000) as string) as sid",
        "case when id % 7 = 0 then null else concat('p', id % 2) end as api_provider",
    )
    ms = F.when(F.col("id") % 11 != 0, (F.exp(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 150) * (1 + F.col("d"))).cast("int"))
    rows = rows.withColumn("response_ms", F.when(F.col("type") == "chat_question", ms)).withColumn("answer_chars", F.when(F.col("id") % 5 != 0, F.col("id") % 100))
    return rows.selectExpr("*", "timestamp_ntz'2024-01-01 05:00:00' + make_dt_interval(d) as ts", "10 as prompt_chars", "cast(id % 2 as int) as success")


def quantile_gap(values, q, x):
    values = np.asarray(values)
    return max((values < x).mean() - q, q - (values <= x).mean(), 0)


@pytest.mark.parametrize("since,until", [(None, None), ("2024-01-03", "2024-01-09"), ("2024-01-20", None)])
def test_spans_are_within_the_stated_bounds(spark, tmp_path, since, until):
    events = log(spark)
    path = str(tmp_path / "days")
    rollup.save_days(rollup.daily_rollup(events, F.col("api_provider")), path)
    own = events.filter((F.to_date("ts") >= (since or "2000-01-01")) & (F.to_date("ts") <= (until or "2100-01-01"))).toPandas()
    own["part"] = own.api_provider.fillna("unknown")
    for q in (0.5, 0.95):
        for r in rollup.figures(rollup.span(rollup.stored_days(spark, path), since, until), q).collect():
            rows = own[own.part == r.part]
            timed = rows[rows.response_ms.notna()]
            assert (r.pageviews, r.chats, r.n) == ((rows.type == "pageview").sum(), (rows.type == "chat_question").sum(), len(timed))
            assert r.average_ms == pytest.approx(timed.response_ms.mean(), abs=1e-3) and r.answer_chars == pytest.approx(timed.answer_chars.mean(), abs=1e-3)
            assert r.success_rate == pytest.approx(100 * timed.success.mean(), abs=1e-3) and r.prompt_chars == 10
            assert quantile_gap(timed.response_ms, q, r.quantile_ms) <= 2 * rollup.rank_error()
            uniques = rows[rows.type == "pageview"].sid.nunique()
            assert abs(r.visitors - uniques) <= 5 * rollup.distinct_error() * uniques
    every = rollup.figures(rollup.span(rollup.stored_days(spark, path), since, until, whole=True)).collect()
    assert len(every) == 1 and every[0].n == own.response_ms.notna().sum()


def test_a_span_reads_its_days_only_and_a_day_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "days")
    events = log(spark, 5, 60)
    rollup.save_days(rollup.daily_rollup(events), path)
    plan = rollup.span(rollup.stored_days(spark, path), "2024-01-02", "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    before = {r.day: r.chats for r in rollup.stored_days(spark, path).collect()}
    late = events.filter("d = 2").unionByName(events.filter("d = 2"))
    rollup.save_days(rollup.daily_rollup(late), path)
    after = {r.day: r.chats for r in rollup.stored_days(spark, path).collect()}
    assert after == {**before, "2024-01-03": 2 * before["2024-01-03"]} and len(after) == 5


def test_groups_without_values(spark):
    events = log(spark, 2, 30).withColumn("response_ms", F.lit(None).cast("int"))
    r = rollup.figures(rollup.span(rollup.daily_rollup(events))).first()
    assert (r.n, r.average_ms, r.quantile_ms, r.answer_chars, r.success_rate) == (0, None, None, None, None) and r.chats == 40
    only = rollup.figures(rollup.daily_rollup(events.filter("type = 'chat_question'"))).collect()
    assert len(only) == 2 and {x.visitors for x in only} == {0}
    assert rollup.daily_rollup(events.limit(0)).count() == 0
    assert rollup.span(rollup.daily_rollup(events.limit(0))).count() == 0
