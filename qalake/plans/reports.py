"""Queries of the traffic and usage reports."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from qalake.operators import rollup, traffic, usage
from qalake.sources.tables import AS_OF

from .catalog import query

T = f"timestamp '{AS_OF}'"
WEEK = f"ts >= {T} - interval 7 days"
MONTH = f"ts >= {T} - interval 30 days"
STAMP = "'%Y-%m-%d %H:%M:%S'"

query("recent_events", lambda v: traffic.recent_events(v.ev, AS_OF, 7).select("id", "type", "sid", "path"), f"select id, type, sid, path from ev where {WEEK}", "ev")
TOTALS = f"""select count(*) filter (where type = 'pageview') as pageviews, count(distinct case when type = 'pageview' then sid end) as uniques,
  count(*) filter (where type = 'chat_question') as chat_questions from ev where {MONTH}"""
query("traffic_totals", lambda v: traffic.traffic_totals(v.ev, AS_OF), TOTALS, "ev")
LEGACY = """select max(case when key = 'ask_count' and regexp_matches(value, '^[0-9]+$') then cast(value as bigint) else 0 end) as ask_count,
  max(case when key = 'visit_count' and regexp_matches(value, '^[0-9]+$') then cast(value as bigint) else 0 end) as visit_count,
  cast(max(case when key = 'unique_visitors' then json_array_length(value) else 0 end) as bigint) as unique_count from kv"""
query("legacy_totals", lambda v: traffic.legacy_totals(v.kv), LEGACY, "kv")
query(
    "combined_totals",
    lambda v: traffic.combined_totals(v.ev, v.kv, AS_OF),
    f"""select asks, visits, visitors, round(asks * 100.0 / visits, 4) as engagement_rate, round(asks * 1.0 / visitors, 4) as questions_per_user from (
  select chat_questions + ask_count as asks, pageviews + visit_count as visits, uniques + unique_count as visitors from ({TOTALS}) a cross join ({LEGACY}) b) c""",
    "ev kv",
)
query(
    "traffic_by_day",
    lambda v: traffic.traffic_by_day(v.ev, AS_OF),
    f"""select cast(cast(ts as date) as varchar) as day, count(*) filter (where type = 'pageview') as pageviews, count(*) filter (where type = 'chat_question') as chats,
  count(distinct case when type = 'pageview' then sid end) as uniques from ev where {MONTH} group by 1""",
    "ev",
)
query(
    "top_pages",
    lambda v: traffic.top_values(traffic.recent_events(v.ev, AS_OF).filter(traffic.is_type("pageview")), "path", "(none)"),
    f"select coalesce(path, '(none)') as path, count(*) as n from ev where {MONTH} and type = 'pageview' group by 1 order by n desc, 1 limit 10",
    "ev",
)
query(
    "top_referrers",
    lambda v: traffic.top_values(traffic.recent_events(v.ev, AS_OF).filter(traffic.is_type("pageview")), "ref", "(direct)"),
    f"select coalesce(ref, '(direct)') as ref, count(*) as n from ev where {MONTH} and type = 'pageview' group by 1 order by n desc, 1 limit 10",
    "ev",
)
PLACES = "select location, count(*) as n from ev where type = 'visitor_location' and location is not null group by 1"
OLD_PLACES = "select unnest(json_keys(value)) as location, cast(json_extract_string(value, '$.\"' || unnest(json_keys(value)) || '\"') as bigint) as n from kv where key = 'locations'"
query("location_counts", lambda v: traffic.location_counts(v.ev), PLACES, "ev")
query("legacy_location_counts", lambda v: traffic.legacy_location_counts(v.kv), OLD_PLACES, "kv")
ALL_PLACES = f"select location, cast(sum(n) as bigint) as n from ({PLACES} union all {OLD_PLACES}) p group by 1 having sum(n) > 0"
query("location_totals", lambda v: traffic.location_totals(v.ev, v.kv), ALL_PLACES, "ev kv")
CLASS = """case when location = 'Local' then 'local' when location = 'Unknown' then 'unknown' when location like 'International-%' then 'international'
  when regexp_matches(location, '^[A-Za-z]{2}$') then 'us_state' else 'other' end"""
query(
    "location_classes",
    lambda v: traffic.location_classes(traffic.location_totals(v.ev, v.kv)),
    f"select *, cast(sum(n) over () as bigint) as total_tracked from (select {CLASS} as class, cast(sum(n) as bigint) as n, count(distinct "
    f"upper(location)) as places from ({ALL_PLACES}) t group by 1) u",
    "ev kv",
)
STATES = f"select upper(location) as state, cast(sum(n) as bigint) as n from ({ALL_PLACES}) t where {CLASS} = 'us_state' group by 1"
query(
    "top_states",
    lambda v: traffic.top_states(traffic.location_totals(v.ev, v.kv)),
    f"select state, n, count(*) over () as states, cast(sum(n) over () as bigint) as us_total from ({STATES}) s order by n desc, state limit 6",
    "ev kv",
)
query("state_intensity", lambda v: traffic.state_intensity(traffic.location_totals(v.ev, v.kv)), f"select state, round(n * 1.0 / max(n) over (), 6) as intensity from ({STATES}) s", "ev kv")
query(
    "classify_ip",
    lambda v: traffic.classify_ip(v.ev, v.ip_ranges),
    r"""select distinct ip, case when regexp_matches(ip, '^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)') then 'Local' else coalesce(region, 'Unknown') end as place
  from ev left
    join ip_ranges on cast(split_part(ip, '.', 1) as bigint) * 16777216 + cast(split_part(ip, '.', 2) as bigint) * 65536 + cast(split_part(ip, '.', 3) as bigint) * 256 + cast(split_part(ip, '.', 4) as bigint) between lo and hi""",
    "ev ip_ranges",
)
query(
    "client_ip",
    lambda v: v.ev.select("id", traffic.client_ip(F.when(F.col("k") % 3 == 0, F.concat(F.lit(" 203.0.113.1 ,"), "ip")).when(F.col("k") % 3 == 1, ""), F.col("ip")).alias("client")),
    "select id, case when k % 3 = 0 then '203.0.113.1' else ip end as client from ev",
    "ev",
)
query(
    "lifetime_counters",
    lambda v: traffic.lifetime_counters(v.ev),
    f"""select count(*) filter (where type = 'chat_question') as asks, count(*) filter (where type = 'pageview') as visits, count(distinct ip) as unique_visitors,
  strftime(min(ts), {STAMP}) as first_visit, strftime(max(ts), {STAMP}) as last_update from ev""",
    "ev",
)
query("service_start", lambda v: traffic.service_start(v.ev, AS_OF), f"select strftime(coalesce(min(ts), {T} - interval 30 days), {STAMP}) as started from ev", "ev")

CHATS = f"type = 'chat_question' and {MONTH}"
TOKENS = f"{CHATS} and openai_total_tokens is not null"
query(
    "token_summary",
    lambda v: usage.token_summary(v.ev, AS_OF),
    f"""select count(*) as n, cast(sum(openai_total_tokens) as bigint) as total, round(avg(openai_total_tokens), 4) as average, cast(sum(openai_prompt_tokens) as bigint) as prompt,
  cast(sum(openai_completion_tokens) as bigint) as completion, count(distinct model_used) as models, count(distinct api_provider) as providers from ev where {TOKENS}""",
    "ev",
)
query(
    "token_daily",
    lambda v: usage.token_daily(v.ev, AS_OF),
    f"select cast(cast(ts as date) as varchar) as day, cast(sum(openai_total_tokens) as bigint) as total, round(avg(openai_total_tokens), 4) as "
    f"average, count(*) as n from ev where {TOKENS} group by 1 order by day desc limit 30",
    "ev",
)
query(
    "model_breakdown",
    lambda v: usage.model_breakdown(v.ev, AS_OF),
    f"""select model_used, api_provider, count(*) as n, cast(sum(openai_total_tokens) as bigint) as total, round(avg(openai_total_tokens), 4) as average from ev where {CHATS}
  group by 1, 2 order by total desc nulls last, model_used nulls last, api_provider nulls last limit 10""",
    "ev",
)
query(
    "completion_share",
    lambda v: usage.completion_share(v.ev, AS_OF),
    f"select round(100.0 * sum(openai_completion_tokens) / greatest(sum(openai_total_tokens), 1), 4) as completion_share from ev where {TOKENS}",
    "ev",
)
FIRST = "count(*) as n, round(avg(response_ms), 4) as average_ms, round(quantile_cont(response_ms, 0.95), 4) as p95_ms"
LATENCY = f"{FIRST}, round(avg(answer_chars), 4) as answer_chars, round(avg(prompt_chars), 4) as prompt_chars, round(100 * avg(success), 4) as success_rate"
query("latency_summary", lambda v: usage.latency_summary(v.ev, AS_OF), f"select {LATENCY} from ev where {CHATS} and response_ms is not null", "ev")
query(
    "latency_by_provider",
    lambda v: usage.latency_by_provider(v.ev, AS_OF),
    f"select coalesce(api_provider, 'unknown') as provider, {LATENCY} from ev where {CHATS} and response_ms is not null group by 1",
    "ev",
)
query(
    "latency_daily",
    lambda v: usage.latency_daily(v.ev, AS_OF),
    f"select cast(cast(ts as date) as varchar) as day, {FIRST} from ev where {CHATS} and response_ms is not null group by 1 order by day desc limit 30",
    "ev",
)


def latency_rollup(v):
    """Latency by provider over the last whole days, from daily sketches merged; the quantile's exact rank is checked beside it."""
    provider = F.col("api_provider")
    days = rollup.daily_rollup(v.ev, provider)
    found = rollup.figures(rollup.span(days, FROM_DAY)).filter("n > 0")
    gaps = rollup.rank_gap(v.ev.filter(F.col("ts") >= F.lit(FROM_DAY).cast("timestamp_ntz")), found, provider)
    close = (F.col("gap") <= 2 * rollup.rank_error()).alias("p95_close")
    return found.join(gaps, "part").select(F.col("part").alias("provider"), "chats", "n", "average_ms", "answer_chars", "prompt_chars", "success_rate", close)


def traffic_rollup(v):
    """Traffic by week, each merged from its days' sketches; visitors are checked against the exact number."""
    week = F.date_format(F.date_trunc("week", F.col("day").cast("date")), "yyyy-MM-dd")
    weeks = rollup.figures(rollup.span(rollup.daily_rollup(v.ev).withColumn("part", week)))
    exact = v.ev.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("part")).agg(F.countDistinct(F.when(F.col("type") == "pageview", F.col("sid"))).alias("uniques"))
    close = (F.abs(F.col("visitors") - F.col("uniques")) <= 5 * rollup.distinct_error() * F.col("uniques")).alias("uniques_close")
    return weeks.join(exact, "part").select(F.col("part").alias("week"), "pageviews", "chats", "uniques", close)


FROM_DAY = str(date.fromisoformat(AS_OF[:10]) - timedelta(days=30))
query(
    "latency_rollup",
    latency_rollup,
    f"""with c as (select *, coalesce(api_provider, 'unknown') as provider from ev where ts >= timestamp '{FROM_DAY}' and type = 'chat_question')
select provider, count(*) as chats, count(response_ms) as n, round(avg(response_ms), 4) as average_ms, round(avg(answer_chars) filter (where response_ms is not null), 4) as answer_chars,
  round(avg(prompt_chars) filter (where response_ms is not null), 4) as prompt_chars, round(100 * avg(success) filter (where response_ms is not null), 4) as success_rate, true as p95_close
  from c group by 1 having count(response_ms) > 0""",
    "ev",
)
query(
    "traffic_rollup",
    traffic_rollup,
    """select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(*) filter (where type = 'pageview') as pageviews, count(*) filter (where type = 'chat_question') as chats,
  count(distinct case when type = 'pageview' then sid end) as uniques, true as uniques_close from ev group by 1""",
    "ev",
)


def with_meta(ev):
    """Events whose meta holds the fields that the log's writer puts there."""
    usage_ = F.when(
        F.col("openai_total_tokens") > 0,
        F.struct(
            F.col("openai_prompt_tokens").alias("prompt_tokens"),
            F.col("openai_completion_tokens").alias("completion_tokens"),
            F.col("openai_total_tokens").alias("total_tokens"),
        ),
    )
    meta = F.to_json(F.struct("question", "cache_hit", (F.col("k") / 100).alias("semantic_similarity"), (F.col("k") % 8).alias("chunks_retrieved"), usage_.alias("token_usage")))
    return ev.withColumn("meta", F.when(F.col("k") % 17 != 0, meta))


query(
    "timeline_page",
    lambda v: usage.timeline_page(with_meta(v.ev), "semantic", 50, 20),
    f"""select id, strftime(ts, {STAMP}) as at, question, 'semantic' as cache_hit, round(k / 100.0, 4) as similarity, k % 8 as chunks, coalesce(openai_total_tokens, 0) as tokens, coalesce(response_ms, 0) as response_ms
  from ev where type = 'chat_question' and k % 17 <> 0 and cache_hit = 'semantic' order by ts desc, id desc limit 50 offset 20""",
    "ev",
)
query(
    "cache_window_stats",
    lambda v: usage.cache_window_stats(v.ev, AS_OF, 48),
    f"""select *, round((exact + semantic) * 1.0 / total, 4) as hit_rate
  from (select count(*) as total, count(*) filter (where cache_hit = 'exact') as exact, count(*) filter (where cache_hit = 'semantic') as semantic,
  count(*) filter (where coalesce(cache_hit, 'miss') = 'miss') as miss, round(avg(response_ms), 4) as average_ms, cast(coalesce(sum(openai_total_tokens), 0) as bigint) as tokens
  from ev where type = 'chat_question' and ts >= {T} - interval 48 hours) t""",
    "ev",
)
HOURLY = f"select strftime(date_trunc('hour', ts), {STAMP}) as hour, count(*) as questions, count(*) filter (where coalesce(cache_hit, 'miss') <> 'miss') as hits from ev where type = 'chat_question' group by 1"
query("cache_hourly", lambda v: usage.cache_hourly(v.ev), HOURLY, "ev")
query("event_by_id", lambda v: usage.by_id(v.ev, "id", 77).select("id", "type", "sid", "location"), "select id, type, sid, location from ev where id = 77", "ev")
query(
    "cost_rollup",
    lambda v: usage.cost_rollup(v.ev, v.spark.createDataFrame([("mini", 0.6), ("premium", 10.0)], "model_used string, per_1k double")),
    """with p as (select * from (values ('mini', 0.6::double), ('premium', 10.0::double)) t(model_used, per_1k)),
c as (select ev.model_used, count(*) as n, avg(coalesce(openai_total_tokens, 0) * per_1k / 1000) as cost from ev
  join p on p.model_used = ev.model_used where type = 'chat_question' group by 1)
select model_used, n, round(cost, 6) as cost, round(n * 1.0 / sum(n) over (), 6) as share, round(sum(n * cost) over () / sum(n) over (), 6) as mean_cost from c""",
    "ev",
)
