"""Queries on answer verification, evaluation, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qalake.functions.times import micros
from qalake.operators import evaluate as E
from qalake.operators import graph as G
from qalake.operators import retrieval as R
from qalake.operators import verify as V
from qalake.session import shared_folder
from qalake.sources import files, store
from qalake.sources.tables import K_SPARK, VIEWS
from qalake.streaming import flags, guard, live, sinks

from .catalog import query
from .knowledge import RULES, TOPICS, TTL
from .reports import HOURLY, STAMP
from .retrieve import corpus, knn, questions

TAIL = "\nSources:\n1. [A](https://kb/a)\n2) [B](https://kb/b)\n9. [Z](https://kb/z)"
SQL_TAIL = "chr(10) || 'Sources:' || chr(10) || '1. [A](https://kb/a)' || chr(10) || '2) [B](https://kb/b)' || chr(10) || '9. [Z](https://kb/z)'"
answers = lambda v: v.cited.select("qid", F.concat("answer", F.when(F.col("qid") % 7 == 0, F.lit(" Wait 30 days.")).otherwise(""), F.when(F.col("qid") % 3 == 0, F.lit(TAIL)).otherwise("")).alias("answer"))
ANSWERS = f"select qid, answer || case when qid % 7 = 0 then ' Wait 30 days.' else '' end || case when qid % 3 = 0 then {SQL_TAIL} else '' end as answer from cited"
chunks = lambda v: v.retrieved.join(v.documents, "doc_id").select(
    "qid",
    "rank",
    F.concat("text", F.lit(" Pays 30% after 2 years. It costs $30.")).alias("text"),
    F.when(F.col("rank") == 1, "https://kb/a").otherwise("https://kb/c").alias("url"),
)
CHUNKS = "select qid, rank, text || ' Pays 30% after 2 years. It costs $30.' as text, case when rank = 1 then 'https://kb/a' else 'https://kb/c' end as url from retrieved join documents using (doc_id)"
CITED = r"""select qid, cast(i - 1 as int) as pos, cast(n[i] as int) as number, trim(c[i]) as claim from (select qid, c, n, unnest(range(1, len(c) + 1)) as i from (
  select qid, regexp_extract_all(answer, '([^.!?\n]{10,100})\s*\[(\d+)\]', 1) as c, regexp_extract_all(answer, '([^.!?\n]{10,100})\s*\[(\d+)\]', 2) as n from (""" + ANSWERS + ") a) b) d"
query("extract_citations", lambda v: V.extract_citations(answers(v)), CITED, "cited")
REFS = f"select qid, number, title, url from ({ANSWERS}) a cross join (values (1, 'A', 'https://kb/a'), (2, 'B', 'https://kb/b'), (9, 'Z', 'https://kb/z')) t(number, title, url) where qid % 3 = 0"
query("extract_source_refs", lambda v: V.extract_source_refs(answers(v)), REFS, "cited")
STOPS = "(" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + ")"
SUPPORT = rf"""case when len(w) = 0 then 0.5::double when len(n) > 0 then (len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::double + 2 * len(list_filter(n, lambda x: contains(text, x))) / len(n)::double) / 3
  else len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::double end"""
WORDS = rf"list_distinct(list_filter(regexp_extract_all(lower(claim), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2 and x not in {STOPS})) as w, list_distinct(regexp_extract_all(claim, '\d+%?')) as n"
CHECKED = f"""select qid, pos, number, round(s, 4) as confidence, coalesce(there, false) and s >= 0.3 as verified,
  concat_ws(',', case when cited_url is null then 'not_in_sources' end, case when there is null then 'no_chunk' end, case
    when there and s < 0.3 then 'low_support' end, case when cited_url <> chunk_url then 'url_mismatch' end) as issues
from (select c.qid, pos, c.number, r.url as cited_url, k.url as chunk_url, case when k.text is not null then true end as there, case
  when k.text is null then 0.0::double else {SUPPORT} end as s
  from (select *, {WORDS} from ({CITED}) x) c left join ({REFS}) r on r.qid = c.qid and r.number = c.number left join ({CHUNKS}) k on k.qid = c.qid and k.rank = c.number) y"""
query("claim_support", lambda v: V.check_citations(answers(v), chunks(v)), CHECKED, "cited retrieved")
VERIFIED = f"""select qid, total, verified, beyond_chunks, total - verified as suspicious, score, total - verified > total * 0.3 as many_suspicious, score < 0.7 as review from (
  select a.qid, count(pos) as total, count(*) filter (where verified) as verified, coalesce(max(number), 0) > 3 as beyond_chunks, case
    when count(pos) > 0 then round(count(*) filter (where verified) / count(pos)::double, 4) else 1.0::double end as score
  from ({ANSWERS}) a left join ({CHECKED}) c on c.qid = a.qid group by 1) t"""
query("verify_citations", lambda v: V.verify_citations(answers(v), chunks(v)), VERIFIED, "cited retrieved")
query(
    "verification_summary",
    lambda v: V.verification_summary(V.verify_citations(answers(v), chunks(v))),
    f"select count(*) as answers, cast(sum(total) as bigint) as citations, cast(sum(verified) as bigint) as verified, cast(sum(suspicious) as "
    f"bigint) as suspicious, count(*) filter (where review) as reviews, round(avg(score), 4) as mean_score from ({VERIFIED}) v",
    "cited retrieved",
)
FIG = r"list_distinct(regexp_extract_all(lower({0}), '\b(\d+)(?:%|\s*percent)', 1)) as p, list_distinct(regexp_extract_all({0}, '\b(7\d{{3}})\b', 1)) as c, list_distinct(regexp_extract_all({0}, '(?i)\b(\d+)\s*(?:days?|months?|years?)\b', 1)) as d, list_distinct(regexp_extract_all({0}, '\$\s*(\d+(?:,\d{{3}})*(?:\.\d{{2}})?)', 1)) as m"
LESS = "list_filter(a.{0}, lambda x: not list_contains(k.{0}, x))"
LIST = "array_to_string(list_sort({0}), ',')"
KINDS = ("p", "c", "d", "m")
NUMBERS = f"""select qid, percents, codes, specifics, percents = '' and codes = '' and specifics = '' as is_clean
  from (select a.qid, {LIST.format(LESS.format('p'))} as percents, {LIST.format(LESS.format('c'))} as codes, {LIST.format(f"list_concat({LESS.format('d')}, {LESS.format('m')})")} as specifics
  from (select qid, {FIG.format('answer')} from ({ANSWERS}) z) a join (select qid, {', '.join(f'flatten(list({c})) as {c}' for c in KINDS)}
    from (select qid, {FIG.format('text')} from ({CHUNKS}) y) x group by 1) k on k.qid = a.qid) t"""
query("verify_numbers", lambda v: V.verify_numbers(answers(v), chunks(v)), NUMBERS, "cited retrieved")
CLEAN = f"select qid, replace(replace(replace(answer, chr(10) || '9. [Z](https://kb/z)', ''), '[4]', ''), '[5]', '') as answer, length(answer) as before from ({ANSWERS}) a"
query("clean_citations", lambda v: answers(v).select("qid", F.md5(V.clean_citations(F.col("answer"), F.lit(3))).alias("digest")), f"select qid, md5(answer) as digest from ({CLEAN}) c", "cited")
query(
    "sanitize_answers",
    lambda v: V.sanitize_answers(answers(v), chunks(v)).withColumn("answer", F.md5("answer")),
    f"select qid, md5(t) as answer, cast(before as int) as before, cast(length(t) as int) as after, is_clean from (select c.qid, before, "
    f"is_clean, case when is_clean then '' else '{V.WARNING}' end || answer as t from ({CLEAN}) c join ({NUMBERS}) n on n.qid = c.qid) x",
    "cited retrieved",
)
# the case: questions of every twelfth conversation have found nothing
query(
    "confidence_gate",
    lambda v: V.confidence_gate(R.retrieval_quality(v.qa, v.retrieved.filter("conv_id % 12 <> 11"))),
    "select qa.qid, max(score) as best, case when max(score) is null then 'no_context' when max(score) < 0.45 then 'refuse' when max(score) < "
    "0.5 then 'warn' when max(score) < 0.55 then 'flag' else 'accept' end as decision from qa left join (select * from retrieved where conv_id % "
    "12 <> 11) r on r.qid = qa.qid group by 1",
    "qa retrieved",
)
query(
    "score_bands",
    lambda v: V.score_bands(v.retrieved),
    "select case when score < 0.45 then 'refuse' when score < 0.5 then 'warn' when score < 0.55 then 'flag' else 'accept' end as band, count(*) "
    "as n, round(avg(score), 4) as mean from retrieved group by 1",
    "retrieved",
)

# -- evaluation -------------------------------------------------------------------------------------------------------

results = lambda v: v.labels.join(v.documents, "doc_id").select(
    F.col("doc_id").alias("number"),
    F.col("source").alias("category"),
    (F.col("quality") == 1).alias("success"),
    F.when(F.col("toxic") == 0, F.col("doc_id") % 100 / 100).alias("confidence"),
)
RESULTS = "select doc_id as number, source as category, quality = 1 as success, case when toxic = 0 then doc_id % 100 / 100.0::double end as confidence from labels join documents using (doc_id)"
query(
    "eval_by_category",
    lambda v: E.eval_by_category(results(v)),
    f"select category, count(*) as total, count(*) filter (where success) as successes, round(count(*) filter (where success) / count(*)::double, "
    f"4) as rate from ({RESULTS}) r group by rollup (category)",
)
query(
    "eval_confidence",
    lambda v: E.eval_confidence(results(v)),
    f"select *, case when mean >= 0.6 then 'strong' when mean >= 0.5 then 'moderate' else 'weak' end as tier from (select category, count(*) as "
    f"n, round(avg(confidence), 4) as mean, count(*) filter (where confidence < 0.5) as low, count(*) filter (where confidence is null) as "
    f"no_info from ({RESULTS}) r group by 1) t",
)
query(
    "eval_score_dist",
    lambda v: E.eval_score_dist(results(v)),
    f"select band, n, round(100.0::double * n / sum(n) over (), 4) as percent from (select case when confidence is null then 'none' when "
    f"confidence >= 0.7 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as band, count(*) as n from ({RESULTS}) r group by 1) t",
)
query(
    "merge_runs",
    lambda v: E.merge_runs(results(v), results(v).withColumn("success", ~F.col("success")), 50).select("number", "success"),
    f"select number, case when number < 50 then success else not success end as success from ({RESULTS}) r",
)
query(
    "latency_stats",
    lambda v: E.latency_stats(v.ev, ["type"], "response_ms"),
    """with l as (select type, response_ms::double as v, row_number() over (partition by type
  order by response_ms) - 1 as i, count(*) over (partition by type) as n from ev where response_ms is not null)
select type, count(*) as n, round(avg(v), 4) as mean, round(quantile_cont(v, 0.5), 4) as median, round(stddev_samp(v), 4) as std, round(min(v), 4) as min, round(max(v), 4) as max, round(max(v) filter (where i = floor(n * 0.95::double)), 4) as p95, round(max(v) filter (where i = floor(n * 0.99::double)), 4) as p99
  from l group by 1""",
    "ev",
)
query(
    "throughput",
    lambda v: E.throughput(v.ev, ["type"], "ts", "ts"),
    "select type, count(*) as n, round(count(*) * 1e6::double / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) as per_second from ev group by 1",
    "ev",
)
query(
    "eval_expectation",
    lambda v: E.eval_expectation(R.retrieval_probe(questions(v), corpus(v), 5, 0.2, skip_self=True), 3),
    f"""with p as (select qid, rank, q.label = c.label as hit from ({knn(5, 0.2)}) f join embeddings q on q.vec_id = qid join embeddings c on c.vec_id = id),
g as (select qid, max(case when rank = 1 then cast(hit as int) end) as top, min(case when hit then rank end) as first_at from p group by 1)
select count(*) as questions, round(avg(coalesce(top, 0)), 4) as top_rate, round(avg(cast(coalesce(first_at, 1000000000) <= 3 as int)), 4) as hit_rate, round(avg(coalesce(1.0::double / first_at, 0)), 4) as mrr
  from g""",
)

# -- files ------------------------------------------------------------------------------------------------------------


def folder(v, name):
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def corpus_files(v):
    """The chunks as JSON arrays, some hundreds in each file, with broken and repeated records."""
    path = folder(v, "corpus")
    record = F.struct(
        F.when(F.col("entry_id") % 50 != 7, F.col("entry_id").cast("string")).alias("entry_id"),
        "topic",
        "type",
        "url",
        F.when(F.col("entry_id") % 40 != 9, F.col("content")).alias("content"),
    )
    again = F.struct(F.col("entry_id").cast("string").alias("entry_id"), F.lit("again").alias("topic"), "type", "url", F.col("content"))
    rows = v.chunks.withColumn("file", F.floor(F.col("entry_id") / 300)).select("file", "entry_id", record.alias("r"), F.when(F.col("entry_id") % 60 == 3, again).alias("a"))
    arrays = rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "r", "a"))), lambda x: F.struct(x["r"].alias("r"), x["a"].alias("a"))).alias("x"))
    both = F.concat(F.transform("x", lambda x: x["r"]), F.filter(F.transform("x", lambda x: x["a"]), lambda a: a.isNotNull()))
    arrays.select(F.to_json(both).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


query(
    "read_corpus",
    lambda v: files.read_corpus(v.spark, corpus_files(v)).select("entry_id", "topic", "type", F.md5("content").alias("digest")),
    "select cast(entry_id as varchar) as entry_id, case when entry_id % 60 = 3 then 'again' else topic end as topic, type, md5(content) as "
    "digest from chunks where entry_id % 60 = 3 or (entry_id % 50 <> 7 and entry_id % 40 <> 9 and content <> '')",
    "chunks",
)


def document_files(v):
    """One text file for each document, that bears its id."""
    path = folder(v, "markdown")
    files.write_documents(v.documents.select(F.col("doc_id").cast("string").alias("file"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content")), path)
    return path


def read_documents(v):
    path = document_files(v)
    return files.read_documents(
        v.spark,
        path,
        v.documents.select(F.col("doc_id").cast("string").alias("file"), "source"),
        101,
    ).select("file", "source", F.length(F.regexp_replace("content", r"\n$", "")).alias("chars"))


query("read_documents", read_documents, "select cast(doc_id as varchar) as file, source, cast(length(text) as int) as chars from documents where length(text) >= 100")

LINE = "case doc_id % 5 when 0 then '# comment' when 1 then '' when 2 then 'CAT-' || source || '-' || doc_id || ' | ' || left(split_part(text, chr(10), 1), 30) when 3 then '[SRC-' || doc_id || '] ' || left(split_part(text, chr(10), 1), 30) else 'no id at all' end"
lines = lambda v: v.documents.select(F.expr(LINE.replace("chr(10)", "char(10)").replace("|| doc_id", "|| cast(doc_id as string)")).alias("value"))


def question_files(v):
    path = folder(v, "questions")
    lines(v).write.text(path)
    return path


query(
    "read_questions",
    lambda v: files.read_questions(v.spark, question_files(v)),
    rf"""with l as (select trim({LINE}) as line from documents), p as (select case
  when contains(line, ' | ') then trim(regexp_extract(line, '^(.*?) \| (.*)$', 1)) else regexp_extract(line, '^\[([A-Z0-9-]+)\]\s*(.+)$', 1)
  end as id,
  case when contains(line, ' | ') then trim(regexp_extract(line, '^(.*?) \| (.*)$', 2)) else regexp_extract(line, '^\[([A-Z0-9-]+)\]\s*(.+)$', 2)
    end as question from l where line <> '' and not starts_with(line, '#'))
select id, regexp_replace(id, '-[^-]*$', '') as category, question from p where id <> ''""",
)


def written_corpus(v):
    path = folder(v, "written")
    files.write_corpus(v.chunks, path, "v1")
    return v.spark.read.parquet(path).select("entry_id", "corpus_version", "type", "topic", "url", F.md5("content").alias("digest"))


def written_results(v):
    path = folder(v, "results")
    files.write_results(results(v), path)
    rows = v.spark.read.schema("number long, category string, success boolean, confidence double")
    both = rows.option("header", True).csv(f"{path}/csv").withColumn("form", F.lit("csv")).unionByName(rows.json(f"{path}/json").withColumn("form", F.lit("json")))
    return both.select("form", "number", "category", "success", F.round("confidence", 4).alias("confidence"))


query("write_corpus", written_corpus, "select entry_id, 'v1' as corpus_version, type, topic, url, md5(content) as digest from chunks", "chunks")
query("write_results", written_results, f"select form, number, category, success, round(confidence, 4) as confidence from ({RESULTS}) r cross join (select unnest(['csv', 'json']) as form) f")

# -- streams ----------------------------------------------------------------------------------------------------------

asked = lambda ev: ev.filter("type = 'chat_question'").select(
    "id",
    "ip",
    "ts",
    F.expr("case when k % 10 = 0 then 'hi' else concat('prompt ', cast(k div 40 as string)) end").alias("prompt"),
)
requests = lambda v: asked(v.ev)
REQ = "select id, ip, ts, epoch_us(ts) as t, case when k % 10 = 0 then 'hi' else 'prompt ' || cast(k // 40 as varchar) end as prompt from ev where type = 'chat_question'"
EXEMPT = ["10.0.0.0", "60.1.0.1"]
#: The log in a two-hundredth of its time, each twenty minutes squeezed into thirty seconds and told by five: bursts and ties.
DENSER = "{u} div 1200000000 * 1200000000 + {u} % 1200000000 div 200000000 * 5000000"
dense = lambda rows: rows.withColumn("ts", F.timestamp_micros(F.expr(DENSER.format(u="(unix_micros(cast(ts as timestamp)) div 200)"))))
DENSE = f"select id, ip, cast({DENSER.format(u='(t // 200)').replace('div', '//')} as bigint) as t, prompt from ({REQ}) q"
FIRST_COME = "(partition by ip order by t, id)"
BURSTS = f"select *, coalesce(t - lag(t, 5) over {FIRST_COME} < 60000000, false) as burst from ({DENSE}) d"
SHORTS = f"select *, s = 1 and sum(s) over (partition by ip order by t, id rows unbounded preceding) > 3 as short from (select *, cast(length(trim(prompt)) < 5 as int) as s from ({DENSE}) d) e"
THIRD = f"select id, coalesce(t - lag(t, 2) over {FIRST_COME} < 600000000, false) as third from"
SAME = f"select *, coalesce(prompt = lag(prompt) over {FIRST_COME}, false) as same from"
REPEATS = f"select d.id, coalesce(third, false) as repeat from ({DENSE}) d left join ({THIRD} ({SAME} ({DENSE}) e) f where same) t on t.id = d.id"
ABUSE = f"""b as ({BURSTS}), s0 as (select *, cast(not burst and length(trim(prompt)) < 5 as int) as s from b),
s as (select *, s = 1 and sum(s) over (partition by ip order by t, id rows unbounded preceding) > 3 as short from s0),
r as ({THIRD} ({SAME} s where not burst and not short) p where same),
flagged as (select s.id, ip, t, case when ip in ('10.0.0.0', '60.1.0.1') then null when burst then 'burst' when short then 'short' when third then 'repeat' end as reason
  from s left join r on r.id = s.id)"""
#: Rows up to one in its last hour, without those of its own instant that come after it.
IN_HOUR = f"""select *, count(*) over (partition by ip order by t range between 3599999999 preceding and current row)
  - count(*) over (partition by ip, t) + row_number() over (partition by ip, t order by id) as n from ({DENSE}) d"""
query("burst_flags", lambda v: flags.burst_flags(dense(requests(v))).select("id", "burst"), f"select id, burst from ({BURSTS}) b", "ev")
query("short_prompt_flags", lambda v: flags.short_prompt_flags(dense(requests(v))).select("id", "short"), f"select id, short from ({SHORTS}) s", "ev")
query("repeat_flags", lambda v: flags.repeat_flags(dense(requests(v))).select("id", "repeat"), f"select id, repeat from ({REPEATS}) r", "ev")
query("abuse_reason", lambda v: flags.abuse_reason(dense(requests(v)), EXEMPT).select("id", "reason"), f"with {ABUSE} select id, reason from flagged", "ev")
query(
    "rate_tier",
    lambda v: flags.rate_tier(dense(requests(v))).select("id", "in_hour", "limit"),
    f"select id, n as in_hour, case when n > 20 then 5 when n > 10 then 15 else 250 end as limit from ({IN_HOUR}) e",
    "ev",
)
query("first_seen_visitors", lambda v: flags.first_seen(requests(v)).select("id", "is_new"), f"select id, row_number() over (partition by ip order by ts, id) = 1 as is_new from ({REQ}) r", "ev")
query(
    "session_activity",
    lambda v: flags.session_activity(v.ev),
    f"""with g as (select sid, ts, case when ts - lag(ts) over (partition by sid order by ts) < interval 30 minutes then 0 else 1 end as new from ev),
s as (select sid, ts, sum(new) over (partition by sid order by ts rows unbounded preceding) as s from g)
select sid, strftime(min(ts), {STAMP}) as started, strftime(max(ts) + interval 30 minutes, {STAMP}) as ended, count(*) as n from s group by sid, s""",
    "ev",
)


def ev_stream(v):
    """The event view over the stream of events."""
    stream = live.event_stream(v.spark, v.sf_dir)
    stream.createOrReplaceTempView("event_stream")
    return v.spark.sql(VIEWS["ev"].format(k=K_SPARK).replace("from events", "from event_stream"))


CLOSED = f"select h.* from ({HOURLY}) h where strptime(hour, {STAMP}) + interval 1 hour <= (select max(ts) - interval 10 minutes from ev where type = 'chat_question')"
query("stream_hourly", lambda v: live.drain(live.hourly(ev_stream(v).filter("type = 'chat_question'")), "hourly"), CLOSED, "ev")


def stream_guard(v):
    """Live flags of the request log, up to where its watermark ends."""
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    return live.drain(guard.request_guard(dense(asked(ev_stream(v))), EXEMPT), "guard").select("id", "reason", "in_hour", "limit")


query(
    "stream_request_flags",
    stream_guard,
    f"""with {ABUSE}, h as ({IN_HOUR}) select id, reason, n as in_hour, case when ip in ('10.0.0.0', '60.1.0.1') then 10000 when n > 20 then 5 when n > 10 then 15 else 250 end as limit
from flagged join h using (id, ip, t) where t <= (select max(t) - 600000000 from h)""",
    "ev",
)


def posted_stream(v):
    """Posted events, as they come in: some of an unknown type, some with overlong paths, some with plain text for JSON."""
    path = F.when(F.col("k") % 25 == 0, F.repeat(F.lit("x"), F.lit(3000))).otherwise(F.col("path"))
    meta = F.when(F.col("k") % 3 == 0, '{"a": 1}').when(F.col("k") % 3 == 1, "plain")
    return ev_stream(v).select("id", F.when(F.col("k") % 31 != 0, F.col("type")).alias("type"), path.alias("path"), meta.alias("meta"))


def stream_ingest(v):
    accepted, rejected = sinks.ingest_stream(posted_stream(v), folder(v, "ingest"))
    return accepted.select(F.lit("accepted").alias("sink"), "id", F.lit(None).cast("string").alias("reason"), "meta").unionByName(rejected.select(F.lit("rejected").alias("sink"), "id", "reason", "meta"))


query(
    "stream_ingest",
    stream_ingest,
    """select case when reason is null then 'accepted' else 'rejected' end as sink, * from (
  select id, case when k % 31 = 0 or type not in ('pageview', 'chat_question') then 'bad_type' when k % 25 = 0 then 'path_too_long' end as reason,
  case k % 3 when 0 then '{"a": 1}' when 1 then '{"text":"plain"}' end as meta from ev) e""",
    "ev",
)
query(
    "stream_rate_windows",
    lambda v: live.drain(sinks.rate_windows(dense(asked(ev_stream(v)))), "rates"),
    f"""with d as ({DENSE}), s as (select ip, (t // 60000000 - m) * 60000000 as s from d cross join (select unnest(range(60)) as m) x)
select ip, strftime(make_timestamp(s), {STAMP}) as started, count(*) as n from s where s + 3600000000 <= (select max(t) - 600000000 from d) group by ip, s having count(*) > 10""",
    "ev",
)
query("stream_first_seen", lambda v: live.drain(live.new_visitors(asked(ev_stream(v))).select("ip"), "visitors"), f"select distinct ip from ({REQ}) r", "ev")
SESSIONS = """g as (select sid, ts, case when ts - lag(ts) over (partition by sid order by ts) < interval 30 minutes then 0 else 1 end as new from ev),
s as (select sid, ts, sum(new) over (partition by sid order by ts rows unbounded preceding) as s from g),
sessions as (select sid, min(ts) as started, max(ts) + interval 30 minutes as ended, count(*) as n from s group by sid, s)"""
query(
    "stream_sessions",
    lambda v: live.drain(sinks.session_stream(ev_stream(v)), "sessions"),
    f"with {SESSIONS} select sid, strftime(started, {STAMP}) as started, strftime(ended, {STAMP}) as ended, n from sessions where ended <= (select max(ts) - interval 1 hour from ev)",
    "ev",
)


def event_store(v):
    path = folder(v, "store")
    store.append_events(v.ev.select("id", "ts", "type"), path)
    return path


def retained(v):
    """All events before one time are deleted, and the questions before a later one."""
    path = event_store(v)
    store.delete_before(v.spark, path, "2024-01-10 12:00:00")
    store.delete_before(v.spark, path, "2024-01-14 06:00:00", F.col("type") == "chat_question")
    return store.stored_events(v.spark, path).select("id", "day", "type")


query(
    "store_retention",
    retained,
    "select id, strftime(ts, '%Y-%m-%d') as day, type from ev where ts >= timestamp '2024-01-10 12:00:00' and (type <> 'chat_question' or ts >= timestamp '2024-01-14 06:00:00')",
    "ev",
)
query(
    "store_span",
    lambda v: store.stored_events(v.spark, event_store(v), "2024-01-20 06:30:00", "2024-01-22 00:00:00").select("id"),
    "select id from ev where ts >= timestamp '2024-01-20 06:30:00' and ts < timestamp '2024-01-22 00:00:00'",
    "ev",
)


def stream_traffic(v):
    """The stream's days; its approximate numbers of visitors are held against exact ones."""
    exact = v.ev.filter("type = 'pageview'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("sid").alias("exact"))
    days = live.drain(live.daily_traffic(ev_stream(v)), "traffic", mode="complete").join(exact, "day")
    return days.select("day", "pageviews", (F.abs(F.col("uniques") - F.col("exact")) <= 1 + 0.05 * F.col("exact")).alias("near"), F.col("exact").alias("visitors"))


query(
    "stream_traffic",
    stream_traffic,
    "select cast(cast(ts as date) as varchar) as day, count(*) as pageviews, true as near, count(distinct sid) as visitors from ev where type = 'pageview' group by 1",
    "ev",
)


def stream_ttl(v):
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    rows = ev_stream(v).filter("type = 'chat_question'").select(F.col("question").alias("key"), F.col("id").alias("qid"), "ts")
    return live.drain(live.ttl_dedup(rows), "ttl")


query("stream_ttl_dedup", stream_ttl, TTL, "ev")
query(
    "stream_link_answers",
    lambda v: live.drain(
        ev_stream(v).filter("type = 'chat_question'").withColumn("answer", F.expr("concat(question, ' with that und des')")),
        "links",
        lambda batch: G.link_new_answers(batch, TOPICS, RULES),
    ),
    "select id as qid, 'topic' as kind, cast(t as varchar) as target from ev cross join (select unnest([1, 2, 4, 5, 6]) as t) x where type = "
    "'chat_question' and cache_hit = 'miss' union all select id as qid, 'entity' as kind, 'tion:QUESTION' as target from ev where type = "
    "'chat_question' and cache_hit = 'miss'",
    "ev",
)
