"""Queries on the topic and entity graph, on answer reuse, and on table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalake.functions.text import query_hash
from qalake.operators import graph as G
from qalake.operators import maintenance as M
from qalake.operators import retrieval as R
from qalake.operators import reuse as U
from qalake.session import stored
from qalake.sources.tables import AS_OF

from .catalog import query

TOPICS = [
    (1, "with-that", ("with", "that")),
    (2, "und-des", ("und", "des")),
    (3, "para-pour", ("para", "pour")),
    (4, "with-und", ("with", "und")),
    (5, "that-para", ("that", "para")),
    (6, "des-pour", ("des", "pour")),
]
RULES = [("wh", "(wh[a-z]{3,6})", "word {}"), ("tion", "([a-z]{2,4}tion)", "noun {}"), ("wh", "(who[a-z]{2})", "who {}")]
STAMP = f"timestamp '{AS_OF}'"


def texts(v):
    return v.qa.select("qid", F.concat_ws(" ", "question", "answer").alias("text"))


def originals(v):
    return v.qa.select(F.col("qid").alias("id"), (F.col("qid") * 37 % 1009).alias("ts"))


def topic_edges(v):
    return G.classify_topics(texts(v), TOPICS)


def entity_edges(v):
    return G.extract_entities(texts(v), RULES).select("qid", F.concat_ws(":", "type", "value").alias("entity_id"))


TX = "select qid, question || ' ' || answer as text from qa"
SCORED = f"""select qid, id as topic_id, round((cast(contains(lower(text), kw1) as int) + cast(contains(lower(text), kw2) as int)) / 2.0, 4) as score from ({TX}) t, topics
  where contains(lower(text), kw1) or contains(lower(text), kw2)"""
ENTITIES = "select qid, type, value, arg_min(name, rule) as name from (" + " union all ".join(
    f"select qid, '{k}' as type, upper(m) as value, {i} as rule, replace('{n}', '{{}}', upper(m)) as name from (select qid, "
    f"unnest(regexp_extract_all(text, '{p}', 1)) as m from ({TX}) t) e{i}" for i, (
        k,
        p,
        n,
    ) in enumerate(RULES)
) + ") x group by 1, 2, 3"
query("classify_topics", topic_edges, f"select qid, topic_id from ({SCORED}) s", "qa topics")
query("score_topics", lambda v: G.score_topics(texts(v), TOPICS), SCORED, "qa topics")
query("extract_entities", lambda v: G.extract_entities(texts(v), RULES), ENTITIES, "qa")


def known(v):
    return v.spark.createDataFrame([("wh", "WHTHE", "known"), ("wh", "WHANTH", None), ("zz", "ZZZ", "old")], "type string, value string, name string")


query(
    "upsert_entities",
    lambda v: G.upsert_entities(known(v), G.extract_entities(texts(v), RULES)).select("type", "value", "name"),
    f"""with k as (select *
  from (values ('wh', 'WHTHE', 'known'), ('wh', 'WHANTH', null), ('zz', 'ZZZ', 'old')) t(type, value, old)), n as (select type, value, min(name) as name
  from ({ENTITIES}) e group by 1, 2)
select coalesce(k.type, n.type) as type, coalesce(k.value, n.value) as value, coalesce(old, name) as name from k full join n on k.type = n.type and k.value = n.value""",
    "qa",
)
query(
    "link_topics",
    lambda v: G.link_topics(v.qa.filter("qid % 2 = 0").select("qid", F.lit(1).alias("topic_id"), F.lit(0.1).alias("confidence")), texts(v), TOPICS),
    f"""with n as ({SCORED}), o as (select qid, 1 as topic_id, 0.1::double as score from qa where qid % 2 = 0)
select qid, topic_id, cast(coalesce(n.score, o.score) as double) as confidence from o full join n using (qid, topic_id)""",
    "qa topics",
)
query(
    "link_entities",
    lambda v: G.link_entities(
        v.spark.createDataFrame([], "qid long, entity_id long, confidence double"),
        texts(v),
        RULES,
    ).groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 1).alias("confidence")),
    f"select qid, count(*) as n, round(cast(count(*) as double), 1) as confidence from ({ENTITIES}) e group by 1",
    "qa",
)
query(
    "link_sources",
    lambda v: G.link_sources(v.spark.createDataFrame([(100, "7", 0.1), (-1, "x", 0.2)], "qid long, source_id string, relevance_score double"), v.retrieved.select("qid", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("entry_id"), F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") + 1000).alias("id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "score")),
    """with n as (select qid, case doc_id % 3 when 0 then cast(doc_id as varchar)
  when 1 then cast(doc_id + 1000 as varchar) else 'u' || cast(doc_id as varchar) end as source_id, max(score) as s from retrieved group by 1, 2),
o as (select * from (values (100, '7', 0.1::double), (-1, 'x', 0.2::double)) t(qid, source_id, s))
select cast(coalesce(o.qid, n.qid) as bigint) as qid, coalesce(o.source_id, n.source_id) as source_id, cast(coalesce(n.s, o.s) as double) as relevance_score
  from o full join n on o.qid = n.qid and o.source_id = n.source_id""",
    "retrieved",
)
query(
    "link_new_answers",
    lambda v: G.link_new_answers(
        v.qa.select(F.col("qid").alias("id"), "question", "answer", F.when(F.col("qid") % 3 == 0, "miss").otherwise("exact").alias("cache_hit")),
        TOPICS,
        RULES,
    ),
    f"select qid, 'topic' as kind, cast(topic_id as varchar) as target from ({SCORED}) s where qid % 3 = 0 union all select qid, 'entity' as "
    f"kind, type || ':' || value as target from ({ENTITIES}) e where qid % 3 = 0",
    "qa topics",
)
ORIG = "select qid as id, qid * 37 % 1009 as ts from qa"
BY_TOPIC = f"""select qid, id, cast(row_number() over (partition by qid order by ts desc, id desc) as int) as rank from (
  select distinct a.qid, o.id, o.ts from (select qid, topic_id from ({SCORED}) s) a join (select qid, topic_id
    from ({SCORED}) s) b on a.topic_id = b.topic_id join ({ORIG}) o on o.id = b.qid where o.id <> a.qid) p qualify rank <= 5"""
EDGES = f"select qid, type || ':' || value as e from ({ENTITIES}) x"
BY_ENTITY = f"""select qid, id, matches, cast(row_number() over (partition by qid order by matches desc, ts desc, id desc) as int) as rank from (
  select a.qid, o.id, o.ts, count(distinct a.e) as matches from ({EDGES}) a join ({EDGES}) b on a.e = b.e join ({ORIG}) o on o.id = b.qid
    where o.id <> a.qid group by 1, 2, 3) p qualify rank <= 5"""
query("similar_by_topic", lambda v: G.similar_by_topic(v.qa, topic_edges(v), originals(v)), BY_TOPIC, "qa topics")
query("similar_by_entity", lambda v: G.similar_by_entity(v.qa, entity_edges(v), originals(v)), BY_ENTITY, "qa")
query(
    "similar_by_both",
    lambda v: G.similar_by_both(topic_edges(v), entity_edges(v), v.qa.select(F.col("qid").alias("id"), (F.col("qid") % 2 == 0).alias("verified")), 1, "tion:ERTION").select("id"),
    f"select qid as id from qa where qid % 2 = 0 and qid in (select qid from ({SCORED}) s where topic_id = 1) and qid in (select qid from ({EDGES}) e where e = 'tion:ERTION')",
    "qa topics",
)
ENHANCED = f"""select qid, id, cast(row_number() over (partition by qid order by verified desc, entity desc, i) as int) as rank, verified from (
  select *, row_number() over (partition by qid order by entity desc, old, id) as i, id % 11 = 0 as verified from (
    select qid, id, entity, rank as old from (select qid, id, 1 as entity, rank from ({BY_ENTITY}) e union all select qid, id, 0 as entity, rank
      from ({BY_TOPIC}) t) b qualify row_number() over (partition by qid, id order by entity desc, rank) = 1) o qualify i <= 5) f"""


def enhanced(v):
    reviews = v.qa.select(F.col("qid").alias("id"), (F.col("qid") % 11 == 0).alias("verified"))
    return G.find_enhanced(G.similar_by_entity(v.qa, entity_edges(v), originals(v)), G.similar_by_topic(v.qa, topic_edges(v), originals(v)), reviews)


query("find_enhanced", enhanced, ENHANCED, "qa topics")
query(
    "weighted_rank",
    lambda v: G.weighted_rank(
        v.retrieved.select("qid", "rank", "score", (F.col("qid") % 11 == 0).alias("verified"), (F.col("qid") % 13 == 0).alias("flagged"))
    ),
    "select qid, rank, score, qid % 11 = 0 as verified, qid % 13 = 0 as flagged, round(score * case when qid % 11 = 0 then 1.5::double else 1 "
    "end * case when qid % 13 = 0 then 0.5::double else 1 end, 6) as weighted from retrieved",
    "retrieved",
)
query(
    "mark_verified",
    lambda v: G.mark_verified(
        v.ev.select("id", "verified", "flagged"),
        v.ev.filter("id % 9 = 0").select(
            "id",
            F.lit(True).alias("verified"),
            (F.col("id") % 2 == 0).alias("flagged"),
            F.lit("checked").alias("flag_reason"),
        ),
    ),
    "select id, case when id % 9 = 0 then true else coalesce(verified, false) end as verified, case when id % 9 = 0 then id % 2 = 0 else "
    "coalesce(flagged, false) end as flagged, case when id % 9 = 0 then 'checked' end as flag_reason from ev",
    "ev",
)
query(
    "topic_stats",
    lambda v: G.topic_stats(v.spark.createDataFrame([(i, s) for i, s, _ in TOPICS] + [(7, "none")], "id int, slug string"), topic_edges(v)),
    f"select t.id, slug, coalesce(n, 0) as questions, cast(coalesce(sum(n) over (), 0) as bigint) as edges from (select id, slug from topics "
    f"union all select 7, 'none') t left join (select topic_id, count(*) as n from ({SCORED}) s group by 1) c on c.topic_id = t.id",
    "qa topics",
)


# -- reuse ------------------------------------------------------------------------------------------------------------


def asked(v):
    return v.ev.filter("type = 'chat_question'").select(F.col("id").alias("qid"), "ts", "question")


def answers(v):
    """Each question's answer, stored a second after it was asked."""
    rows = v.ev.filter("type = 'chat_question'").select(
        F.col("id").alias("answer_id"),
        query_hash(F.col("question")).alias("query_hash"),
        (F.col("ts") + F.expr("interval 1 second")).alias("created_at"),
        "k",
    )
    return rows.withColumn("expires_at", F.col("created_at") + F.expr("interval 6 hours")).withColumn("hit_count", F.col("k") % 4).withColumn("last_hit_at", F.lit(None).cast("timestamp"))


ASKED = "select id as qid, ts, question from ev where type = 'chat_question'"
ANSWERS = "select id as answer_id, question, ts + interval 1 second as created_at, ts + interval 1 second + interval 6 hours as expires_at, k % 4 as hit_count from ev where type = 'chat_question'"
FMT = "'%Y-%m-%d %H:%M:%S'"
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
query(
    "exact_reuse",
    lambda v: U.exact_reuse(asked(v), answers(v)),
    f"select qid, answer_id from ({ASKED}) q join ({ANSWERS}) a on a.question = q.question and created_at <= ts and ts < expires_at qualify "
    f"row_number() over (partition by qid order by created_at desc, answer_id desc) = 1",
    "ev",
)
ASK_TOPICS = [(1, "with-that", ("with", "that")), (2, "und-des", ("und", "des")), (3, "para-pour", ("para", "pour"))]


def kept_for(v, hours):
    """All asked questions' answers, stored a second later, for so many hours."""
    at = F.col("ts") + F.expr("interval 1 second")
    return v.asks.select(F.col("qid").alias("answer_id"), query_hash(F.col("question")).alias("query_hash"), "embedding", at.alias("created_at"), (at + F.expr(f"interval {hours} hours")).alias("expires_at"))


def ask_topics(v):
    return G.classify_topics(v.asks.select("qid", "text"), ASK_TOPICS).select("qid", "topic_id")


def semantic_hits(v, asked_ones):
    """Nearest answer of memory, which keeps six hours, if it shares a topic with the question."""
    hits = U.semantic_reuse(asked_ones, kept_for(v, 6), 0.25)
    return U.require_topic_overlap(hits, ask_topics(v), ask_topics(v).withColumnRenamed("qid", "answer_id"))


def resolved(v):
    """The cascade: the same words in memory, near vectors in memory, the same words in the table (a day), the same topic in the table."""
    q = v.asks.filter("qid % 20 = 0")
    topics, table = ask_topics(v), kept_for(v, 24)
    exact = stored(U.exact_reuse(q, kept_for(v, 6)), "exact")
    semantic = stored(semantic_hits(v, U.unanswered(q, exact)), "semantic")
    database = stored(U.exact_reuse(U.unanswered(q, exact, semantic), table, 24), "database")
    left = U.unanswered(q, exact, semantic, database).select("qid", "ts").join(topics, "qid")
    topic = U.topic_answers(left, table.join(topics.withColumnRenamed("qid", "answer_id"), "answer_id"))
    return U.resolve_reuse(q, [("exact", exact), ("semantic", semantic), ("database", database), ("topic", topic)])


_KW = ", ".join(f"({i}, '{a}', '{b}')" for i, _, (a, b) in ASK_TOPICS)
VALID = "a.ts + interval 1 second <= q.ts and q.ts < a.ts + interval 1 second + interval {} hours"
ALL_NEAR = f"""select q.qid, a.qid as answer_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(a.embedding as double[])), 6) as similarity
  from asks q join asks a on {VALID.format(6)} where similarity >= 0.25 qualify row_number() over (partition by q.qid order by similarity desc, a.qid) = 1"""
NEAR = ALL_NEAR.replace("where ", "where q.qid % 20 = 0 and ")
LATEST = "select q.qid, a.qid as answer_id from asks q join asks a on a.question = q.question and {} where q.qid % 20 = 0 qualify row_number() over (partition by q.qid order by a.ts desc, a.qid desc) = 1"
OVERLAP = f"""own as (select qid, id as topic_id from asks, (values {_KW}) t(id, a, b) where contains(lower(text), a) or contains(lower(text), b)),
near as ({{}}),
overlap as (select * from near n where exists (select 1 from own x join own y on x.topic_id = y.topic_id where x.qid = n.qid and y.qid = n.answer_id) or n.qid not in (select qid from own))"""
TIERS = f"""{OVERLAP.format(NEAR)},
words as ({LATEST.format(VALID.format(6))}), kept as ({LATEST.format(VALID.format(24))}),
same_topic as (select q.qid, a.qid as answer_id from asks q join own x on x.qid = q.qid join own y on y.topic_id = x.topic_id join asks a on a.qid = y.qid and {VALID.format(24)}
  where q.qid % 20 = 0 qualify row_number() over (partition by q.qid order by a.ts desc, a.qid desc) = 1)"""
RESOLVED = f"""{TIERS}, resolved as (select q.qid, case when w.qid is not null then 'exact' when o.qid is not null then 'semantic' when k.qid is not null then 'database' when s.qid is not null then 'topic' else 'miss' end as cache_type,
  coalesce(w.answer_id, o.answer_id, k.answer_id, s.answer_id) as answer_id, cast(case when w.qid is not null then 1.0 when o.qid is not null then o.similarity when k.qid is not null then 1.0 end as double) as similarity
  from asks q left join words w using (qid) left join overlap o using (qid) left join kept k using (qid) left join same_topic s using (qid) where q.qid % 20 = 0)"""
query("semantic_reuse", lambda v: U.semantic_reuse(v.asks.filter("qid % 20 = 0"), kept_for(v, 6), 0.25), NEAR, "asks")
query("topic_overlap", lambda v: semantic_hits(v, v.asks), f"with {OVERLAP.format(ALL_NEAR)} select qid, answer_id, similarity from overlap", "asks")
query("topic_reuse", lambda v: U.topic_reuse(enhanced(v)), f"select qid, id as answer_id from ({ENHANCED}) e where rank = 1", "qa topics")
query("resolve_reuse", resolved, f"with {RESOLVED} select * from resolved", "asks")
query(
    "reuse_metrics",
    lambda v: U.reuse_metrics(resolved(v)),
    f"""with {RESOLVED} select *, round((total - misses) * 1.0 / total, 4) as hit_rate
  from (select count(*) as total, count(*) filter (where cache_type = 'exact') as exact, count(*) filter (where cache_type = 'semantic') as semantic,
  count(*) filter (where cache_type = 'database') as stored, count(*) filter (where cache_type = 'topic') as topic, count(*) filter (where cache_type = 'miss') as misses from resolved r) t""",
    "asks",
)
query(
    "put_answers",
    lambda v: U.put_answers(
        v.ev.groupBy(query_hash(F.col("question")).alias("query_hash")).agg(F.max(F.when(F.col("k") < 60, F.col("id"))).cast("string").alias("response"), F.min("ts").alias("created_at")).withColumn("expires_at", F.col("created_at")).withColumn("hit_count", F.lit(3)).filter("response is not null"),
        v.ev.filter("k >= 40").groupBy(query_hash(F.col("question")).alias("query_hash")).agg(F.lit("new").alias("response"), F.max("ts").alias("created_at")),
    ).select("query_hash", "response", "hit_count", stamp("created_at"), stamp("expires_at")),
    f"""with g as (select substr(sha256(question), 1, 32) as query_hash, k, max(id) as id, min(ts) as a, max(ts) as b from ev group by 1, 2)
select query_hash, case when k >= 40 then 'new' else cast(id as varchar) end as response, case when k >= 40 then 0 else 3
  end as hit_count, strftime(case when k >= 40 then b else a end, {FMT}) as created_at,
  strftime(case when k >= 40 then b + interval 24 hours else a end, {FMT}) as expires_at from g""",
    "ev",
)
query(
    "hit_counters",
    lambda v: U.hit_counters(answers(v), U.exact_reuse(asked(v), answers(v)).join(asked(v), "qid").select("answer_id", "ts")).select("answer_id", "hit_count", stamp("last_hit_at")),
    f"""with h as (select answer_id, ts from ({ASKED}) q join ({ANSWERS}) a on a.question = q.question and created_at <= ts and ts < expires_at
  qualify row_number() over (partition by qid order by created_at desc, answer_id desc) = 1),
n as (select answer_id, count(*) as more, max(ts) as last from h group by 1)
select a.answer_id, hit_count + coalesce(more, 0) as hit_count, strftime(last, {FMT}) as last_hit_at from ({ANSWERS}) a left join n on n.answer_id = a.answer_id""",
    "ev",
)
MOMENT = "2024-01-20 00:00:00"
WARM = f"select answer_id, hit_count from ({ANSWERS}) a where expires_at > timestamp '{MOMENT}' order by hit_count desc, created_at desc, answer_id limit"
query("warm_set", lambda v: U.warm_set(answers(v), MOMENT, 50).select("answer_id", "hit_count"), f"{WARM} 50", "ev")
query("evict_answers", lambda v: U.evict_answers(answers(v), MOMENT, 300).select("answer_id", "hit_count"), f"{WARM} 300", "ev")
query(
    "invalidate_on_change",
    lambda v: U.invalidate_on_change(answers(v), R.corpus_hash(v.documents, "doc_id", "text"), R.corpus_hash(v.documents, "doc_id", "text")).select(F.lit("same").alias("corpus"), "answer_id").unionByName(
        U.invalidate_on_change(
            answers(v),
            R.corpus_hash(v.documents, "doc_id", "text"),
            R.corpus_hash(v.documents.filter("doc_id <> 5"), "doc_id", "text"),
        ).select(F.lit("changed").alias("corpus"), "answer_id")
    ),
    f"select 'same' as corpus, answer_id from ({ANSWERS}) a",
    "ev",
)
TTL = """with recursive q as (select question as key, id as qid, epoch_us(ts) as t, row_number() over (partition by question order by ts, id) as n
  from ev where type = 'chat_question'),
w as (select key, n, qid, t as open, true as kept from q where n = 1 union all select q.key, q.n, q.qid, case
  when q.t >= w.open + 86400000000 then q.t else w.open end, q.t >= w.open + 86400000000 from w join q on q.key = w.key and q.n = w.n + 1)
select key, qid, kept from w"""
query("ttl_dedup", lambda v: U.ttl_dedup(v.ev.filter("type = 'chat_question'").select(F.col("question").alias("key"), F.col("id").alias("qid"), "ts")), TTL, "ev")

# -- upkeep -----------------------------------------------------------------------------------------------------------

query(
    "snapshot_upsert",
    lambda v: M.snapshot_upsert(v.customer.select("c_custkey", "c_name", "c_acctbal"), v.customer.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 1).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "renamed").alias("c_name"), F.lit(0.0).alias("c_acctbal")), ["c_custkey"], ["c_name"]),
    """with n as (select c_custkey + 1 as c_custkey, case when c_custkey % 2 = 0 then 'renamed' end as c_name, 0.0::double as c_acctbal from customer where c_custkey % 3 = 0)
select coalesce(n.c_custkey, o.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, case
  when n.c_custkey is not null then n.c_acctbal else o.c_acctbal end as c_acctbal from customer o full join n on n.c_custkey = o.c_custkey""",
)
query(
    "delete_rows",
    lambda v: M.delete_rows(v.ev, ids=v.ev.filter("id % 10 = 0").select("id"), prefix="77", before="2024-01-03 00:00:00", only=F.col("type") == "chat_question").select("id", "type"),
    "select id, type from ev where type <> 'chat_question' or not (id % 10 = 0 or cast(id as varchar) like '77%' or ts < timestamp '2024-01-03 00:00:00')",
    "ev",
)


def posted(v):
    path = F.when(F.col("k") % 25 == 0, F.repeat(F.lit("x"), F.lit(3000))).otherwise(F.col("path"))
    return v.ev.select("id", F.when(F.col("k") % 31 != 0, F.col("type")).alias("type"), path.alias("path"), F.when(F.col("k") % 3 == 0, '{"a": 1}').when(F.col("k") % 3 == 1, "plain").alias("meta"))


query(
    "ingest_events",
    lambda v: M.ingest_events(posted(v)).select("id", "reason", "meta"),
    """select id, case when k % 31 = 0 or type not in ('pageview', 'chat_question') then 'bad_type' when k % 25 = 0 then 'path_too_long' end as reason,
  case k % 3 when 0 then '{"a": 1}' when 1 then '{"text":"plain"}' end as meta from ev""",
    "ev",
)


def responses(v):
    usage = F.when(F.col("openai_total_tokens").isNotNull(), F.struct(F.col("openai_total_tokens").alias("total_tokens"), F.when(F.col("k") % 2 == 0, F.lit("u")).alias("provider")))
    return v.ev.filter("type = 'chat_question'").select(
        "id",
        "question",
        F.when(F.col("success") == 1, F.repeat(F.lit("a"), F.col("answer_chars"))).alias("answer"),
        "cache_hit",
        F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit(1), F.col("k") % 4).alias("sources"),
        usage.alias("usage"),
        F.struct(F.col("api_provider").alias("provider")).alias("perf"),
        F.struct(F.lit("m").alias("provider")).alias("model_info"),
    )


query(
    "build_chat_event",
    lambda v: M.build_chat_event(responses(v)).withColumn("hit", F.get_json_object("meta", "$.cache_hit")).withColumn("chunks", F.get_json_object("meta", "$.chunks_retrieved").cast("int")).drop("meta"),
    """select id, 'chat_question' as type, coalesce(api_provider, case when k % 2 = 0 and openai_total_tokens is not null then 'u'
  end, 'm') as api_provider, openai_total_tokens, cast(length(question) as int) as prompt_chars,
  case when success = 1 then answer_chars end as answer_chars, success, coalesce(cache_hit, 'miss') as hit, least(k % 4, 3) as chunks from ev where type = 'chat_question'""",
    "ev",
)
WANTED = T.StructType([T.StructField("id", T.LongType()), T.StructField("country", T.StringType()), T.StructField("lat", T.DoubleType())])
query("evolve_schema", lambda v: M.evolve_schema(v.ev.select("id", "type"), WANTED), "select id, cast(null as varchar) as country, cast(null as double) as lat, type from ev", "ev")
query(
    "migrate_kv_stats",
    lambda v: M.migrate_kv(
        v.customer.agg(F.count("*").alias("customers"), F.collect_set("c_mktsegment").alias("segments"), F.lit(1).alias("ask_count")),
        v.kv,
    ),
    """select 'customers' as key, cast(count(*) as varchar) as value from customer union all
  select 'segments' as key, '["' || string_agg(distinct c_mktsegment, '","' order by c_mktsegment) || '"]' as value from customer""",
)
query(
    "export_question",
    lambda v: M.export_row(v.ev.select("id", "type", "question"), "id", 5),
    """select '{"id":5,"type":"' || type || '","question":"' || question || '"}' as record from ev where id = 5""",
    "ev",
)
query(
    "merge_corpus",
    lambda v: M.merge_counts(
        v.documents.select(F.col("doc_id").alias("entry_id")),
        v.documents.filter("doc_id % 4 = 0").select((F.col("doc_id") * 2).alias("entry_id")),
        "entry_id",
    ),
    "with n as (select doc_id * 2 as i from documents where doc_id % 4 = 0) select (select count(*) from n where i not in (select doc_id from "
    "documents)) as inserted, (select count(*) from n where i in (select doc_id from documents)) as replaced, (select count(*) from documents "
    "where doc_id not in (select i from n)) as kept",
)
