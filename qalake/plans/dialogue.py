"""Queries on questions: normalisation, expansion, features, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalake.functions.text import normalize_query, query_hash
from qalake.operators import dictionary as D
from qalake.operators import questions as Q

from .catalog import query

LEADS = ["What is ", "How do ", "Compare ", "When ", "Can I ", "The rating of ", ""]
CODES = [("5000", "Alpha"), ("5001", "Beta"), ("5002", "Gamma")]
LONG = [(" with ", " with (alongside) "), (" und ", " und (and) "), (" pour ", " pour (for) "), (" para ", " para (for) ")]
TERMS = [("the", "this"), ("with", "along with"), ("that the", "what the"), ("und der", "and the"), ("para", "for")]
SIMPLE, HARD = ("what is", "how do", "can i"), ("compare", "versus", "when th")

NORMAL = r"trim(regexp_replace(regexp_replace(trim(lower(question)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
LED = "case conv_id % 7 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(LEADS)) + " end || question || case when conv_id % 4 = 0 then ' Why? How?' else '' end"
CODED = "case when conv_id % 5 = 0 then 'What is DC ' || cast(5000 + conv_id % 4 as varchar) || '?' when conv_id % 5 = 1 then 'DC ' || cast(5000 + conv_id % 4 as varchar) || ' ' || question else question end"


def led(qa):
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("conv_id") % 7 + 1).cast("int"))
    return qa.withColumn("question", F.concat(lead, "question", F.when(F.col("conv_id") % 4 == 0, " Why? How?").otherwise("")))


def coded(qa):
    code = (5000 + F.col("conv_id") % 4).cast("string")
    text = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("What is DC "), code, F.lit("?"))).when(
        F.col("conv_id") % 5 == 1,
        F.concat(F.lit("DC "), code, F.lit(" "), "question"),
    ).otherwise(F.col("question"))
    return qa.withColumn("question", text)


query("normalize_query", lambda v: v.qa.select("qid", normalize_query(F.col("question")).alias("normal")), f"select qid, {NORMAL} as normal from qa", "qa")
query("query_hash", lambda v: v.qa.select("qid", query_hash(F.col("question")).alias("hash")), f"select qid, substr(sha256({NORMAL}), 1, 32) as hash from qa", "qa")


NAME = "case code " + " ".join(f"when '{n}' then '{x}'" for n, x in CODES) + " end"
query(
    "expand_query",
    lambda v: coded(v.qa).select("qid", Q.expand_query(F.col("question"), CODES, LONG).alias("expanded")),
    f"""with q as (select qid, conv_id, {CODED} as question, cast(5000 + conv_id % 4 as varchar) as code from qa), n as (select *, {NAME} as name from q),
e as (select qid, case when conv_id % 5 = 0 then 'What is Diagnostic Code ' || code || case
  when name is null then '? What condition does it cover?' else '? ' || name || '. What are the rating criteria?' end
  when conv_id % 5 = 1 then 'Diagnostic Code ' || code || coalesce(' (' || name || ')', '') || substr(question, 8) else question end as t0 from n)
""" + "".join(f", e{i + 1} as (select qid, case when contains(t{i}, '{x}') then t{i} else regexp_replace(t{i}, '(?i){p}', '{x}', 'g') end as t{i + 1} from e{i if i else ''})" for i, (p, x) in enumerate(LONG)) + f" select qid, t{len(LONG)} as expanded from e{len(LONG)}",
    "qa",
)
#: A dictionary of a term from each document, after those of TERMS; terms repeat, contain each other, and are as long as others.
DICTIONARY = "select doc_id as pos, lower(split_part(text, ' ', 2)) as term, concat('<', cast(doc_id as string), '>') as expansion from documents where split_part(text, ' ', 2) <> ''" + "".join(
    f" union all select {i - len(TERMS)} as pos, '{t}' as term, '{e}' as expansion" for i, (t, e) in enumerate(TERMS)
)
query(
    "expand_terms",
    lambda v: D.expand_by_table(v.qa, v.spark.sql(DICTIONARY.replace("documents", "{documents}"), documents=v.documents)),
    f"""with d as ({DICTIONARY}), h as (select qid, term, expansion from qa join d on contains(lower(question), term)
  qualify row_number() over (partition by qid order by length(term) desc, pos) = 1)
select qa.qid, case when term is null then question else replace(lower(question), term, expansion) end as expanded from qa left join h on h.qid = qa.qid""",
    "qa",
)
PARTS = "select * from (values ('small', 'little tiny small'), ('ring', 'circle band ring'), ('steel', 'metal ring steel')) t(entry, expansion)"
query(
    "related_terms",
    lambda v: Q.related_terms(
        v.part.select(F.explode(F.split("p_name", " ")).alias("term")).distinct().unionByName(v.spark.createDataFrame([("tiny",), ("ring",), ("none",)], "term string")).distinct(),
        v.spark.createDataFrame([("small", "little tiny small"), ("ring", "circle band ring"), ("steel", "metal ring steel")], "entry string, expansion string"),
    ),
    f"""with d as ({PARTS}), w as (select entry, expansion, unnest(string_split(expansion, ' ')) as word from d),
t as (select distinct unnest(string_split(p_name, ' ')) as term from part union select 'tiny' union select 'ring' union select 'none')
select distinct term, word from t join w on lower(term) = entry union select distinct term, word from t join w on contains(expansion, lower(term))
  where lower(term) not in (select entry from d)""",
)
KIND = "case " + " ".join("when " + " or ".join(f"contains(lower(question), '{w}')" for w in words) + f" then '{name}'" for name, words in Q.QUESTION_TYPES) + " else 'general' end"
query(
    "question_type",
    lambda v: led(v.qa).select("qid", Q.question_type(F.col("question")).alias("type")),
    f"with q as (select qid, {LED} as question from qa) select qid, {KIND} as type from q",
    "qa",
)
query(
    "question_features",
    lambda v: led(v.qa).select("qid", *Q.question_features(F.col("question"), ["rating", "with", "und"])),
    rf"""with q as (select qid, {LED} as question from qa) select qid, cast(len(regexp_extract_all(question, '\S+')) as int) as n_words,
  contains(lower(question), 'rating') or contains(lower(question), 'with') or contains(lower(question), 'und') as asks_specific, cast(length(question) - length(replace(question, '?', '')) as int) as n_marks
    from q""",
    "qa",
)
has = lambda words: "(" + " or ".join(f"contains(q, '{w}')" for w in words) + ")"
# the case: questions of every sixth conversation have found nothing
query(
    "route_question",
    lambda v: Q.route_question(led(v.qa), v.retrieved.join(v.documents, "doc_id").filter("conv_id % 6 <> 5").select("qid", "score", F.length("text").alias("chars")), SIMPLE, HARD),
    rf"""with q as (select qid, conv_id, {LED} as question from qa),
c as (select qid, sum(score) as total, max(score) as best, sum(length(text)) as chars, count(*) as n from retrieved join documents using (doc_id)
  where conv_id % 6 <> 5 group by 1),
x as (select q.qid, lower(trim(question)) as q, len(regexp_extract_all(question, '\S+')) as words, length(question) - length(replace(question, '?', '')) as marks, coalesce(best, 0) as best, coalesce(chars, 0) as chars,
  coalesce(n, 0) as n, coalesce(total, 0) / greatest(coalesce(n, 0), 1) as mean from q left join c on c.qid = q.qid),
r as (select qid, case when {has(SIMPLE)} and mean >= 0.5 then 'standard:simple_query_good_retrieval'
  when best >= 0.6 then 'standard:high_confidence_retrieval' when words <= 10 then 'standard:short_query'
  when {has(HARD)} and not {has(SIMPLE)} then 'premium:complex_query_detected' when words <= 20 and mean >= 0.45 then 'standard:standard_faq_query'
    when chars > 5000 and n > 6 then 'premium:large_context_synthesis'
  when marks > 1 or {has((" and also ", " as well as "))} then 'premium:multi_part_query'
    when mean < 0.35 then 'premium:low_confidence_needs_reasoning' else 'standard:default_standard' end as r from x)
select qid, split_part(r, ':', 1) as tier, split_part(r, ':', 2) as reason from r""",
    "qa retrieved",
)
query(
    "model_tier",
    lambda v: v.ev.filter("model_used is not null").groupBy(Q.model_tier(F.col("model_used")).alias("tier")).agg(F.count("*").alias("n")),
    "select case when contains(model_used, 'mini') then 'standard' else 'premium' end as tier, count(*) as n from ev where model_used is not null group by 1",
    "ev",
)
