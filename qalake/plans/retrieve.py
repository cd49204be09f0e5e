"""Queries on embeddings and retrieval. Every twentieth vector is a question; all vectors but the question's own are its corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qalake.functions.text import cosine
from qalake.operators import retrieval as R
from qalake.session import shared_folder

from .catalog import query

FLOOR, WEAK, REFUSE = 0.30, 0.40, 0.35


def questions(v):
    return v.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("expected"))


def corpus(v):
    return v.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def found(v, k=R.TOP_K, floor=FLOOR):
    return R.knn_topk(questions(v), corpus(v), k, floor, skip_self=True)


def knn(k=R.TOP_K, floor=FLOOR) -> str:
    return f"""select qid, id, score, cast(row_number() over (partition by qid order by score desc, id) as int) as rank from (
  select q.vec_id as qid, c.vec_id as id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as score
    from embeddings q, embeddings c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id) s
  where score >= {floor} qualify rank <= {k}"""


query(
    "embedding_text",
    lambda v: v.chunks.select(
        "entry_id",
        F.md5(
            R.embedding_text(F.when(F.col("entry_id") % 3 != 0, F.col("topic")), F.when(F.col("entry_id") % 2 == 0, F.col("type")), F.col("content"))
        ).alias("digest"),
    ),
    r"""select entry_id, md5(case when entry_id % 3 = 0 then content
  when entry_id % 2 = 0 then 'Code ' || type || ': ' || topic || chr(10) || content else topic || chr(10) || content end) as digest from chunks""",
    "chunks",
)
query(
    "corpus_hash",
    lambda v: R.corpus_hash(v.documents, "doc_id", "text"),
    """with h as (select sha256(cast(doc_id as varchar) || chr(31) || text) as h from documents)
select substr(sha256(concat_ws(':', cast(count(*) as varchar), """
    + ", ".join(f"cast(coalesce(sum(('0x' || substr(h, {1 + 12 * i}, 12))::bigint), 0) as varchar)" for i in range(5))
    + ")), 1, 16) as corpus_hash from h",
)
stored = lambda v: v.documents.filter("doc_id % 7 <> 0").select(
    F.col("doc_id").alias("id"),
    R.row_hash(F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text"))).alias("text_hash"),
)
query(
    "embedding_backlog",
    lambda v: R.embedding_backlog(v.documents.select(F.col("doc_id").alias("id"), "text"), stored(v)),
    "select doc_id as id, sha256(text) as text_hash from documents where doc_id % 7 = 0 or doc_id % 5 = 0",
)
query(
    "embed_batches",
    lambda v: R.embed_batches(v.qa.select(F.col("question").alias("text")), 10, 400, 60),
    """with recursive t as (select sha256(q) as text_hash, least(length(q) // 4 + 1, 400) as tokens from (select distinct lower(question) as q from qa) d),
p as (select *, ('0x' || substr(text_hash, 1, 8))::bigint * greatest((select (count(*) + 59) // 60 from t), 1) // 4294967296 as part from t),
o as (select *, row_number() over (partition by part order by text_hash) as i from p),
w as (select part, text_hash, i, 0 as batch, 1 as n, tokens as used from o where i = 1 union all
  select o.part, o.text_hash, o.i, w.batch + cast(w.n >= 10 or w.used + o.tokens > 400 as int), case when w.n >= 10 or w.used + o.tokens > 400 then 1 else w.n + 1 end,
    case when w.n >= 10 or w.used + o.tokens > 400 then o.tokens else w.used + o.tokens end from w join o on o.part = w.part and o.i = w.i + 1)
select text_hash, cast(part as int) as part, cast(batch as int) as batch from w""",
    "qa",
)


def letters(texts):
    """Stands for a model: the length of a text, and how often it has a space, an e and an n."""
    return [[float(x) for x in (len(t), t.count(" "), t.count("e"), t.count("n"))] for t in texts]


def embedded(v):
    """Questions first, then questions and answers: the second run encodes answers alone, the third one nothing."""
    memo = f"{shared_folder(v.spark)}/memo-{uuid.uuid4().hex}"
    asked = v.qa.select(F.col("question").alias("text"))
    both = asked.unionByName(v.qa.select(F.col("answer").alias("text")))
    R.embed_texts(asked, letters, memo, "letters", 10, 400)
    _, more = R.embed_texts(both, letters, memo, "letters", 10, 400)
    rows, again = R.embed_texts(both, letters, memo, "letters", 10, 400)
    at = [F.element_at("embedding", i + 1).cast("int").alias(c) for i, c in enumerate(("chars", "spaces", "es", "ns"))]
    return rows.select("text_hash", *at, F.lit(more).alias("second_run"), F.lit(again).alias("third_run"))


query(
    "embed_texts",
    embedded,
    """with q as (select distinct lower(question) as t from qa), b as (select t from q union select lower(answer) from qa),
n as (select (select count(*) from b) - (select count(*) from q) as more)
select sha256(t) as text_hash, cast(length(t) as int) as chars, cast(length(t) - length(replace(t, ' ', '')) as int) as spaces, cast(length(t) - length(replace(t, 'e', '')) as int) as es,
  cast(length(t) - length(replace(t, 'n', '')) as int) as ns, cast(more as int) as second_run, cast(0 as int) as third_run from b cross join n""",
    "qa",
)
query(
    "normalize_vectors",
    lambda v: R.normalize_vectors(v.embeddings).select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("unit"), F.round(cosine(F.col("embedding"), F.col("embedding")), 6).alias("own")).select("vec_id", "own", F.posexplode("unit").alias("at", "value")),
    """with n as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as length from n)
select vec_id, 1.0::double as own, cast(unnest(range(0, len(e))) as int) as at, round(unnest(e) / length, 5) as value from u""",
)
query(
    "cosine_pairs",
    lambda v: R.cosine_pairs(
        v.embeddings.withColumn("pair", F.floor(F.col("vec_id") / 2)).filter("vec_id % 2 = 0"),
        v.embeddings.withColumn("pair", F.floor(F.col("vec_id") / 2)).filter("vec_id % 2 = 1"),
        ["pair"],
    ).withColumn("score", F.round("score", 6)),
    "select a.vec_id // 2 as pair, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as score from "
    "embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0",
)
query("knn_topk", lambda v: found(v), knn())
query(
    "knn_table_search",
    lambda v: found(v, 5, 0.0).join(v.chunks.select(F.col("entry_id").alias("id"), "topic", F.left("content", F.lit(500)).alias("body")), "id").select(
        "qid",
        "id",
        "rank",
        F.round(1 - F.col("score"), 6).alias("distance"),
        "topic",
        F.length("body").alias("preview_chars"),
    ),
    f"select qid, id, rank, round(1 - score, 6) as distance, topic, cast(length(substr(content, 1, 500)) as int) as preview_chars from ({knn(5, 0.0)}) f join chunks on entry_id = id",
    "chunks",
)


def approx(v):
    return R.knn_approx(questions(v), corpus(v), R.TOP_K, FLOOR, skip_self=True)


def approx_recall(v):
    """Exact neighbours by question, and whether the approximate form found 95 % of all of them by rescoring a tenth of the vectors at most."""
    rows, how = approx(v)
    exact = found(v).groupBy("qid").agg(F.count("*").alias("neighbours"))
    share = R.recall(rows, found(v)).agg((F.sum(F.col("n") * F.col("recall")) / F.sum("n") >= 0.95).alias("reached"))
    return exact.crossJoin(F.broadcast(share)).withColumn("spared", F.lit(how["share"] <= 0.1))  # one row


query("knn_approx", approx_recall, f"select qid, count(*) as neighbours, true as reached, true as spared from ({knn()}) f group by qid")
query("knn_approx_search", lambda v: approx(v)[0])
query(
    "retrieval_quality",
    lambda v: R.retrieval_quality(questions(v), found(v), WEAK, REFUSE),
    f"""with f as ({knn()}), g as (select qid, max(score) as best, min(score) as worst, count(*) as n from f group by 1)
select vec_id as qid, best, worst, round(best - worst, 6) as spread, coalesce(n, 0) as n, coalesce(best < {WEAK}, true) as weak, coalesce(best < {REFUSE}, true) as refuse
  from embeddings left join g on qid = vec_id where vec_id % 20 = 0""",
)
query(
    "hyde_retrieval",
    lambda v: R.knn_topk(R.hyde_vectors(questions(v).join(corpus(v).select((F.col("id") - 1).alias("qid"), F.col("embedding").alias("hyde")).filter("qid % 40 = 0"), "qid", "left")), corpus(v), 3, FLOOR, skip_self=True),
    f"""select qid, id, score, cast(row_number() over (partition by qid order by score desc, id) as int) as rank from (
  select q.vec_id as qid, c.vec_id as id, round(list_cosine_similarity(cast(coalesce(h.embedding, q.embedding) as double[]), cast(c.embedding as double[])), 6) as score
  from embeddings q left join embeddings h on h.vec_id = q.vec_id + 1 and q.vec_id % 40 = 0, embeddings c
    where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id) s where score >= {FLOOR} qualify rank <= 3""",
)
query(
    "score_floor_search",
    lambda v: R.score_floor_search(found(v, 25, 0.0), v.chunks.select(F.col("entry_id").alias("id"), F.when(F.col("entry_id") % 3 == 0, "").alias("text"), F.when(F.col("entry_id") % 4 != 0, F.col("topic")).alias("content"), F.when(F.col("entry_id") % 5 != 0, F.col("type")).alias("preview"))).drop("rank"),
    f"""select qid, id, score, body, cast(row_number() over (partition by qid order by rank) as int) as place from (
  select f.*, case when entry_id % 4 <> 0 then topic when entry_id % 5 <> 0 then type end as body from ({knn(25, 0.0)}) f join chunks on entry_id = id
    where score > 0.005) x where body is not null qualify place <= 8""",
    "chunks",
)
query(
    "chunk_sources",
    lambda v: R.chunk_sources(v.retrieved.join(v.documents, "doc_id").select("qid", "rank", F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")).alias("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("subtopic"), F.concat("source", F.lit("-h")).alias("heading"))),
    """with s as (select qid, rank, 's' || cast(doc_id % 2 as varchar) as source, case when doc_id % 2 = 0 then lang else source || '-h'
  end as section from retrieved join documents using (doc_id)),
f as (select * from s qualify row_number() over (partition by qid, source order by rank) = 1)
select qid, source, rank, section, cast(row_number() over (partition by qid order by rank) as int) as place from f""",
    "retrieved",
)
query(
    "pack_context",
    lambda v: R.pack_context(v.retrieved.join(v.documents, "doc_id").select("qid", "rank", "text"), 2600),
    """with c as (select qid, rank, length(text) as chars from retrieved join documents using (doc_id)),
p as (select qid, 0 as rank, 0 as used, 0 as taken union all
  select p.qid, p.rank + 1, p.used + least(c.chars, least(1500, 2600 - p.used - 100)) + 100, least(c.chars, least(1500, 2600 - p.used - 100)) from p
    join c on c.qid = p.qid and c.rank = p.rank + 1 where least(1500, 2600 - p.used - 100) >= 200)
select qid, cast(rank as int) as rank, cast(taken as int) as taken from p where rank > 0""".replace("select qid, 0 as rank, 0 as used, 0 as taken union all", "select distinct qid, cast(0 as bigint) as rank, cast(0 as bigint) as used, cast(0 as bigint) as taken from c union all"),
    "retrieved",
)
query(
    "recent_history",
    lambda v: R.recent_history(v.conversations.select("conv_id", "turn", "role"), 6),
    "select conv_id, turn, role from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as back from "
    "conversations) t where back <= 6 and role in ('user', 'assistant')",
)
#: Terms of a table: a word of each document, and some with other cases, spaces, and characters of their own.
SEARCH = "select 'with' as term union all select 'Und ' union all select 'e' union all select 'src1' union all select split_part(text, ' ', 3) from documents where split_part(text, ' ', 3) <> ''"
query(
    "term_search",
    lambda v: R.term_search(v.chunks, v.spark.sql(SEARCH.replace("documents", "{documents}"), documents=v.documents)),
    f"""with t as (select distinct term from ({SEARCH}) s), h as (select term, entry_id, row_number() over (partition by term order by entry_id) as i from t
  join chunks on contains(lower(content || chr(10) || topic), lower(term)))
select term, count(*) as n, string_agg(cast(entry_id as varchar), ',' order by entry_id) filter (where i <= 5) as sample_ids from h group by 1""",
    "chunks",
)
query(
    "retrieval_probe",
    lambda v: R.retrieval_probe(questions(v), corpus(v), skip_self=True),
    f"select qid, rank, id, score, q.label as expected, c.label as label, q.label = c.label as hit from ({knn(10, 0.3)}) f join embeddings q on q.vec_id = qid join embeddings c on c.vec_id = id",
)
query(
    "low_confidence_report",
    lambda v: R.low_confidence_report(R.retrieval_quality(v.qa, v.retrieved), v.qa.select("qid", "question"), v.retrieved, ["with", "und"]),
    r"""with g as (select qid, max(score) as best, string_agg(cast(doc_id as varchar), ',' order by rank) as chunk_ids from retrieved group by 1),
x as (select qa.qid, best, chunk_ids, cast(len(regexp_extract_all(question, '\S+')) as int) as n_words, contains(lower(question), 'with') or contains(lower(question), 'und') as asks_specific, best < 0.45 as possible_gap
  from qa join g on g.qid = qa.qid where best < 0.55)
select *, concat_ws(',', case when possible_gap then 'add_content' end, case when n_words <= 3 then 'ask_for_detail' end, case
  when asks_specific then 'check_terms' end) as advice from x""",
    "qa retrieved",
)
