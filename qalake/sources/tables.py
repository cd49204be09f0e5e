"""The input tables, and views of them in the shapes that the operators take.

Each view is one SELECT that Spark and DuckDB both read, so that a query and its SQL counterpart start from the same rows;
where the dialects differ, {k} stands for the differing expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
K_SPARK = "cast(get_json_object(props, '$.k') as int)"
K_DUCK = "cast(json_extract_string(props, '$.k') as int)"

VIEWS = {
    # event log: pageviews, chat questions, visitor locations
    "ev": """
select event_id as id, ts, cast(user_id as string) as sid,
  case event_type when 'view' then 'pageview' when 'signup' then 'visitor_location' else 'chat_question' end as type,
  case when {k} % 9 = 0 then null else concat('/p/', cast({k} % 20 as string)) end as path,
  case when {k} % 5 = 0 then null else concat('https://ref', cast({k} % 7 as string), '.example.org/') end as ref,
  concat(cast(user_id % 5 * 50 + 10 as string), '.', cast(user_id % 40 as string), '.0.', cast(user_id % 250 as string)) as ip,
  case user_id % 8 when 0 then 'CA' when 1 then 'TX' when 2 then 'ny' when 3 then 'NY' when 4 then 'Local'
    when 5 then 'Unknown' when 6 then 'International-DE' else null end as location,
  case when event_type <> 'error' then 60 + {k} * 5 end as openai_prompt_tokens,
  case when event_type <> 'error' then 40 + {k} * 2 end as openai_completion_tokens,
  case when event_type <> 'error' then 100 + {k} * 7 end as openai_total_tokens,
  case event_type when 'click' then 'mini' when 'purchase' then 'premium' end as model_used,
  case {k} % 3 when 0 then 'p1' when 1 then 'p2' end as api_provider,
  cast(floor(value * 10) as int) as response_ms,
  20 + {k} as prompt_chars, 200 + {k} * 3 as answer_chars,
  case when event_type = 'error' then 0 else 1 end as success,
  case {k} % 4 when 0 then 'exact' when 1 then 'semantic' when 2 then 'miss' end as cache_hit,
  concat('question ', cast({k} as string)) as question,
  {k} % 11 = 0 as verified, {k} % 13 = 0 as flagged, {k} as k, event_type, user_id
from events""",
    # questions as they were asked: time and words from the event of that number, a vector, and a document's text about it
    "asks": """
select vec_id as qid, ts, concat('question ', cast({k} as string)) as question, embedding, text
from embeddings join events on event_id = vec_id join documents on doc_id = vec_id""",
    # question and answer log
    "qa": """
select conv_id * 100 + turn as qid, conv_id, turn, text as question, next_text as answer
from (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as next_text,
  lead(role) over (partition by conv_id order by turn) as next_role from conversations) t
where role = 'user' and next_role = 'assistant'""",
    # answers with a citation and figures
    "cited": """
select qid, conv_id, question, concat(answer, ' It pays ', cast(conv_id % 11 * 10 as string), '% after ', cast(conv_id % 4 + 1 as string),
  ' years [', cast(conv_id % 5 + 1 as string), '].') as answer from qa""",
    # ranked chunks for each question, from all documents
    "retrieved": """
select qid, conv_id, r as rank, (conv_id * 7 + r * 13) % docs as doc_id, cast(round(0.70 - 0.06 * r - (conv_id % 10) * 0.03, 4) as double) as score
from qa cross join (select 1 as r union all select 2 as r union all select 3 as r) n cross join (select max(doc_id) + 1 as docs from documents) d""",
    # documents as chunks, each with a page's url, all pages in turn
    "chunks": """
select d.doc_id as entry_id, d.source as topic, d.lang as type, d.text as content, p.url as url
from documents d cross join (select max(page_id) + 1 as last_page from pages) m left join pages p on p.page_id = d.doc_id % last_page""",
    # documents as markdown: every third line a heading, blank lines between
    "md": "select doc_id, source, lang, {md} as text from documents",
    # documents with a chunk marker after every third line
    "marked": "select doc_id, {marked} as text from documents",
    # documents with a section of questions and one of references
    "faq": "select doc_id, source, {faq} as text from documents",
    # six topics with two keywords each
    "topics": """
select * from (values (1, 'with-that', 'with', 'that'), (2, 'und-des', 'und', 'des'), (3, 'para-pour', 'para', 'pour'),
  (4, 'with-und', 'with', 'und'), (5, 'that-para', 'that', 'para'), (6, 'des-pour', 'des', 'pour')) t(id, slug, kw1, kw2)""",
    "ip_ranges": """
select * from (values (0, 536870911, 'R0'), (536870912, 1073741823, 'R1'), (1073741824, 1610612735, 'R2'), (1610612736, 2147483647, 'R3'),
  (2147483648, 2684354559, 'R4'), (2684354560, 3221225471, 'R5'), (3221225472, 3758096383, 'R6'), (3758096384, 4294967295, 'R7')) t(lo, hi, region)""",
    # key/value statistics of an earlier store
    "kv": """
select 'ask_count' as key, cast(count(*) as string) as value from customer
union all select 'visit_count' as key, cast(count(*) as string) as value from orders
union all select 'unique_visitors' as key, concat('["', {names}, '"]') as value from nation
union all select 'locations' as key, concat('{{', {counts}, '}}') as value from (
  select case n_nationkey % 5 when 0 then 'CA' when 1 then 'tx' when 2 then 'Local' when 3 then 'International-FR' else 'elsewhere' end as place, count(*) as n
  from customer join nation on c_nationkey = n_nationkey group by 1) x
union all select 'broken' as key, 'n/a' as value""",
}
#: Views that a view is made of.
USES = {"cited": ["qa"], "retrieved": ["qa"]}
BASE = {
    "md": ["documents"],
    "marked": ["documents"],
    "faq": ["documents"],
    "ev": ["events"],
    "asks": ["embeddings", "events", "documents"],
    "qa": ["conversations"],
    "chunks": ["documents", "pages"],
    "retrieved": ["documents"],
    "kv": ["customer", "orders", "nation"],
}
_S = ("array_join(transform(split(text, '\\n'), (x, i) -> {}), {})", "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {}), {})")
DIALECT = {
    "spark": {
        "md": _S[0].format("case when i % 3 = 0 then concat('## ', x) else x end", "concat(char(10), char(10))"),
        "marked": _S[0].format(
            "case when i % 3 = 2 then concat(x, char(10), '<!-- Chunk ', cast(i div 3 + 1 as string), '/9 | Heading: ', left(x, 12), ' | Words: ', cast(length(x) as string), ' -->') else x end",
            "char(10)",
        ),
        "faq": "concat('Intro', char(10), '## Frequently Asked Questions', char(10), " + _S[0].format(
            "case when i % 2 = 0 then concat('- #### ', x) else concat('- ', x) end",
            "char(10)",
        ) + ", char(10), '## References', char(10), 'See ', source, char(10), '## Notes', char(10), lang)",
        "k": K_SPARK,
        "names": "listagg(n_name, '\",\"') within group (order by n_name)",
        "counts": "listagg(concat('\"', place, '\":', cast(n as string)), ',') within group (order by place)",
    },
    "duck": {
        "md": _S[1].format("case when (i - 1) % 3 = 0 then concat('## ', x) else x end", "concat(chr(10), chr(10))"),
        "marked": _S[1].format(
            "case when (i - 1) % 3 = 2 then concat(x, chr(10), '<!-- Chunk ', cast((i - 1) // 3 + 1 as varchar), '/9 | Heading: ', left(x, 12), ' | Words: ', cast(length(x) as varchar), ' -->') else x end",
            "chr(10)",
        ),
        "faq": "concat('Intro', chr(10), '## Frequently Asked Questions', chr(10), " + _S[1].format(
            "case when (i - 1) % 2 = 0 then concat('- #### ', x) else concat('- ', x) end",
            "chr(10)",
        ) + ", chr(10), '## References', chr(10), 'See ', source, chr(10), '## Notes', chr(10), lang)",
        "k": K_DUCK,
        "names": "string_agg(n_name, '\",\"' order by n_name)",
        "counts": "string_agg(concat('\"', place, '\":', cast(n as varchar)), ',' order by place)",
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, as it is stored: times keep their type, so that scans can use comparisons on them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of sf_dir, or a table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    needs = {n: view(spark, sf_dir, n) for n in [*USES.get(name, []), *BASE.get(name, [])]}
    sql = VIEWS[name].format(**DIALECT["spark"])
    for n in needs:
        for word in ("from", "join"):
            sql = sql.replace(f"{word} {n}\n", f"{word} {{{n}}}\n").replace(f"{word} {n} ", f"{word} {{{n}}} ").replace(f"{word} {n})", f"{word} {{{n}}})")
        if sql.endswith(f"from {n}"):
            sql = sql[: -len(n)] + f"{{{n}}}"
    return spark.sql(sql.replace("'{',", "'{{',").replace(", '}')", ", '}}')"), **needs)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL over views."""
    order: list[str] = []
    for name in names:
        order += [n for n in [*USES.get(name, []), name] if n not in order]
    parts = [f"{n} as ({VIEWS[n].format(**DIALECT['duck'])})" for n in order]
    sql = sql.strip()
    return f"with recursive {', '.join(parts)}, {sql[5:].removeprefix('recursive ')}" if sql.startswith("with ") else f"with {', '.join(parts)} {sql}"
