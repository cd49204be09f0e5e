"""Queries on corpus preparation and url checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalake.functions.text import estimate_tokens
from qalake.operators import corpus as C
from qalake.operators import urls as U

from .catalog import query

digest = lambda c: F.md5(c).alias(c if isinstance(c, str) else "digest")
HTML = ((r"(?s)<!--.*?-->", ""), (r"(?s)<script.*?</script>", ""), ("&amp;", "&"), (r"\*{3}", "---"), (r"[ \t]+\n", "\n"), (r"\n{4,}", "\n\n\n"))


def folded(text: str, rules) -> str:
    for pattern, new in rules:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')".replace("\n", "' || chr(10) || '")
    return text


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
query("clean_text", lambda v: v.pages.select("page_id", F.md5(C.clean_text(F.col("html"), HTML)).alias("digest")), f"select page_id, md5({STRIP.format(folded('html', HTML))}) as digest from pages")
query(
    "strip_navigation",
    lambda v: v.md.select("doc_id", F.md5(C.strip_navigation(F.concat(F.lit("Menu\n[Home] x\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("# Title\n")).otherwise(""), "text"), r"^\[Home\]|^## [A-M]")).alias("digest")),
    r"""with l as (select doc_id, string_split('Menu' || chr(10) || '[Home] x' || chr(10) || case
  when doc_id % 2 = 0 then '# Title' || chr(10) else '' end || text, chr(10)) as l from md),
s as (select doc_id, l, coalesce(list_min(list_filter(list_transform(l, lambda x, i: case
  when starts_with(trim(x), '# ') or (starts_with(trim(x), '## ') and i > 31) then i end), lambda i: i is not null)), 1) as s from l)
select doc_id, md5(array_to_string(list_filter(l, lambda x, i: i >= s and not regexp_matches(trim(x), '^\[Home\]|^## [A-M]')), chr(10))) as digest from s""",
    "md",
)
MARK = r"<!-- Chunk \d+/\d+ \| Heading: ?.*? ?\| Words: \d+ -->"
query(
    "split_markers",
    lambda v: C.split_markers(v.marked).select("doc_id", "pos", "number", "total", "heading", "words", digest("content")),
    rf"""with m as (select doc_id, regexp_extract_all(text, '{MARK}') as m, string_split(regexp_replace(text, '{MARK}', chr(1), 'g'), chr(1)) as p from marked),
r as (select doc_id, unnest(range(1, len(m) + 1)) as i, m, p from m)
select doc_id, cast(i - 1 as int) as pos, cast(regexp_extract(m[i], 'Chunk (\d+)/', 1) as int) as number, cast(regexp_extract(m[i], 'Chunk \d+/(\d+)', 1) as int) as total, trim(regexp_extract(m[i], 'Heading: ?(.*?) ?\| Words', 1)) as heading,
  cast(regexp_extract(m[i], 'Words: (\d+)', 1) as int) as words, md5({STRIP.format('p[i]')}) as content from r where length({STRIP.format('p[i]')}) >= 20""",
    "marked",
)
SECTIONS = rf"""select doc_id, cast(i - 1 as int) as pos, trim(replace(regexp_extract(c, '^## ([^\n]*)', 1), '**', '')) as heading, c as content from (
  select doc_id, i, {STRIP.format('p[i]')} as c from (select doc_id, p, unnest(range(1, len(p) + 1)) as i
    from (select doc_id, string_split(replace(text, chr(10) || '## ', chr(1) || '## '), chr(1)) as p from {{}}) s) t) u where length(c) >= 100"""
KEPT = "heading not in ('Frequently Asked Questions', 'References', 'See Also')"
ANCHOR = "regexp_replace(lower(heading), '[^a-z0-9]+', '', 'g')"
query(
    "split_headings",
    lambda v: C.split_headings(v.md).select("doc_id", "pos", "heading", "anchor", digest("content")),
    f"select doc_id, pos, heading, {ANCHOR} as anchor, md5(content) as content from ({SECTIONS.format('md')}) x where {KEPT}",
    "md",
)
SECTION = r"regexp_extract(text, '(?s)(?:^|\n)## (?:\*\*)?{}(?:\*\*)?\n(.*?)(?:\n## |$)', 1)"
FAQ = rf"""select doc_id, cast(i - 1 as int) as pos, trim(regexp_extract(p, '^([^\n]*)', 1)) as question, trim(regexp_replace(regexp_replace(regexp_extract(p, '(?s)^[^\n]*\n(.*)$', 1), '^\s*- ', ''), '\n\n+', chr(10) || chr(10), 'g')) as answer
  from (
  select doc_id, i, q[i + 1] as p from (select doc_id, q, unnest(range(1, len(q))) as i
    from (select doc_id, string_split(chr(10) || {SECTION.format('Frequently Asked Questions')}, chr(10) || '- #### ') as q from faq) a) b) c"""
FAQ = f"select * from ({FAQ}) d where question <> '' and length(answer) > 20"
query(
    "extract_faq",
    lambda v: C.extract_faq(v.faq).select("doc_id", "pos", digest("question"), digest("answer")),
    f"select doc_id, pos, md5(question) as question, md5(answer) as answer from ({FAQ}) f",
    "faq",
)
query(
    "extract_section",
    lambda v: v.faq.select(
        "doc_id",
        C.extract_section(F.col("text"), "References").alias("refs"),
        F.md5(C.extract_section(F.col("text"), "Frequently Asked Questions")).alias("faq"),
    ),
    f"select doc_id, {SECTION.format('References')} as refs, md5({SECTION.format('Frequently Asked Questions')}) as faq from faq",
    "faq",
)
query(
    "build_chunks",
    lambda v: C.build_chunks(v.faq, "https://kb.example.org/").select("entry_id", "type", "url", digest("content")),
    rf"""select cast(f.doc_id as varchar) || '-faq-' || cast(pos + 1 as varchar) as entry_id, 'faq' as type, 'https://kb.example.org/' || source || '#faq' as url, md5(answer) as content
  from ({FAQ}) f join faq on faq.doc_id = f.doc_id
union all select cast(doc_id as varchar) || '-references', 'reference', 'https://kb.example.org/' || source || '#references', md5(trim({SECTION.format('References')})) from faq
union all
  select cast(s.doc_id as varchar) || '-section-' || cast(pos + 1 as varchar), 'section', 'https://kb.example.org/' || source || '#' || {ANCHOR}, md5(content)
  from ({SECTIONS.format('faq')}) s join faq on faq.doc_id = s.doc_id where {KEPT}""",
    "faq",
)
PACK = """with recursive q as (select doc_id, i, {size} as n from (select doc_id, p, unnest(range(1, len(p) + 1)) as i
  from (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p
  from md) a) b),
w as (select doc_id, i, n, 1 as g from q where i = 1 union all
  select q.doc_id, q.i, case when w.n + 2 + q.n <= {limit} then w.n + 2 + q.n else q.n end, case when w.n + 2 + q.n <= {limit} then w.g else w.g + 1
    end from w join q on q.doc_id = w.doc_id and q.i = w.i + 1)
select doc_id, cast(g - 1 as int) as pos, cast(max(n) as int) as chars from w group by doc_id, g"""
query("pack_parts", lambda v: C.pack_parts(v.md, limit=900).select("doc_id", "pos", F.length("content").alias("chars")), PACK.format(size="length(p[i])", limit=900), "md")


def numbered(v):
    """Documents whose sixth lines are coded headings, with numbered questions, rules and step rows between."""
    line = lambda x, i: F.when(
        (i % 6 == 5) & (F.col("doc_id") % 3 != 0),
        F.concat(F.lit("### 1.A.2.b. "), x),
    ).when(i % 10 == 9, F.concat(x, F.lit("\n---"))).when(i % 4 == 3, F.concat(F.lit("# 7. Q: "), x)).when(
        i % 14 == 13,
        F.concat(F.lit("| **Step** "), x),
    )
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: line(x, i).when(i % 16 == 0, F.concat(x, F.lit("\n"))).otherwise(x)), "\n")
    return v.documents.select("doc_id", "source", "lang", text.alias("text"))


# -- the same in SQL: a mark (chr(1)) is set where a text is cut, since its regular expressions look neither ahead nor behind
NUMBERED = """nd as (select doc_id, source, lang, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: case
    when (j - 1) % 6 = 5 and doc_id % 3 <> 0 then '### 1.A.2.b. ' || x when (j - 1) % 10 = 9 then x || chr(10) || '---' when (j - 1) % 4 = 3 then '# 7. Q: ' || x
    when (j - 1) % 14 = 13 then '| **Step** ' || x when (j - 1) % 16 = 0 then x || chr(10) else x end), chr(10)) as text from documents)"""
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
HEADED = r"(###\s+\*{0,4}\d+\.[A-Za-z]+\.\d+\.[a-z])"
ASKED = r"\n((?:# |\n)\d+\.\s*Q:)"


def marked(pattern: str, text: str = "text") -> str:
    """The text with a mark before what the pattern's group finds, or in place of the pattern."""
    return f"regexp_replace({text}, '{pattern}', " + (r"chr(1) || '\1'" if pattern in (HEADED, ASKED) else "chr(1)") + ", 'g')"


def stripped(text: str) -> str:
    """Non-empty stripped parts of a marked text."""
    return f"list_filter(list_transform(string_split({text}, chr(1)), lambda x: {TRIM.format('x')}), lambda x: x <> '')"


def packed(name: str, source: str, limit: int, joint: str = "chr(10) || chr(10)") -> str:
    """Greedy packs (name: doc_id, k, g, content) of numbered parts (source: doc_id, k, i, p), by tokens."""
    more = joint.count("chr") or 1
    fits = f"(w.n + {more} + length(q.p)) // 4 <= {limit}"
    return f"""{name}_w as (select doc_id, k, i, p, length(p) as n, 1 as g from {source} where i = 1 union all
  select q.doc_id, q.k, q.i, q.p, case when {fits} then w.n + {more} + length(q.p) else length(q.p) end, case when {fits} then w.g else w.g + 1 end
  from {name}_w w join {source} q on q.doc_id = w.doc_id and q.k = w.k and q.i = w.i + 1),
{name} as (select doc_id, k, g, string_agg(p, {joint} order by i) as content from {name}_w group by 1, 2, 3)"""


def cut_up(name: str, source: str, chars: int) -> str:
    """Pieces (name: doc_id, k, sub, piece) of texts (source: doc_id, k, p), cut at the last white space within `chars`."""
    blank = r"lambda z: regexp_matches(substr({0}, z, 1), '\s') or regexp_matches(substr({0}, z + 1, 1), '\s')"
    size = f"case when length({{0}}) <= {chars} then length({{0}}) else coalesce(list_max(list_filter(range(1, {chars + 1}), {blank})), {chars}) end"
    return f"""{name}_l as (select doc_id, k, 0 as sub, p as rest, {size.format('p')} as size from {source} where p <> '' union all
  select doc_id, k, sub + 1, rest, {size.format('rest')} from (select doc_id, k, sub, substr(rest, size + 1) as rest from {name}_l where length(rest) > size) y),
{name} as (select doc_id, k, sub, substr(rest, 1, size) as piece from {name}_l)"""


def subsections(source: str, limit: int) -> str:
    """sb: doc_id, pos, sub, content."""
    return f"""sm as (select doc_id, text, len(regexp_extract_all(text, '{HEADED}')) > 1 as many from {source}),
s1 as (select doc_id, {stripped(marked(HEADED))} as l from sm where many),
s2 as (select doc_id, unnest(range(0, len(l))) as k, unnest(l) as text from s1),
s3 as (select doc_id, k, {stripped(marked(chr(92) + 'n' + chr(92) + 'n+'))} as l from s2 where length(text) // 4 > {2 * limit}),
s4 as (select doc_id, k, unnest(range(1, len(l) + 1)) as i, unnest(l) as p from s3), {packed('s5', 's4', limit)},
r1 as (select doc_id, 0 as k, {stripped(marked(RULE))} as l from sm where not many),
r2 as (select doc_id, k, unnest(range(1, len(l) + 1)) as i, unnest(l) as p from r1), {packed('r3', 'r2', limit)},
sx as (select doc_id, k as pos, 0 as sub, text as content from s2 where length(text) // 4 <= {2 * limit}
  union all select doc_id, k, g - 1, content from s5),
sb as (select * from sx union all select doc_id, g - 1, 0, content from r3)"""


def questions_cut(source: str, limit: int) -> str:
    """qb: doc_id, pos, content."""
    return f"""q1 as (select doc_id, {stripped(marked(ASKED))} as l from {source}),
q2 as (select doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as p from q1),
q3 as (select * from q2 where length(p) // 4 > {limit}), {cut_up('q4', 'q3', 4 * limit)},
q5 as (select doc_id, 0 as k, row_number() over (partition by doc_id order by k) as i, p from q2 where length(p) // 4 <= {limit}), {packed('q6', 'q5', limit)},
q7 as (select doc_id, 0 as late, k, sub, {TRIM.format('piece')} as content from q4 union all select doc_id, 1, g, 0, content from q6),
qb as (select doc_id, row_number() over (partition by doc_id order by late, k, sub) - 1 as pos, content from q7 where content <> '')"""


RULE = r"\n\* \* \*\n|\n---\n"
STEPS = RULE + r"|\n\|\s*\*\*Step\*\*"
content_digest = lambda: F.md5("content").alias("digest")
query(
    "split_subsections", lambda v: C.split_subsections(numbered(v), 100).select("doc_id", "pos", "sub", content_digest()),
    f"with recursive {NUMBERED}, {subsections('nd', 100)} select doc_id, cast(pos as int) as pos, cast(sub as int) as sub, md5(content) as digest from sb",
)
query(
    "split_qa", lambda v: C.split_qa(numbered(v), 60).select("doc_id", "pos", content_digest()),
    f"with recursive {NUMBERED}, {questions_cut('nd', 60)} select doc_id, cast(pos as int) as pos, md5(content) as digest from qb",
)
query(
    "split_large", lambda v: C.split_large(numbered(v), 100, 400).select("doc_id", "pos", "sub", content_digest()),
    f"""with recursive {NUMBERED}, l1 as (select doc_id, string_split({marked(STEPS)}, chr(1)) as l from nd),
l2 as (select doc_id, len(l) = 1 as alone, unnest(range(0, len(l))) as k, unnest(l) as p from l1),
l3 as (select doc_id, k, case when alone then p else {TRIM.format('p')} end as p from l2 where alone or length({TRIM.format('p')}) > 100), {cut_up('l4', 'l3', 400)}
select doc_id, cast(k as int) as pos, cast(sub as int) as sub, md5(piece) as digest from l4""",
)
query(
    "repair_oversized",
    lambda v: C.repair_oversized(numbered(v).select(F.col("doc_id").alias("entry_id"), F.when(F.col("doc_id") % 4 == 0, "FAQ").otherwise(F.col("source")).alias("topic"), F.col("text").alias("content")), 120).select("entry_id", "part", "sub", content_digest()),
    f"""with recursive {NUMBERED}, k1 as (select doc_id, text from nd where length(text) // 4 <= 120), fq as (select doc_id, text from nd
  where length(text) // 4 > 120 and doc_id % 4 = 0), ot as (select doc_id, text from nd where length(text) // 4 > 120 and doc_id % 4 <> 0),
{subsections('ot', 120)}, {questions_cut('fq', 120)},
r4 as (select doc_id, g as k, {stripped(marked(chr(92) + 'n+', 'content'))} as l from r3 where length(content) // 4 > 120),
r5 as (select doc_id, k, unnest(range(1, len(l) + 1)) as i, unnest(l) as p from r4), {packed('r6', 'r5', 120, 'chr(10)')}
select doc_id as entry_id, 0 as part, 0 as sub, md5(text) as digest from k1
  union all select doc_id, cast(pos as int), cast(sub as int), md5(content) from sx
  union all select doc_id, cast(g - 1 as int), 0, md5(content) from r3 where length(content) // 4 <= 120
  union all select doc_id, cast(k - 1 as int), cast(g - 1 as int), md5(content) from r6
  union all select doc_id, cast(pos as int), 0, md5(content) from qb""",
)
query("estimate_tokens", lambda v: v.documents.select("doc_id", estimate_tokens(F.col("text")).alias("tokens")), "select doc_id, cast(length(text) // 4 as int) as tokens from documents")
query(
    "oversized_report",
    lambda v: C.oversized_report(v.chunks.withColumn("url", F.when(F.col("entry_id") % 9 != 0, F.col("url"))), 1000),
    "select count(*) as chunks, count(*) filter (where length(content) // 4 > 1000) as too_large, cast(max(length(content) // 4) as int) as "
    "largest, count(*) filter (where url is null or entry_id % 9 = 0) as missing_url from chunks",
    "chunks",
)
query(
    "repair_schema",
    lambda v: C.repair_schema(v.chunks.select("entry_id", F.when(F.col("entry_id") % 3 == 0, F.col("url")).when(F.col("entry_id") % 3 == 1, "").alias("url"), F.when(F.col("entry_id") % 6 == 1, F.col("url")).alias("source_url"), F.when(F.col("entry_id") % 2 == 0, F.col("type")).alias("type")), [("12", "u12"), ("1", "u1"), ("2", "u2")], "home"),
    """select entry_id, coalesce(case when entry_id % 3 = 0 then url end, case when entry_id % 6 = 1 then url end, case
  when cast(entry_id as varchar) like '12%' then 'u12' when cast(entry_id as varchar) like '1%' then 'u1'
  when cast(entry_id as varchar) like '2%' then 'u2' else 'home' end) as url,
  case when entry_id % 2 = 0 then type else 'general' end as type from chunks""",
    "chunks",
)
TYPES = [("table", ("|",)), ("shout", ("!!",)), ("notice", ("copyright", "license")), ("romance", ("que ", "les ")), ("german", ("und ",))]
case = lambda text: "case " + " ".join("when " + " or ".join(f"contains(lower({text}), '{w}')" for w in words) + f" then '{n}'" for n, words in TYPES) + " end"
query(
    "chunk_type",
    lambda v: v.documents.select("doc_id", C.chunk_type(F.left("text", F.lit(40)), F.col("text"), TYPES).alias("type")),
    f"select doc_id, coalesce({case('substr(text, 1, 40)')}, {case('text')}, 'general') as type from documents",
)
HEADINGS = ["5010 Arthritis (old)", "5010a, 5011 Two", "5010/5011: Slash", "5010-5012 Dash", "None here", " 7101 . Spaced (x) "]


def headings(v):
    return v.documents.select(
        "doc_id",
        F.concat(
            F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % 6 + 1).cast("int")),
            F.when(F.col("doc_id") % 5 == 0, F.lit(" (note)")).otherwise(""),
        ).alias("heading"),
    )


HEAD = "select doc_id, case doc_id % 6 " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(HEADINGS)) + " end || case when doc_id % 5 = 0 then ' (note)' else '' end as heading from documents"
query(
    "heading_code",
    lambda v: headings(v).select("doc_id", C.heading_code(F.col("heading")).alias("code")),
    rf"select doc_id, nullif(regexp_replace(regexp_extract(heading, '^\s*(\d{{4}}[a-z]?(?:\s*[,/-]\s*\d{{4}}[a-z]?)*)', 1), '\s*[,/-]\s*', ',', 'g'), '') as code from ({HEAD}) h",
)
query(
    "heading_name",
    lambda v: headings(v).select("doc_id", C.heading_name(F.col("heading")).alias("name")),
    rf"select doc_id, trim(regexp_replace(regexp_replace(heading, '^\s*\d{{4}}[a-z]?(?:\s*[,/-]\s*\d{{4}}[a-z]?)*[\s:.-]*', ''), '\s*\([^)]*\)\s*$', '')) as name from ({HEAD}) h",
)
query(
    "subtopic",
    lambda v: headings(v).select("doc_id", C.subtopic(F.col("heading"), [("arth", "joints"), ("two", "pairs"), ("da", "marks")]).alias("subtopic")),
    f"select doc_id, case when contains(lower(heading), 'arth') then 'joints' when contains(lower(heading), 'two') then 'pairs' when "
    f"contains(lower(heading), 'da') then 'marks' end as subtopic from ({HEAD}) h",
)
query(
    "carry_parent",
    lambda v: C.carry_parent(C.split_headings(v.md, 40).select("doc_id", "pos", "heading"), F.length("heading") % 3 == 0),
    f"""with s as (select doc_id, pos, heading from ({SECTIONS.replace('>= 100', '>= 40').format('md')}) x where {KEPT}),
p as (select *, last_value(case when length(heading) % 3 = 0 then heading end ignore nulls) over (partition by doc_id
  order by pos rows between unbounded preceding and current row) as p from s)
select doc_id, pos, heading, case when p <> heading then p end as parent from p""",
    "md",
)
query(
    "assign_ids",
    lambda v: C.assign_ids(
        C.split_headings(v.md).select("doc_id", "pos", F.when(F.col("pos") % 4 == 0, "5010").alias("code"))
    ).select("doc_id", "pos", "entry_id"),
    f"select doc_id, pos, coalesce(case when pos % 4 = 0 then '5010' end, 'chunk') || '-' || cast(doc_id as varchar) || '-' || "
    f"lpad(cast(row_number() over (partition by doc_id order by pos) as varchar), 4, '0') as entry_id from ({SECTIONS.format('md')}) x where {KEPT}",
    "md",
)
PAGES = [("und ", "https://kb.example.org/de"), ("que ", "https://kb.example.org/fr"), ("thing", "https://kb.example.org/en")]
query(
    "infer_url",
    lambda v: v.documents.select(
        "doc_id",
        C.infer_url(
            F.left("text", F.lit(60)),
            F.concat("text", F.when(F.col("doc_id") % 2 == 0, " see https://kb.example.org/x#y now").otherwise("")),
            PAGES,
            r"https://kb\.example\.org/\S+#\S+",
            "https://kb.example.org",
        ).alias("url"),
    ),
    "select doc_id, coalesce(" + ", ".join(
        "case " + " ".join(f"when contains(lower({t}), '{w}') then '{u}'" for w, u in PAGES) + " end" for t in (
            "substr(text, 1, 60)",
            "text || case when doc_id % 2 = 0 then ' see https://kb.example.org/x#y now' else '' end",
        )
    ) + ", case when doc_id % 2 = 0 then 'https://kb.example.org/x#y' else 'https://kb.example.org' end) as url from documents",
)
query(
    "add_aliases",
    lambda v: C.add_aliases(v.chunks.select("entry_id", "topic", F.when(F.col("entry_id") % 2 == 0, F.array(F.lit("own"), F.lit("b"))).alias("aliases")), [("src1", ("a", "b")), ("7", ("seven", "a"))]).select("entry_id", F.array_join("aliases", ",").alias("aliases")),
    """select entry_id, array_to_string(list_sort(list_distinct(list_concat(case when entry_id % 2 = 0 then ['own', 'b'] else [] end, list_concat(case
  when contains(lower(cast(entry_id as varchar) || ' ' || topic), 'src1') then ['a', 'b'] else [] end,
  case when contains(lower(cast(entry_id as varchar) || ' ' || topic), '7') then ['seven', 'a'] else [] end)))), ',') as aliases from chunks""",
    "chunks",
)
query("chunk_type_counts", lambda v: C.chunk_type_counts(v.chunks), "select type, count(*) as n, count(distinct topic) as topics from chunks group by 1", "chunks")

# -- urls -------------------------------------------------------------------------------------------------------------

SITE = "example.com"
BLOCKED = ("", "cart", "en/25", "fr/825")
RE = r"example\.com"


def own(v):
    """Urls of pages as links of one site, in several spellings."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?]*)", 1)
    return v.pages.select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), path)).when(F.col("page_id") % 5 == 1, F.concat(F.lit("http://www.example.com/"), path)).when(
            F.col("page_id") % 5 == 2,
            F.concat(F.lit("https://example.com/"), path, F.lit("/")),
        ).otherwise(F.col("url")).alias("url"),
        F.concat(F.lit("t"), (F.col("page_id") % 7).cast("string")).alias("topic"),
    )


OWN = r"""select page_id, case page_id % 5 when 0 then '/' || path when 1 then 'http://www.example.com/' || path
  when 2 then 'https://example.com/' || path || '/' else url end as url, 't' || cast(page_id % 7 as varchar) as topic
  from (select page_id, url, regexp_extract(url, '^[a-z]+://[^/]*/([^?]*)', 1) as path from pages) p"""
NORM = rf"regexp_replace(regexp_replace(case when starts_with(url, '/') then 'https://{SITE}' || url else trim(coalesce(url, '')) end, '^https?://(?:www\.)?({RE})', 'https://\1'), '/+$', '')"
PATH = rf"lower(split_part(regexp_extract({{}}, '{RE}/(.*)$', 1), '#', 1))"
LIST = "(" + ", ".join(f"'{b}'" for b in BLOCKED) + ")"
WHITE = f"select url, string_agg(distinct topic, ',' order by topic) as topics from (select {NORM} as url, topic from ({OWN}) o where page_id % 3 = 0 union all select 'https://{SITE}', 'home') x where url <> '' group by 1"
whitelist = lambda v: U.url_whitelist(own(v).filter("page_id % 3 = 0"), SITE)
query("normalize_url", lambda v: own(v).select("page_id", U.normalize_url(F.col("url"), SITE).alias("url")), f"select page_id, {NORM} as url from ({OWN}) o")
query(
    "blocked_url",
    lambda v: own(v).select("page_id", U.blocked_url(U.normalize_url(F.col("url"), SITE), SITE, BLOCKED).alias("blocked")),
    f"select page_id, case when {NORM} = '' then true else {PATH.format(NORM)} in {LIST} end as blocked from ({OWN}) o",
)
query("url_whitelist", whitelist, WHITE)
VALID = f"""select *, coalesce(url, '') <> '' and (n in (select url from w) or split_part(n, '#', 1) in (select url
  from w) or (contains(n, '{SITE}') and not ({PATH.format('n')} in {LIST}))) as valid from (select page_id, url, topic, {NORM} as n from ({OWN}) o) x"""
query("valid_url", lambda v: U.valid_url(own(v), whitelist(v), SITE, BLOCKED).select("page_id", "valid"), f"with w as ({WHITE}) select page_id, valid from ({VALID}) y")
query(
    "sanitize_urls",
    lambda v: U.sanitize_urls(own(v).select(F.col("page_id").alias("qid"), F.concat(F.lit("see "), U.normalize_url(F.col("url"), SITE), F.lit(" and (https://www.example.com/cart) now")).alias("text")), whitelist(v), SITE, BLOCKED),
    rf"""with w as ({WHITE}), y as (select page_id, n, valid, regexp_matches(n, '^https?://(www\.)?{RE}') as own from ({VALID}) y)
select page_id as qid, 'see ' || case when own and not valid then 'https://{SITE}' else n
  end || ' and (https://{SITE}) now' as text, cast(1 + cast(own and not valid as int) as int) as n_replaced from y""",
)
query(
    "validate_sources",
    lambda v: U.validate_sources(own(v), whitelist(v), SITE, BLOCKED),
    f"with w as ({WHITE}) select page_id, topic, case when valid then url else 'https://{SITE}' end as url, valid as url_validated from ({VALID}) y",
)
query("url_topics", lambda v: U.url_topics(whitelist(v), "https://www.example.com/", SITE), f"select url, topics from ({WHITE}) w where url = 'https://{SITE}'")
query(
    "url_stats",
    lambda v: U.url_stats(whitelist(v)),
    f"select count(*) as urls, count(distinct split_part(url, '#', 1)) as base_urls, count(*) filter (where contains(url, '#')) as with_fragment from ({WHITE}) w",
)
query(
    "url_summary",
    lambda v: U.url_summary(v.chunks),
    "select url, count(*) as chunks, array_to_string(list_slice(list_sort(list(distinct topic)), 1, 5), ',') as some_topics, cast(count(distinct "
    "topic) as int) as topics from chunks group by 1 order by chunks desc, url limit 50",
    "chunks",
)
home = lambda v: v.chunks.withColumn("url", F.when(F.col("entry_id") % 4 == 0, "https://kb.example.org").otherwise(F.col("url")))
HOME = "select entry_id, topic, content, case when entry_id % 4 = 0 then 'https://kb.example.org' else url end as url from chunks"
query(
    "audit_homepage",
    lambda v: U.audit_homepage(home(v), "https://kb.example.org", ["rc11", "rc1", "7"]).select("entry_id", "topic", "term"),
    f"select entry_id, topic, case when contains(topic, 'rc11') then 'rc11' when contains(topic, 'rc1') then 'rc1' else '7' end as term from "
    f"({HOME}) h where url = 'https://kb.example.org' and (contains(topic, 'rc1') or contains(topic, '7'))",
    "chunks",
)
TOPIC_URLS = f"select topic, cast(count(distinct url) as int) as urls, string_agg(distinct url, ' ' order by url) as list from ({HOME}) h group by 1 having count(distinct url) > 2"
query("audit_topic_urls", lambda v: U.audit_topic_urls(home(v)), TOPIC_URLS, "chunks")
HINTS = [("/de/", ("und ", " der ")), ("/fr/", ("que ",)), ("/en/", ("the ",))]
MISMATCH = f"""select entry_id, url, page, words from (select entry_id, url, case when contains(t, 'und ') or contains(t, ' der ') then '/de/'
  when contains(t, 'que ') then '/fr/' when contains(t, 'the ') then '/en/' end as page,
  case when contains(t, 'und ') or contains(t, ' der ') then concat_ws(',', case when contains(t, 'und ') then 'und ' end, case
    when contains(t, ' der ') then ' der ' end) when contains(t, 'que ') then 'que ' when contains(t, 'the ') then 'the ' end as words
  from (select entry_id, url, lower(content) as t from ({HOME}) h) a) b where page is not null and not contains(url, page) and not contains(url, 'https://kb.example.org')"""
query("audit_url_mismatch", lambda v: U.audit_url_mismatch(home(v), HINTS, "https://kb.example.org").select("entry_id", "url", "page", "words"), MISMATCH, "chunks")
query(
    "audit_summary",
    lambda v: U.audit_summary(
        home(v),
        {"topics": U.audit_topic_urls(home(v)), "mismatch": U.audit_url_mismatch(home(v), HINTS, "https://kb.example.org")},
    ),
    f"select *, suspicious > 20 as alert from (select (select count(*) from ({HOME}) h) as chunks, (select count(distinct url) from ({HOME}) h) "
    f"as urls, (select count(*) from ({TOPIC_URLS}) t) + (select count(*) from ({MISMATCH}) m) as suspicious) x",
    "chunks",
)
