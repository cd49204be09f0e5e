"""Corpus preparation: cleaning, splitting, packing, classification and enrichment of documents (doc_id, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qalake.functions.rules import first_match, first_rule_value, fold_pack, keyword_class, rewrite
from qalake.functions.text import estimate_tokens

MAX_CHARS, MAX_TOKENS, TOO_LARGE, MIN_SECTION, MIN_ANSWER, MIN_CHUNK = 2000, 1500, 2000, 100, 20, 20
#: Comments, empty brackets, rules of stars, spaces before line ends, many blank lines.
CLEAN_RULES = ((r"(?s)<!--.*?-->", ""), (r"\[\s*\]|\(\s*\)", ""), (r"(\* \* \*\s*){2,}", "---\n\n"), (r"\* \* \*", "---"), (r"[ \t]+\n", "\n"), (r"\n{4,}", "\n\n\n"))
#: Coded headings, numbered questions, and boundaries of large texts.
SUBSECTION, QUESTION, BOUNDARY = r"###\s+\*{0,4}\d+\.[A-Za-z]+\.\d+\.[a-z]", r"(?:# |\n)\d+\.\s*Q:", r"\n\* \* \*\n|\n---\n|\n\|\s*\*\*Step\*\*"
DROPPED_SECTIONS = ("Frequently Asked Questions", "References", "See Also")


def clean_text(text: Column, rules: Sequence[tuple[str, str]] = CLEAN_RULES) -> Column:
    return F.regexp_replace(rewrite(text, rules), r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def strip_navigation(text: Column, skip: str, after: int = 30) -> Column:
    """Lines from the first title (or a heading after line `after`) on, without those that match skip."""
    lines = lines_of(text)
    begins = F.filter(
        F.transform(lines, lambda x, i: F.when(F.trim(x).startswith("# ") | (F.trim(x).startswith("## ") & (i > after)), i)),
        lambda i: i.isNotNull(),
    )
    first = F.coalesce(F.get(begins, F.lit(0)), F.lit(0))
    return F.array_join(F.filter(lines, lambda x, i: (i >= first) & ~F.trim(x).rlike(skip)), "\n")


MARKER = r"<!-- Chunk (\d+)/(\d+) \| Heading: ?(.*?) ?\| Words: (\d+) -->"


def split_markers(docs: DataFrame, least: int = MIN_CHUNK) -> DataFrame:
    """doc_id, pos, number, total, heading, words, content: the text before a marker is the marker's."""
    group = lambda i: F.regexp_extract_all("text", F.lit(MARKER), F.lit(i))
    parts = docs.select(
        "doc_id",
        F.arrays_zip(
            F.slice(F.split("text", MARKER), F.lit(1), F.size(group(1))).alias("content"),
            group(1).alias("number"),
            group(2).alias("total"),
            group(3).alias("heading"),
            group(4).alias("words"),
        ).alias("p"),
    )
    rows = parts.select("doc_id", F.posexplode("p").alias("pos", "p"))
    rows = rows.select(
        "doc_id",
        "pos",
        F.col("p.number").cast("int").alias("number"),
        F.col("p.total").cast("int").alias("total"),
        F.trim("p.heading").alias("heading"),
        F.col("p.words").cast("int").alias("words"),
        F.regexp_replace("p.content", r"^\s+|\s+$", "").alias("content"),
    )
    return rows.filter(F.length("content") >= least)


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "")


def heading_of(section: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(section, r"^## ([^\n]*)", 1), r"\*\*", ""))


def split_headings(docs: DataFrame, least: int = MIN_SECTION, dropped: Sequence[str] = DROPPED_SECTIONS) -> DataFrame:
    """doc_id, pos, heading, anchor, content: sections at `##`, without short and dropped ones."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", r"\n(?=## )")).alias("pos", "content"))
    rows = rows.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).withColumn("heading", heading_of(F.col("content")))
    rows = rows.filter((F.length("content") >= least) & ~F.col("heading").isin(*dropped))
    return rows.select("doc_id", "pos", "heading", slug(F.col("heading")).alias("anchor"), "content")


def extract_section(text: Column, name: str) -> Column:
    """One section, without its heading, up to the next; empty if there is none."""
    return F.regexp_extract(text, rf"(?s)(?:^|\n)## (?:\*\*)?{name}(?:\*\*)?\n(.*?)(?:\n## |\z)", 1)


def extract_faq(docs: DataFrame, section: str = "Frequently Asked Questions", least: int = MIN_ANSWER) -> DataFrame:
    """doc_id, pos, question, answer: items `- #### question` and the lines after them."""
    items = F.split(F.concat(F.lit("\n"), extract_section(F.col("text"), section)), r"\n- #### ")
    rows = docs.select("doc_id", F.posexplode(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))).alias("pos", "item"))
    answer = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("item", r"(?s)^[^\n]*\n(.*)$", 1), r"^\s*- ", ""), r"\n\n+", "\n\n"))
    rows = rows.select("doc_id", "pos", F.trim(F.regexp_extract("item", r"^([^\n]*)", 1)).alias("question"), answer.alias("answer"))
    return rows.filter((F.col("question") != "") & (F.length("answer") > least))


def build_chunks(docs: DataFrame, base: str) -> DataFrame:
    """entry_id, type, heading, url, content of a document's questions, references and sections. docs: doc_id, text, source."""
    key = docs.select("doc_id", "source")
    anchored = lambda anchor: F.concat(F.lit(base), F.col("source"), F.lit("#"), anchor)
    faq = extract_faq(docs).join(key, "doc_id").select(
        F.concat_ws("-", "doc_id", F.lit("faq"), F.col("pos") + 1).alias("entry_id"),
        F.lit("faq").alias("type"),
        F.col("question").alias("heading"),
        anchored(F.lit("faq")).alias("url"),
        F.col("answer").alias("content"),
    )
    ref = docs.select("doc_id", "source", F.trim(extract_section(F.col("text"), "References")).alias("content")).filter("content <> ''")
    ref = ref.select(
        F.concat_ws("-", "doc_id", F.lit("references")).alias("entry_id"),
        F.lit("reference").alias("type"),
        F.lit("References").alias("heading"),
        anchored(F.lit("references")).alias("url"),
        "content",
    )
    part = split_headings(docs).join(key, "doc_id").select(
        F.concat_ws("-", "doc_id", F.lit("section"), F.col("pos") + 1).alias("entry_id"),
        F.lit("section").alias("type"),
        "heading",
        anchored(F.col("anchor")).alias("url"),
        "content",
    )
    return faq.unionByName(ref).unionByName(part)


def _packed(docs: DataFrame, separator: str, limit: int, size, joint: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", separator), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(fold_pack(parts, F.lit(limit), size, joint)).alias("pos", "content"))


def pack_parts(docs: DataFrame, separator: str = r"\n\n", limit: int = MAX_CHARS, tokens: bool = False, joint: str = "\n\n") -> DataFrame:
    """doc_id, pos, content: parts packed greedily up to a limit of characters or of tokens."""
    return _packed(docs, separator, limit, estimate_tokens if tokens else F.length, joint)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_subsections(docs: DataFrame, limit: int = MAX_TOKENS, heading: str = SUBSECTION) -> DataFrame:
    """doc_id, pos, sub, content: cut before coded headings; parts above twice the limit by paragraphs, documents with less than two such headings by rules.

    Text before the first heading is a part of its own.
    """
    many = F.regexp_count("text", F.lit(heading)) > 1
    by_rule = _packed(docs.filter(~many), r"\n\* \* \*\n|\n---\n", limit, estimate_tokens, "\n\n").withColumn("sub", F.lit(0))
    parts = F.filter(F.transform(F.split("text", f"(?={heading})"), strip), lambda x: x != "")
    rows = docs.filter(many).select("doc_id", F.posexplode(parts).alias("pos", "text"))
    paragraphs = F.filter(F.transform(F.split("text", r"\n\n+"), strip), lambda x: x != "")
    own = F.when(estimate_tokens(F.col("text")) > 2 * limit, fold_pack(paragraphs, F.lit(limit), estimate_tokens)).otherwise(F.array("text"))
    packed = rows.select("doc_id", "pos", F.posexplode(own).alias("sub", "content"))
    return by_rule.select("doc_id", "pos", "sub", "content").unionByName(packed)


def pieces(text: Column, chars: int) -> Column:
    """Parts of at most `chars` characters that make up the whole text, cut at white space where there is any."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{chars}}}(?:(?<=\s)|(?=\s)|\z)|.{{1,{chars}}}"), F.lit(0))


def split_qa(docs: DataFrame, limit: int = MAX_TOKENS, chars: int | None = None, question: str = QUESTION) -> DataFrame:
    """doc_id, pos, content: texts cut before numbered questions; one above the limit stands alone, the others are packed.

    One that stands alone is not cut off: it is as many rows as its text needs, of at most `chars` characters each (four for
    each token of the limit). They come before the packed ones.
    """
    parts = F.filter(F.transform(F.split("text", rf"\n(?={question})"), strip), lambda x: x != "")
    large = lambda x: estimate_tokens(x) > limit
    alone = F.filter(F.transform(F.flatten(F.transform(F.filter(parts, large), lambda x: pieces(x, chars or 4 * limit))), strip), lambda x: x != "")
    packed = fold_pack(F.filter(parts, lambda x: ~large(x)), F.lit(limit), estimate_tokens)
    return docs.select("doc_id", F.posexplode(F.concat(alone, packed)).alias("pos", "content"))


def split_large(docs: DataFrame, least: int = MIN_SECTION, chars: int = 6000, boundary: str = BOUNDARY) -> DataFrame:
    """doc_id, pos, sub, content: cut at rules and step rows, parts over `least` characters; texts without such a boundary whole.

    One above `chars` is several rows.
    """
    parts = F.split("text", boundary)
    alone = F.size(parts) == 1
    rows = docs.select("doc_id", alone.alias("alone"), F.posexplode(F.when(alone, parts).otherwise(F.transform(parts, strip))).alias("pos", "content"))
    return rows.filter(F.col("alone") | (F.length("content") > least)).select("doc_id", "pos", F.posexplode(pieces(F.col("content"), chars)).alias("sub", "content"))


def repair_oversized(chunks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """entry_id, part, sub, content: chunks above the limit by the strategy that their id or topic asks for; the others as they are.

    What rules leave above the limit is packed by lines.
    """
    kind = F.when(F.contains(F.lower("topic"), F.lit("faq")), "qa").when(F.regexp_count("content", F.lit(SUBSECTION)) > 1, "subsections").otherwise("rules")
    strategy = F.when(estimate_tokens(F.col("content")) <= limit, "keep").otherwise(kind)
    rows = chunks.select(F.col("entry_id").alias("doc_id"), F.col("content").alias("text"), strategy.alias("strategy"))
    own = lambda s: rows.filter(F.col("strategy") == s)
    zero = F.lit(0).alias("sub")
    keep = own("keep").select("doc_id", F.lit(0).alias("part"), zero, F.col("text").alias("content"))
    qa = split_qa(own("qa"), limit).select("doc_id", F.col("pos").alias("part"), zero, "content")
    sub = split_subsections(own("subsections"), limit).select("doc_id", F.col("pos").alias("part"), "sub", "content")
    lines = F.filter(F.transform(F.split("content", r"\n+"), strip), lambda x: x != "")
    ruled = split_subsections(own("rules"), limit).withColumn("packs", F.when(estimate_tokens(F.col("content")) > limit, fold_pack(lines, F.lit(limit), estimate_tokens, "\n")).otherwise(F.array("content")))
    ruled = ruled.select("doc_id", F.col("pos").alias("part"), F.posexplode("packs").alias("sub", "content"))
    return keep.unionByName(qa).unionByName(sub).unionByName(ruled).withColumnRenamed("doc_id", "entry_id")


def oversized(chunks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    return chunks.select("entry_id", F.length("content").alias("chars"), estimate_tokens(F.col("content")).alias("tokens")).filter(F.col("tokens") > limit)


def oversized_report(chunks: DataFrame, limit: int = TOO_LARGE) -> DataFrame:
    t = estimate_tokens(F.col("content"))
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(t > limit).alias("too_large"), F.max(t).alias("largest"), F.count_if(F.col("url").isNull() | (F.col("url") == "")).alias("missing_url"))


def repair_schema(chunks: DataFrame, urls: Sequence[tuple[str, str]], home: str) -> DataFrame:
    """One url column for two spellings; a missing one by the id's prefix, first rule first; missing types are `general`."""
    known = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("url", "source_url") if c in chunks.columns])
    by_id = first_match([(F.col("entry_id").cast("string").startswith(p), u) for p, u in urls], home)
    return chunks.withColumn("url", F.coalesce(known, by_id)).withColumn("type", F.coalesce("type", F.lit("general"))).drop("source_url")


def chunk_type(heading: Column, content: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "general") -> Column:
    """The first rule with a keyword in the heading, else the first with one in the content."""
    return F.coalesce(keyword_class(F.lower(heading), rules, None), keyword_class(F.lower(content), rules, None), F.lit(default))


def heading_code(heading: Column) -> Column:
    """Codes of four digits and a letter perhaps, that lead a heading; several joined by commas."""
    lead = F.regexp_extract(heading, r"^\s*(\d{4}[a-z]?(?:\s*[,/-]\s*\d{4}[a-z]?)*)", 1)
    return F.nullif(F.regexp_replace(lead, r"\s*[,/-]\s*", ","), F.lit(""))


def heading_name(heading: Column) -> Column:
    """A heading without codes and what stands in brackets at its end."""
    bare = F.regexp_replace(heading, r"^\s*\d{4}[a-z]?(?:\s*[,/-]\s*\d{4}[a-z]?)*[\s:.-]*", "")
    return F.trim(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", ""))


def subtopic(heading: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return first_rule_value(F.lower(heading), rules)


def carry_parent(rows: DataFrame, main: Column) -> DataFrame:
    """Rows (doc_id, pos, heading) with the last main heading before them; null where it is their own."""
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    parent = F.last(F.when(main, F.col("heading")), ignorenulls=True).over(w)
    return rows.withColumn("parent", F.when(parent != F.col("heading"), parent))


def assign_ids(rows: DataFrame, prefix: str = "chunk") -> DataFrame:
    """Ids of a document and a running number within it; a code leads the id where there is one. No order over all rows."""
    w = W.partitionBy("doc_id").orderBy("pos")
    number = F.row_number().over(w)
    return rows.withColumn("entry_id", F.concat_ws("-", F.coalesce("code", F.lit(prefix)), "doc_id", F.lpad(number.cast("string"), 4, "0")))


def infer_url(heading: Column, content: Column, rules: Sequence[tuple[str, str]], own_link: str, home: str) -> Column:
    """The url of the first keyword in the heading, else in the content, else the first own link, else home."""
    link = F.nullif(F.regexp_extract(content, own_link, 0), F.lit(""))
    return F.coalesce(first_rule_value(F.lower(heading), rules), first_rule_value(F.lower(content), rules), link, F.lit(home))


def add_aliases(chunks: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Aliases of all rules whose keyword is in id or topic, with those there were; distinct and sorted."""
    where = F.lower(F.concat_ws(" ", F.col("entry_id").cast("string"), "topic"))
    more = F.flatten(F.array(*[F.when(F.contains(where, F.lit(k)), F.array(*map(F.lit, names))).otherwise(F.expr("cast(array() as array<string>)")) for k, names in rules]))
    return chunks.withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), more)))


def chunk_type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("topic").alias("topics")).orderBy(F.desc("n"), "type")
