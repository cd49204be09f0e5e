"""Url checks and the audit of chunk urls. The own site is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalake.functions.rules import contains_any, first_match


def normalize_url(url: Column, site: str) -> Column:
    """Absolute, https and without www on the own site, no slash at the end."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.when(u.startswith("/"), F.concat(F.lit(f"https://{site}"), u)).otherwise(u)
    u = F.regexp_replace(u, rf"^https?://(?:www\.)?({site.replace('.', chr(92) + '.')})", "https://$1")
    return F.regexp_replace(u, "/+$", "")


def without_fragment(url: Column) -> Column:
    return F.element_at(F.split(url, "#"), 1)


def blocked_url(url: Column, site: str, blocked: Sequence[str]) -> Column:
    """Is the path of an own url in the block list? Empty urls are blocked."""
    path = F.lower(without_fragment(F.regexp_extract(url, rf"{site.replace('.', chr(92) + '.')}/(.*)$", 1)))
    return F.when(F.coalesce(url, F.lit("")) == "", True).otherwise(path.isin(*blocked))


def url_whitelist(chunks: DataFrame, site: str) -> DataFrame:
    """Distinct urls with their topics, and the home url."""
    known = chunks.select(normalize_url(F.col("url"), site).alias("url"), "topic").filter("url <> ''")
    home = known.sparkSession.range(1).select(F.lit(f"https://{site}").alias("url"), F.lit("home").alias("topic"))
    return known.unionByName(home).groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"))


def valid_url(urls: DataFrame, whitelist: DataFrame, site: str, blocked: Sequence[str]) -> DataFrame:
    """Rows (url, ...) with valid: known, known without its fragment, or an own one that is not blocked."""
    known = whitelist.select(F.col("url").alias("known")).distinct()
    rows = urls.withColumn("__n", normalize_url(F.col("url"), site)).withColumn("__b", without_fragment(F.col("__n")))
    rows = rows.join(known.select(F.col("known").alias("__k1")), F.col("__n") == F.col("__k1"), "left").join(known.select(F.col("known").alias("__k2")), F.col("__b") == F.col("__k2"), "left")
    own = F.contains(F.col("__n"), F.lit(site)) & ~blocked_url(F.col("__n"), site, blocked)
    valid = (F.coalesce("url", F.lit("")) != "") & (F.col("__k1").isNotNull() | F.col("__k2").isNotNull() | own)
    return rows.withColumn("valid", valid).drop("__n", "__b", "__k1", "__k2")


def sanitize_urls(texts: DataFrame, whitelist: DataFrame, site: str, blocked: Sequence[str]) -> DataFrame:
    """qid, text, n_replaced: own urls that are not valid become the home url. texts: qid, text."""
    pattern = rf"https?://(?:www\.)?{site.replace('.', chr(92) + '.')}[^\s\)\]\"'<>]*"
    found = texts.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("url"))
    bad = valid_url(found, whitelist, site, blocked).filter("not valid").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.length("url").alias("n"), "url")), asc=False).alias("bad"))
    rows = texts.join(bad, "qid", "left")
    clean = F.aggregate(F.coalesce("bad", F.expr("cast(array() as array<struct<n:int,url:string>>)")), F.col("text"), lambda t, b: F.replace(t, b["url"], F.lit(f"https://{site}")))
    return rows.select("qid", clean.alias("text"), F.coalesce(F.size("bad"), F.lit(0)).alias("n")).select("qid", "text", F.greatest("n", F.lit(0)).alias("n_replaced"))


def validate_sources(sources: DataFrame, whitelist: DataFrame, site: str, blocked: Sequence[str]) -> DataFrame:
    """Source rows with url_validated, and the home url in the place of invalid ones."""
    rows = valid_url(sources, whitelist, site, blocked)
    return rows.withColumn("url", F.when(F.col("valid"), F.col("url")).otherwise(f"https://{site}")).withColumnRenamed("valid", "url_validated")


def url_topics(whitelist: DataFrame, url: str, site: str) -> DataFrame:
    return whitelist.filter(F.col("url") == normalize_url(F.lit(url), site))


def url_stats(whitelist: DataFrame) -> DataFrame:
    return whitelist.agg(F.count("*").alias("urls"), F.countDistinct(without_fragment(F.col("url"))).alias("base_urls"), F.count_if(F.contains("url", F.lit("#"))).alias("with_fragment"))


def url_summary(chunks: DataFrame, n: int = 50, topics: int = 5) -> DataFrame:
    table = chunks.groupBy("url").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_set("topic")).alias("t"))
    return table.select("url", "chunks", F.array_join(F.slice("t", 1, topics), ",").alias("some_topics"), F.size("t").alias("topics")).orderBy(F.desc("chunks"), "url").limit(n)


def audit_homepage(chunks: DataFrame, home: str, specific: Sequence[str]) -> DataFrame:
    """Chunks on the home url whose topic has a term that needs a page of its own; the first such term."""
    term = first_match([(F.contains(F.lower("topic"), F.lit(t)), t) for t in specific])
    return chunks.filter(F.col("url") == home).withColumn("term", term).filter("term is not null")


def audit_topic_urls(chunks: DataFrame, more_than: int = 2) -> DataFrame:
    """Topics with more than so many urls."""
    return chunks.groupBy("topic").agg(F.array_sort(F.collect_set("url")).alias("u")).filter(F.size("u") > more_than).select("topic", F.size("u").alias("urls"), F.array_join("u", " ").alias("list"))


def audit_url_mismatch(chunks: DataFrame, hints: Sequence[tuple[str, Sequence[str]]], home: str, strict: bool = False) -> DataFrame:
    """Chunks whose content speaks of a page (the first whose keywords it has) that is not in their url.

    Urls that contain the home url are passed over, as long as strict is off.
    """
    text = F.lower("content")
    page = first_match([(contains_any(text, words), name) for name, words in hints])
    words = first_match([(contains_any(text, w), F.array_join(F.filter(F.array(*[F.when(F.contains(text, F.lit(x)), F.lit(x)) for x in w]), lambda x: x.isNotNull()), ",")) for _, w in hints])
    rows = chunks.withColumn("page", page).withColumn("words", words).filter("page is not null").filter(~F.contains("url", F.col("page")))
    return rows if strict else rows.filter(~F.contains("url", F.lit(home)))


def audit_summary(chunks: DataFrame, audits: dict[str, DataFrame], alert: int = 20) -> DataFrame:
    """Chunks, urls, suspicious rows of all audits, and whether they are more than may be."""
    found = None
    for name, rows in audits.items():
        own = rows.select(F.lit(name).alias("audit"))
        found = own if found is None else found.unionByName(own)
    table = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("url").alias("urls")).crossJoin(found.agg(F.count("*").alias("suspicious")))  # one row each
    return table.withColumn("alert", F.col("suspicious") > alert)
