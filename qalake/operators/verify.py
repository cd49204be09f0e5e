"""Answers checked against the chunks that they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalake.functions.rules import first_match

SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
#: Words that say nothing about a claim.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can to of in for on with at by from as or and but if than "
    "because when where how all each every both few more most other some such no nor not only own same so too very just your their this that"
).split()
VERIFIED, SUSPICIOUS_RATE, REVIEW = 0.3, 0.3, 0.7
#: What counts as a code, a percentage, a span of time and an amount, since results depend on it.
CODE = r"\b(7\d{3})\b"
PERCENT, DURATION, MONEY = r"\b(\d+)(?:%|\s*percent)", r"(?i)\b(\d+)\s*(?:days?|months?|years?)\b", r"\$\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"
EMPTY = "cast(array() as array<string>)"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extract_citations(answers: DataFrame) -> DataFrame:
    """qid, pos, number, claim: the 10 to 100 characters before `[n]` or before superscript digits, which are read as one number."""
    bracket, raised = r"([^.!?\n]{10,100})\s*\[(\d+)\]", rf"([^.!?\n]{{9,99}}[^.!?\n{SUPERSCRIPTS}])([{SUPERSCRIPTS}]+)"
    # a claim never crosses the end of a sentence, so that only sentences with a mark are searched
    marked = F.filter(F.split("answer", r"[.!?]|\n(?!\s*\[\d)"), lambda s: s.rlike(rf"\[\d|[{SUPERSCRIPTS}]"))
    answers = answers.select("qid", F.array_join(marked, ".").alias("answer"))
    pairs = lambda p: F.arrays_zip(_all(F.col("answer"), p, 1).alias("claim"), _all(F.col("answer"), p, 2).alias("number"))
    rows = answers.select("qid", F.posexplode(F.concat(pairs(bracket), pairs(raised))).alias("pos", "c"))
    return rows.select("qid", "pos", F.translate("c.number", SUPERSCRIPTS, "0123456789").cast("int").alias("number"), F.trim("c.claim").alias("claim"))


def sources_part(text: Column) -> Column:
    """From the first Sources or References line on; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(?:\*\*)?(?:Sources|References):(?:\*\*)?(.*)$", 1)


def extract_source_refs(answers: DataFrame) -> DataFrame:
    """qid, number, title, url of source lines `n. [title](url)`, also with superscripts; the last of equal numbers."""
    pattern = rf"([0-9]+[.)]|[{SUPERSCRIPTS}]+)\s*\[([^\]]+)\]\(([^)]+)\)"
    part = sources_part(F.col("answer"))
    rows = answers.select("qid", F.posexplode(F.arrays_zip(_all(part, pattern, 1).alias("n"), _all(part, pattern, 2).alias("title"), _all(part, pattern, 3).alias("url"))).alias("pos", "s"))
    number = F.translate(F.regexp_replace("s.n", r"[.)]", ""), SUPERSCRIPTS, "0123456789").cast("int")
    return rows.groupBy("qid", number.alias("number")).agg(F.max_by("s.title", "pos").alias("title"), F.max_by("s.url", "pos").alias("url"))


def claim_support(claim: Column, chunk: Column) -> Column:
    """Share of the claim's significant words that the chunk contains; numbers, if there are any, weigh twice. 0.5 without words."""
    words = F.array_distinct(F.filter(_all(F.lower(claim), r"[\p{L}\p{N}_]+", 0), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))
    numbers = F.array_distinct(_all(claim, r"\d+%?", 0))
    share = lambda items, text: F.size(F.filter(items, lambda w: F.contains(text, w))) / F.size(items)
    parts = F.struct(words.alias("w"), numbers.alias("n"), F.lower(chunk).alias("low"))

    def support(p: Column) -> Column:
        found = share(p["w"], p["low"])
        return F.when(F.size(p["w"]) == 0, 0.5).when(F.size(p["n"]) > 0, (found + 2 * share(p["n"], chunk)) / 3).otherwise(found)

    return F.element_at(F.transform(F.array(parts), support), 1)  # words, numbers and the lower case are made once


def check_citations(answers: DataFrame, chunks: DataFrame, threshold: float = VERIFIED) -> DataFrame:
    """One row for each citation. chunks: qid, rank, text, url."""
    c = extract_citations(answers).join(extract_source_refs(answers).select("qid", "number", F.col("url").alias("cited_url")), ["qid", "number"], "left")
    c = c.join(chunks.select("qid", F.col("rank").alias("number"), "text", F.col("url").alias("chunk_url"), F.lit(True).alias("there")), ["qid", "number"], "left")
    # one column, so that the costly share is worked out once for each row
    c = c.withColumn("support", F.when(F.col("there"), claim_support(F.col("claim"), F.col("text"))).otherwise(0.0))
    support = F.col("support")
    issues = [
        F.when(F.col("cited_url").isNull(), "not_in_sources"), F.when(F.col("there").isNull(), "no_chunk"), F.when(F.col("there") & (support < threshold), "low_support"),
        F.when(F.col("cited_url") != F.col("chunk_url"), "url_mismatch"),
    ]
    return c.select(
        "qid",
        "pos",
        "number",
        F.round(support, 4).alias("confidence"),
        (F.coalesce("there", F.lit(False)) & (support >= threshold)).alias("verified"),
        F.concat_ws(",", *issues).alias("issues"),
    )


def verify_citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each answer: citations, verified and suspicious ones, score (1 without citations), flags."""
    rows = check_citations(answers, chunks).groupBy("qid").agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.max("number").alias("highest"))
    k = chunks.groupBy("qid").agg(F.max("rank").alias("chunks"))
    t = answers.select("qid").join(rows, "qid", "left").join(k, "qid", "left").select(
        "qid",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("verified", F.lit(0)).alias("verified"),
        (F.coalesce("highest", F.lit(0)) > F.coalesce("chunks", F.lit(0))).alias("beyond_chunks"),
    )
    score = F.when(F.col("total") > 0, F.round(F.col("verified") / F.col("total"), 4)).otherwise(F.lit(1.0))
    return t.select(
        "*",
        (F.col("total") - F.col("verified")).alias("suspicious"),
        score.alias("score"),
        (F.col("total") - F.col("verified") > F.col("total") * SUSPICIOUS_RATE).alias("many_suspicious"),
        (score < REVIEW).alias("review"),
    )


def verification_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count("*").alias("answers"),
        F.sum("total").alias("citations"),
        F.sum("verified").alias("verified"),
        F.sum("suspicious").alias("suspicious"),
        F.count_if("review").alias("reviews"),
        F.round(F.avg("score"), 4).alias("mean_score"),
    )


def _figures(text: Column) -> list[Column]:
    low = F.lower(text)
    return [
        F.array_distinct(_all(low, PERCENT, 1)).alias("percents"),
        F.array_distinct(_all(text, CODE, 1)).alias("codes"),
        F.array_distinct(_all(text, DURATION, 1)).alias("durations"),
        F.array_distinct(_all(text, MONEY, 1)).alias("sums"),
    ]


def verify_numbers(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Percentages, codes, and specifics (durations, sums of money) of an answer that none of its chunks has, each kind held against
    its own: thirty days are not found in thirty dollars. Only figures are gathered, not texts."""
    own = answers.select("qid", *_figures(F.col("answer")))
    kinds = ("percents", "codes", "durations", "sums")
    seen = chunks.select("qid", *_figures(F.col("text"))).groupBy("qid").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(f"in_{c}") for c in kinds])
    odd = [F.array_except(c, F.coalesce(f"in_{c}", F.expr(EMPTY))).alias(c) for c in kinds]
    rows = own.join(seen, "qid", "left").select("qid", *odd).withColumn("specifics", F.concat("durations", "sums"))
    lists = [F.concat_ws(",", F.array_sort(c)).alias(c) for c in ("percents", "codes", "specifics")]
    return rows.select("qid", *lists, ((F.size("percents") + F.size("codes") + F.size("specifics")) == 0).alias("is_clean"))


def clean_citations(text: Column, k: Column) -> Column:
    """Without citations outside 1 to k, and without the lines of such sources."""
    number = lambda m: F.translate(F.regexp_replace(m, r"[\[\]]", ""), SUPERSCRIPTS, "0123456789").cast("int")
    marks = F.array_distinct(F.concat(_all(text, r"\[\d+\]", 0), _all(text, rf"[{SUPERSCRIPTS}]+", 0)))
    bad = F.reverse(F.array_sort(F.filter(marks, lambda m: (number(m) > k) | (number(m) < 1))))
    part = sources_part(text)
    body = F.when(part == "", text).otherwise(F.left(text, F.length(text) - F.length(part)))
    kept = F.filter(F.split(part, "\n"), lambda line: ~F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(line, r"^\s*(\d+)[.)]", 1), F.lit("")), F.lit("999999")).cast("int") > k, F.lit(False)))
    whole = F.when(part == "", body).otherwise(F.concat(body, F.array_join(kept, "\n")))
    return F.aggregate(bad, whole, lambda t, m: F.replace(t, m, F.lit("")))


WARNING = "Some figures could not be checked. "


def sanitize_answers(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Answers with invalid citations taken out and, where figures could not be found, one warning before them."""
    k = chunks.groupBy("qid").agg(F.max("rank").alias("k"))
    numbers = verify_numbers(answers, chunks).select("qid", "is_clean")
    rows = answers.join(k, "qid", "left").join(numbers, "qid").withColumn("clean", clean_citations(F.col("answer"), F.coalesce("k", F.lit(0))))
    text = F.when(F.col("is_clean") | F.col("clean").startswith(WARNING), F.col("clean")).otherwise(F.concat(F.lit(WARNING), "clean"))
    return rows.select("qid", text.alias("answer"), F.length("answer").alias("before"), F.length(text).alias("after"), "is_clean")


def confidence_gate(quality: DataFrame, refuse: float = 0.45, warn: float = 0.50, flag: float = 0.55) -> DataFrame:
    b = F.col("best")
    return quality.select("qid", "best", first_match([(b.isNull(), "no_context"), (b < refuse, "refuse"), (b < warn, "warn"), (b < flag, "flag")], "accept").alias("decision"))


def score_bands(retrieved: DataFrame, edges=(0.45, 0.50, 0.55)) -> DataFrame:
    s = F.col("score")
    band = first_match([(s < e, n) for e, n in zip(edges, ("refuse", "warn", "flag"), strict=True)], "accept")
    return retrieved.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))
