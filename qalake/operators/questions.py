"""Question normalisation, expansion and routing: columns in, columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalake.functions.rules import contains_any, first_match, keyword_class
from qalake.functions.text import count_of, word_list

from .dictionary import terms_in

#: Keyword classes of questions, first match first.
QUESTION_TYPES = (
    ("definitional", ("what is", "define", "explain")),
    ("procedural", ("how do", "how to", "how can")),
    ("rating_criteria", ("percentage", "%", "rating", "score")),
    ("comparison", ("compare", "difference", "vs", "versus")),
    ("eligibility", ("can i", "am i eligible", "qualify")),
    ("temporal", ("when", "how long", "timeline")),
)
#: Thresholds of the router.
GOOD_SCORE, HIGH_SCORE, STANDARD_SCORE, LOW_SCORE = 0.5, 0.6, 0.45, 0.35
SHORT_WORDS, STANDARD_WORDS = 10, 20
LARGE_CONTEXT, MANY_CHUNKS = 5000, 6


def expand_query(question: Column, codes: Sequence[tuple[str, str]], rules: Sequence[tuple[str, str]]) -> Column:
    """Codes get their names, and words their long forms unless those are there.

    codes: (number, name); a question of nothing but `what is code N` is asked anew. rules: (pattern, long form).
    """
    code = r"(?i)\b(?:dc|diagnostic\s*code)\s*(\d{4})\b"
    number = F.regexp_extract(question, code, 1)
    name = first_match([(number == n, label) for n, label in codes], "")
    full = F.concat(F.lit("Diagnostic Code "), number, F.when(name != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""))
    bare = question.rlike(r"(?i)^(what is |what's )?(dc\s*\d{4}|diagnostic\s*code\s*\d{4})\s*\??$")
    asked = F.concat(F.lit("What is Diagnostic Code "), number, F.when(name != "", F.concat(F.lit("? "), name, F.lit(". What are the rating criteria?"))).otherwise("? What condition does it cover?"))
    text = F.when(number == "", question).when(bare, asked).otherwise(F.regexp_replace(question, F.concat(F.lit(r"(?i)\b(?:dc|diagnostic\s*code)\s*"), number, F.lit(r"\b")), full))
    for pattern, long_form in rules:
        text = F.when(F.contains(text, F.lit(long_form)), text).otherwise(F.regexp_replace(text, "(?i)" + pattern, long_form))
    return text


def expand_terms(question: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """The longest term in the lower-cased question is replaced wherever it stands; the first of equal length. Else as it was."""
    lower = F.lower(question)
    ordered = sorted(terms, key=lambda t: -len(t[0]))
    cases = [(F.contains(lower, F.lit(t)), F.replace(lower, F.lit(t), F.lit(e))) for t, e in ordered]
    return first_match(cases, question) if cases else question


def related_terms(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """term, related: words of the term's own expansion, else of all expansions that contain it.

    dictionary: entry, expansion. Terms with an entry are looked up by equality; the others are found in the expansions by
    the index of grams, whatever their number.
    """
    words = dictionary.select("entry", "expansion", F.explode(word_list(F.lower("expansion"))).alias("word"))
    own = terms.join(words, F.lower("term") == F.col("entry")).select("term", "word")
    rest = terms.join(dictionary, F.lower("term") == F.col("entry"), "left_anti").select("term", F.lower("term").alias("low"))
    texts = dictionary.select(F.lower("expansion").alias("text")).distinct().select("text", F.col("text").alias("expansion"))
    held = terms_in(texts, rest.select(F.col("low").alias("term")), "expansion").withColumnRenamed("term", "low")
    other = held.join(rest, "low").select("term", F.explode(word_list("expansion")).alias("word"))
    return own.unionByName(other).distinct()


def question_type(question: Column, rules=QUESTION_TYPES) -> Column:
    return keyword_class(F.lower(question), rules, "general")


def question_features(question: Column, specific: Sequence[str]) -> list[Column]:
    return [F.size(word_list(question)).alias("n_words"), contains_any(F.lower(question), specific).alias("asks_specific"), count_of(question, "?").alias("n_marks")]


def route_question(questions: DataFrame, chunks: DataFrame, simple: Sequence[str], complex_: Sequence[str]) -> DataFrame:
    """qid, tier, reason. chunks: qid, score, chars; questions without any are routed with score 0."""
    seen = chunks.groupBy("qid").agg(F.sum("score").alias("total"), F.max("score").alias("best"), F.sum("chars").alias("chars"), F.count("*").alias("n"))
    q = questions.join(seen, "qid", "left").select(
        "qid",
        F.lower(F.trim("question")).alias("q"),
        F.size(word_list(F.col("question"))).alias("words"),
        count_of(F.col("question"), "?").alias("marks"),
        F.coalesce("best", F.lit(0.0)).alias("best"),
        F.coalesce("chars", F.lit(0)).alias("chars"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("total", F.lit(0.0)) / F.greatest("n", F.lit(1))).alias("mean"),
    )
    plain, hard = contains_any(F.col("q"), simple), contains_any(F.col("q"), complex_)
    rules = [
        (plain & (F.col("mean") >= GOOD_SCORE), "standard:simple_query_good_retrieval"),
        (F.col("best") >= HIGH_SCORE, "standard:high_confidence_retrieval"),
        (F.col("words") <= SHORT_WORDS, "standard:short_query"),
        (hard & ~plain, "premium:complex_query_detected"),
        ((F.col("words") <= STANDARD_WORDS) & (F.col("mean") >= STANDARD_SCORE), "standard:standard_faq_query"),
        ((F.col("chars") > LARGE_CONTEXT) & (F.col("n") > MANY_CHUNKS), "premium:large_context_synthesis"),
        ((F.col("marks") > 1) | contains_any(F.col("q"), (" and also ", " as well as ")), "premium:multi_part_query"),
        (F.col("mean") < LOW_SCORE, "premium:low_confidence_needs_reasoning"),
    ]
    choice = F.split(first_match(rules, "standard:default_standard"), ":")
    return q.select("qid", choice[0].alias("tier"), choice[1].alias("reason"))


def model_tier(model: Column, standard_marks: Sequence[str] = ("mini",)) -> Column:
    return F.when(contains_any(model, standard_marks), "standard").otherwise("premium")
