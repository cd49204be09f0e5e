"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs; it is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.llm.decontamination import decontaminate
from qalake.llm.exact_dedup import exact_dedup
from qalake.llm.jaccard_join import jaccard_join
from qalake.llm.mixing import mix_sources
from qalake.llm.shared import cut, read, text_tie, whole_texts
from qalake.llm.toxicity import HELD_OUT, fold_in, train, without_toxic
from qalake.session import ship


def _chosen(rows: DataFrame) -> DataFrame:
    """Distinct pairs of doc_id and tie (the text's hash), with the number of rows that have them."""
    return rows.groupBy("doc_id", "tie").agg(F.count("*").alias("rows"))


def _matched(docs: DataFrame, chosen: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose id (null is one) and text are chosen."""
    chosen = chosen.withColumnsRenamed({"doc_id": "chosen_id", "tie": "chosen_tie"})
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["chosen_id"]) & (text_tie(docs["text"]) == chosen["chosen_tie"]), how)


def _one_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of docs whose id and text are chosen; one row of those that repeat both. chosen: as _chosen() gives it."""
    chosen = cut(chosen, "chosen")
    kept = _matched(docs, chosen.drop("rows"))
    repeated = chosen.filter("rows > 1")
    if repeated.isEmpty():
        return kept
    tie = next(c for c in (f"tie{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    once = _matched(docs, repeated.drop("rows")).withColumn(tie, text_tie(F.col("text"))).dropDuplicates(["doc_id", tie]).drop(tie)
    return _matched(docs, chosen.filter("rows = 1").drop("rows")).unionByName(once)


# The rules of all stages: a null text is empty, and a text of any length is read whole; a null id is an id; a row is told
# by its id and its text, so that rows of one id with different texts are judged by themselves; further columns are
# passed on, whatever their names; an empty table stays empty. Where a stage keeps one of several rows, it keeps one of
# rows that repeat id and text, any of them if they differ elsewhere.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted toxic, by a model of the labelled ones (those not held out).

    Equal texts share their fate; repeated rows are kept or dropped together. Texts without words are kept unless the
    labelled share of toxic texts is the threshold or more.
    """
    ship(spark)
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return without_toxic(docs, train(whole_texts(docs), labels.filter(~fold_in(F.col("doc_id"), *HELD_OUT))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; one row, if several have that id. Null and empty texts are equal."""
    ship(spark)
    kept = exact_dedup(docs).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows")).select(F.col("doc_id").alias("chosen_id"), "text_sha256", "rows")
    kept = cut(kept, "chosen")
    sha = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    # null and empty texts of one id are equal, but only one of them is kept
    if kept.filter("rows > 1").isEmpty():
        return docs.join(kept, docs["doc_id"].eqNullSafe(kept["chosen_id"]) & (sha == kept["text_sha256"]), "left_semi")
    chosen = docs.join(kept, docs["doc_id"].eqNullSafe(kept["chosen_id"]) & (sha == kept["text_sha256"]), "left_semi")
    return _one_each(docs, _chosen(chosen.select("doc_id", text_tie(F.col("text")).alias("tie"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id; one row, if several repeat its id and text."""
    ship(spark)
    return _one_each(docs, _chosen(jaccard_join(docs).filter("first")))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are contaminated by the benchmark; repeated rows are kept or dropped together."""
    ship(spark)
    return _matched(docs, _chosen(decontaminate(docs, read(spark, sf_dir, "benchmark")).filter("not contaminated")).drop("rows"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies, and their sources' sizes and targets.

    Rows that repeat id, text and source come out as one, with the sum of their copies. Columns of docs called size, source_size,
    target, copies or taken give way to the stage's own.
    """
    ship(spark)
    own = ["size", "source_size", "target", "copies", "taken"]
    mixed = mix_sources(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("tie").alias("text_hash"))
    mixed = cut(mixed.agg(*[F.max(c).alias(c) for c in own[:3]], *[F.sum(c).alias(c) for c in own[3:]], F.count("*").alias("rows")), "mixed")
    columns = [docs[c] for c in docs.columns if c not in own]
    same = docs["doc_id"].eqNullSafe(mixed["id"]) & docs["source"].cast("string").eqNullSafe(mixed["of"]) & (F.xxhash64(docs["text"]) == mixed["text_hash"])
    out = docs.join(mixed, same).select(*columns, *[mixed[c] for c in own])
    return out if mixed.filter("rows > 1").isEmpty() else out.dropDuplicates(["doc_id", "text", "source"])


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", contamination), ("mixing sources to target weights", mixing)]
#: Neither the models' scores nor the random rounding can be said in SQL; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents; what the last one keeps."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
