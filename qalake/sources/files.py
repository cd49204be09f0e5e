"""Readers and writers of corpora, questions and results."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from qalake.session import stored

CHUNK = "source_id string, entry_id string, topic string, subtopic string, type string, original_heading string, url string, source_url string, diagnostic_code string, parent_topic string, last_updated string, content string, aliases array<string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON arrays, with an id and content; of equal ids the last in file order."""
    rows = spark.read.schema(CHUNK).option("multiLine", True).json(path).filter("entry_id is not null and content is not null and content <> ''")
    rows = rows.withColumn("__file", F.col("_metadata.file_name")).withColumn("__place", F.monotonically_increasing_id())
    w = W.partitionBy("entry_id").orderBy(F.desc("__file"), F.desc("__place"))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__file", "__place")


#: Files of a folder; bytes that a task reads, and that it hands over at once: all of them about.
FILES, TASK_BYTES, BATCH_BYTES = 2000, 64 << 20, 4 << 20


def _hidden(name: str) -> bool:
    """Names that Spark's own readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """place, size of all files below a folder, or of one file; hidden ones are left out.

    Folders are listed by tasks, level by level, and what they find is a table: the driver holds no file's name. A task holds
    the names of one folder at a time.
    """
    store, root = fs.FileSystem.from_uri(path)
    top = store.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if top.is_file:
        return spark.createDataFrame([(root, top.size)], "place string, size long")

    def work(batches):
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for place in batch.column("place").to_pylist():
                found = [x for x in store.get_file_info(fs.FileSelector(place)) if not _hidden(x.base_name)]
                for i in range(0, len(found), FILES):
                    own = found[i : i + FILES]
                    columns = [pa.array([x.path for x in own], pa.string()), pa.array([x.size for x in own], pa.int64()), pa.array([not x.is_file for x in own], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=["place", "size", "inner"])

    folders, n, levels = spark.createDataFrame([(root,)], "place string"), 1, []
    while n:
        found = stored(folders.repartition(min(n, 64 + n // FILES), "place").mapInArrow(work, "place string, size long, inner boolean"), "listing")
        levels.append(found.filter("not inner").select("place", "size"))
        folders = found.filter("inner").select("place")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels)


def read_documents(spark: SparkSession, path: str, about: DataFrame, least: int = 100) -> DataFrame:
    """Whole text files with what is known about them (file, ...); those shorter than `least` are left out.

    A file goes by its name; in folders `name=...`, by the folder's. There may be as many folders as files. Spark's reader would
    list all files in the driver and plan tasks of a few files; here tasks list them, names are joined with what is known, and
    only then are files read, about FILES or TASK_BYTES by each task: texts are not shuffled.
    """
    listed = list_files(spark, path)
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    name = F.coalesce(F.nullif(F.regexp_extract("place", r"/name=([^/]+)/", 1), F.lit("")), F.substring_index("place", "/", -1))
    known = listed.select(name.alias("file"), F.col("place").alias("__place")).join(about, "file", "left")

    def work(batches):
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            first, held, total = 0, [], 0
            for i, place in enumerate(batch.column("__place").to_pylist()):
                with store.open_input_stream(place) as file:
                    held.append(file.read())
                total += len(held[-1])
                if total >= BATCH_BYTES or i + 1 == batch.num_rows:
                    own = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(held, pa.binary())], names=[*own.schema.names, "content"])
                    first, held, total = i + 1, [], 0

    dealt = known.repartition(max(1, -(-n // FILES), -(-size // TASK_BYTES)), "__place")
    rows = dealt.mapInArrow(work, T.StructType([*known.schema.fields, T.StructField("content", T.BinaryType())]))
    out = rows.select("file", F.col("content").cast("string").alias("content"), *[c for c in about.columns if c != "file"])
    return out.filter(F.length("content") >= least)


def write_documents(documents: DataFrame, path: str) -> None:
    """A text file for each document (file: its name, content), in folders of about FILES, a task for each.

    Spark's writer would have a folder, a checksum and, on a local file system, some processes for each file. Tasks open files by
    Arrow's file systems, and a task that runs again writes the same ones. Of a name that comes again in a folder, the
    file goes to a folder beside it.
    """
    tasks = max(1, -(-documents.count() // FILES))

    def work(batches):
        store, root = fs.FileSystem.from_uri(path)
        at, seen, n = f"{root}/{TaskContext.get().partitionId()}", Counter(), 0
        store.create_dir(at, recursive=True)
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                place = f"{at}-{seen[file]}" if seen[file] else at
                if seen[file]:
                    store.create_dir(place, recursive=True)
                seen[file] += 1
                with store.open_output_stream(f"{place}/{file}") as out:
                    out.write(content.encode())
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    named = documents.select("file", F.coalesce("content", F.lit("")).alias("content"))
    dealt = named.repartition(tasks, "file").sortWithinPartitions("file", "content")
    dealt.mapInArrow(work, "n long").agg(F.sum("n")).collect()  # one row


def parse_questions(lines: DataFrame) -> DataFrame:
    """id, category, question of lines (value) `CAT-N | question` or `[CAT-N] question`; others and comments are left out."""
    t = F.trim("value")
    bar, square = r"^(.*?) \| (.*)$", r"^\[([A-Z0-9-]+)\]\s*(.+)$"
    pick = lambda i: F.when(t.rlike(bar), F.trim(F.regexp_extract(t, bar, i))).when(t.rlike(square), F.regexp_extract(t, square, i))
    rows = lines.filter(~t.startswith("#") & (t != "")).select(pick(1).alias("id"), pick(2).alias("question")).filter("id is not null")
    return rows.select("id", F.regexp_replace("id", r"-[^-]*$", "").alias("category"), "question")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return parse_questions(spark.read.text(path))


def write_corpus(chunks: DataFrame, path: str, version: str, form: str = "parquet") -> None:
    """Chunks with their version; the folder is replaced as a whole."""
    chunks.withColumn("corpus_version", F.lit(version)).write.mode("overwrite").format(form).save(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON and, without nested columns, as CSV."""
    results.write.mode("overwrite").json(f"{path}/json")
    flat = [f.name for f in results.schema if not hasattr(f.dataType, "fields") and not hasattr(f.dataType, "elementType")]
    results.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
