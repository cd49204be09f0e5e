"""Documents as files, one each."""

import os

from pyspark.sql import functions as F

from qalake.plans import checking
from qalake.plans.catalog import Views
from qalake.sources import files

from .oracle import DATA


def test_documents_are_files_in_few_folders(spark):
    path = checking.document_files(Views(spark, DATA)).removeprefix("file://")
    found = [(at, len(names)) for at, _, names in os.walk(path)]
    assert sum(n for _, n in found) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(found) <= 3  # not a folder and a checksum for each


def test_repeated_names_and_texts_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES", 3)
    rows = [("a", "x\r\n\ny"), ("a", "second"), ("b", None), ("c", ""), ("d", "日\x00"), ("a", "third")]
    files.write_documents(spark.createDataFrame(rows, "file string, content string"), f"file://{tmp_path}/made")
    about = spark.createDataFrame([("a", 1)], "file string, n int")
    got = files.read_documents(spark, f"file://{tmp_path}/made", about, 0)
    assert sorted((r.file, r.content, r.n) for r in got.collect() if r.file == "a") == sorted(("a", t, 1) for f, t in rows if f == "a")
    assert {(r.file, r.content) for r in got.collect()} >= {("d", "日\x00")}


def test_the_driver_lists_no_file(spark, tmp_path):
    """3,000 files in three folders: the driver's plan knows tables of what tasks listed, and reads in a few tasks."""
    rows = spark.range(3000).selectExpr("cast(id as string) as file", "concat('text ', id) as content")
    files.write_documents(rows, f"file://{tmp_path}/made")
    got = files.read_documents(spark, f"file://{tmp_path}/made", rows.select("file", F.col("content").alias("known")), 6)
    assert len(got.inputFiles()) < 300 and got.rdd.getNumPartitions() == 2
    assert got.count() == 3000 and got.filter("content = known and content = concat('text ', file)").count() == 3000


def test_folders_within_folders(spark, tmp_path):
    for place, text in {"top": b"0", "a/b/c/deep": b"1", "a/b/two words": b"2", "name=doc/part-0.txt": b"3", "a/.hidden": b"4", "_tmp/x": b"5", "a/b/raw": b"\xff\n"}.items():
        (tmp_path / "in" / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / place).write_bytes(text)
    (tmp_path / "in" / "none").mkdir()
    about = spark.createDataFrame([("doc", 1), ("top", 2), ("top", 3), ("other", 4)], "file string, n int")
    read = lambda at: sorted((r.file, bytes(r.b), r.n or 0) for r in files.read_documents(spark, at, about, 1).select("file", F.col("content").cast("binary").alias("b"), "n").collect())
    assert read(f"file://{tmp_path}/in") == sorted([("top", b"0", 2), ("top", b"0", 3), ("deep", b"1", 0), ("two words", b"2", 0), ("doc", b"3", 1), ("raw", b"\xff\n", 0)])
    assert read(f"{tmp_path}/in/top") == [("top", b"0", 2), ("top", b"0", 3)] and read(f"file:{tmp_path}/in/none") == []
