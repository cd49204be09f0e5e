"""Token counts by a digest cache.

The cache is a table of (content_sha256, tokenizer_sha256, n_tokens). Texts are joined to it by their digest and the
tokenizer's; only distinct texts that it lacks are encoded, and their counts are appended. Equal texts meet before they
are shuffled, so that a text with a third of all rows is encoded once and sent about once per task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, shared_folder, whole_texts

LIMIT = 1024
CACHE = "content_sha256 binary, tokenizer_sha256 string, n_tokens long"
#: Pieces whose counts a worker remembers; the memory is emptied beyond.
REMEMBERED = 400_000
#: Texts of these characters only are cut into pieces here, where the cut is known to equal the library's; others go to it whole.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SAFE = re.compile(rf"[\n\t\r\x20-\x7e{LETTERS}×÷]*")
#: Fixed value: the public pre-tokenizer's pattern of byte-level BPE, for those characters.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")


class Counter(dict):
    """Token counts of pieces, encoded by the library when first seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        before = json.loads(self.tokenizer.to_str())
        own, post = before.get("pre_tokenizer") or {}, before.get("post_processor") or {}
        model = own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and before.get("normalizer") is None
        model = model and post.get("type", "ByteLevel") == "ByteLevel"  # which moves offsets alone
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = model and self.tokenizer.encode("a", add_special_tokens=False).tokens == ["a"]

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n

    def count(self, text: str) -> int:
        if self.pieces and SAFE.fullmatch(text) and not (self.special and self.special.search(text)):
            return sum(map(self.__getitem__, PIECE.findall(text)))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _first_of_batch(batches):
    """Each distinct text of a batch once, with its digest."""
    for batch in batches:
        seen: dict[bytes, str] = {}
        for text in batch.column("text").to_pylist():
            seen.setdefault(hashlib.sha256(text.encode()).digest(), text)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.string())], names=["content_sha256", "text"])


def _encode(path: str, version: str):
    def work(batches):
        own = counter(path)
        for batch in batches:
            n = [own.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_sha256"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=["content_sha256", "tokenizer_sha256", "n_tokens"],
            )

    return work


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. cache: the folder of the cache table; missing
    entries are appended to it.

    Only doc_id and text are read: further columns, whatever their names, play no part. Content is normalised by taking null
    as empty and by nothing else, since token counts depend on every byte; texts of any length are encoded whole. Empty
    texts have 0 tokens; repeated rows give repeated results, null ids are kept; `limit` tokens are not over it. Empty tables
    give no rows. Two runs that append the same entry do no harm: entries are read as distinct.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # so that it exists
    stored = lambda: spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer_sha256") == version).select("content_sha256", "n_tokens").distinct()
    docs = whole_texts(docs)
    texts = docs.select("text").mapInArrow(_first_of_batch, "content_sha256 binary, text string")
    misses = texts.join(stored().select("content_sha256"), "content_sha256", "left_anti").dropDuplicates(["content_sha256"])
    misses.mapInArrow(_encode(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("content_sha256"))
    return rows.join(stored(), "content_sha256").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def cache_folder(spark: SparkSession) -> str:
    """Where the registered query keeps its counts from run to run: entries name content and tokenizer, not the table."""
    return f"{shared_folder(spark)}/token-counts"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache_folder(spark))
