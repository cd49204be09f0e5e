"""What several operators of this subpackage need: shared folder, Arrow access to whole texts, words and their hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of text that one numpy step works on; bounds a task's memory, not its results.
SLICE_BYTES = 1 << 19

MASK64 = (1 << 64) - 1


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once all that is made of them is written too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, so that further columns can't clash; a null text counts as empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def text_tie(text: Column) -> Column:
    """What tells rows of one id apart: a hash of the whole text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc, doc_id, text of docs, and whether ids repeat or are null.

    doc is the id where ids are unique. Otherwise distinct pairs of id and text are numbered in order of the id (null
    first), then of a hash of the text, so that rows of one id with different texts are documents of their own; identical
    rows have one number.
    """
    rows = whole_texts(docs)
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text"), False
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    pairs = rows.select("doc_id", text_tie(F.col("text")).alias("tie")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    pairs = cut(pairs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").alias("own_id"), F.col("tie").alias("own_tie")), "numbers")
    same = rows["doc_id"].eqNullSafe(pairs["own_id"]) & (text_tie(rows["text"]) == pairs["own_tie"])
    return rows.join(pairs, same).select("doc", "doc_id", "text"), True


def fold_in(label: Column, modulus: int, rest: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus, is rest (null ids: of the empty text)."""
    return F.crc32(F.encode(F.coalesce(label.cast("string"), F.lit("")), "UTF-8")) % modulus == rest


# -- texts in tasks ---------------------------------------------------------------------------------------------------


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and where each row's begin (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows (i, j) with at most limit bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def class_table(inside) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[b for b in range(256) if inside(b)]] = True
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`.
PLAIN = class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z were lower-cased.
FOLDED = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in data, and the number of each row's first word (one more for the end); no word crosses rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of whole words, whatever their length."""
    length = ends - starts
    h = mix(length.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & MASK64))
    if not len(length):
        return h
    at = eights(data)
    left = np.minimum(length, 8).astype(np.uint64)
    chunk = at[starts] & (np.uint64(MASK64) >> ((np.uint64(8) - left) * np.uint64(8)))
    h = mix(h ^ chunk)
    more = np.flatnonzero((length > 8) & (length <= 64))
    k = 8
    while len(more):
        left = np.minimum(length[more] - k, 8).astype(np.uint64)
        chunk = at[starts[more] + k] & (np.uint64(MASK64) >> ((np.uint64(8) - left) * np.uint64(8)))
        h[more] = mix(h[more] ^ chunk)
        k += 8
        more = more[length[more] > k]
    for i in np.flatnonzero(length > 64):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words each; whoever calls leaves out those that cross rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[i : i + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of w neighbours, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(total) + shift


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def whole_groups(batches, key: str, rows: int = 20_000):
    """Arrow tables made of whole runs of equal key, of about `rows` rows, from batches sorted by key."""
    held: list[pa.Table] = []
    n, enough = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.concat_tables(held).combine_chunks()
        keys = table.column(key).to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield table.slice(0, last)
        held, n = [table.slice(last)], len(keys) - last
        enough = max(rows, 2 * n)
    if n:
        yield pa.concat_tables(held).combine_chunks()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)
