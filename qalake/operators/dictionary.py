"""Dictionaries as tables: which terms of a table are in which texts.

A dictionary that is sent to all tasks is a table of keys by length: a term of up to eight bytes is its own key, a longer one
has a hash, which only places that begin with the first eight bytes of such a term are asked for. A task looks terms up in
the distinct words of a slice of texts (terms with a space: in the texts themselves), so that work grows with the words, not
with texts times terms, and of a word that is in all texts no row is made.

Larger dictionaries meet the texts by an index of grams. A term is in a text only if each of its grams (runs of three
characters; of a shorter term, itself) is. So each term is filed under one gram, the rarest of its own in some of the texts;
a text meets the terms that are filed under its grams, by equality, and those are held against the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qalake.session import stored

GRAM = 3
#: Terms up to which a dictionary is sent to all tasks (of about 50 bytes each), and texts whose grams are counted to find rare ones.
SENT_TERMS, COUNTED = 2_000_000, 1000
#: Bytes of texts that a task looks at together.
SLICE_BYTES = 4 << 20
SPACE = r"[ \t\n\v\f\r]"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, none null, one after the other, and where each begins (and the last ends)."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros behind the end."""
    return np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).copy()


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ..., n of each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)


def _long_keys(at: np.ndarray, place: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of `size` (over eight) bytes from each place on."""
    h = np.full(len(place), seed, np.uint64)
    for step in [*range(0, size - 8, 8), size - 8]:
        h = (h ^ at[place + step]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class _Keys:
    """Sorted keys with their terms; a table of bits spares most searches."""

    def __init__(self, keys: np.ndarray, terms: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.terms = keys[order], terms[: len(keys)][order]
        bits = min(24, max(10, len(keys).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are there, and the place of each in the sorted ones."""
        hit = np.flatnonzero(self.table[self._slot(keys)])
        i = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
        same = self.keys[i] == keys[hit]
        return hit[same], i[same]


class _Lengths:
    """Terms by their length in bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, terms: np.ndarray):
        self.data, self.offsets = data, offsets
        at, size = _eights(data), np.diff(offsets)[terms]
        self.short = {int(n): _Keys(at[offsets[terms[size == n]]] & self.mask(int(n)), terms[size == n]) for n in np.unique(size[size <= 8])}
        long = terms[size > 8]
        self.heads = _Keys(np.unique(at[offsets[long]]), long) if len(long) else None
        self.long = {}
        for n in np.unique(size[size > 8]):
            own, seed = terms[size == n], 1
            while len(np.unique(keys := _long_keys(at, offsets[own], int(n), seed))) < len(own):
                seed += 1  # so that no two terms have the same key
            self.long[int(n)] = (seed, _Keys(keys, own))

    @staticmethod
    def mask(n: int) -> np.uint64:
        return np.uint64((1 << 8 * n) - 1)

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings that contain terms, and these, for each place; no term reaches over a string's end."""
        at = _eights(data)
        room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
        places, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, keys in self.short.items():
            own = np.flatnonzero(room >= n)
            hit, i = keys.find(at[own] & self.mask(n))
            places.append(own[hit])
            terms.append(keys.terms[i])
        if self.heads is not None:
            own = np.flatnonzero(room > 8)
            head = own[self.heads.find(at[own])[0]]
            for n, (seed, keys) in self.long.items():
                own = head[room[head] >= n]
                hit, i = keys.find(_long_keys(at, own, n, seed))
                place, term = own[hit], keys.terms[i]
                same = np.ones(len(hit), bool)
                for step in range(n):  # equal hashes are held against the bytes
                    same &= data[place + step] == self.data[self.offsets[term] + step]
                places.append(place[same])
                terms.append(term[same])
        place = np.concatenate(places)
        return np.searchsorted(offsets, place, "right") - 1, np.concatenate(terms)


class Dictionary:
    """Distinct terms, none null or empty, ready to be looked up in texts."""

    def __init__(self, terms: pa.Array):
        self.terms = terms
        data, offsets = _bytes(terms)
        spaced = pc.match_substring_regex(terms, SPACE).to_numpy(zero_copy_only=False) if len(terms) else np.zeros(0, bool)
        self.in_words, self.in_texts = (_Lengths(data, offsets, np.flatnonzero(x)) for x in (~spaced, spaced))

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts and the terms that they contain, each pair once, by text and term."""
        wide = max(len(self.terms), 1)
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        names = max(len(coded.dictionary), 1)
        once = _once(np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False)) * names + coded.indices.to_numpy())
        text, word = np.divmod(once, names)
        held, term = np.divmod(_once(_joined(*self.in_words.occurrences(*_bytes(coded.dictionary)), wide)), wide)
        n = np.bincount(held, minlength=names)
        begin = np.cumsum(n) - n
        found = [np.repeat(text, n[word]) * wide + term[_ranges(begin[word], n[word])]]
        if self.in_texts.short or self.in_texts.long:
            found.append(_joined(*self.in_texts.occurrences(*_bytes(texts)), wide))
        return np.divmod(_once(np.concatenate(found)), wide)


def _once(x: np.ndarray) -> np.ndarray:
    """Distinct numbers, none below zero, rising: by a sort, which is faster here than numpy's hash table."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) != 0]


def _joined(string: np.ndarray, term: np.ndarray, wide: int) -> np.ndarray:
    return string * wide + term


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES of a column."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _sent(terms: DataFrame):
    """The distinct terms, neither null nor empty, as a Dictionary that all tasks have."""
    column = terms.toArrow().column("term").combine_chunks()
    return terms.sparkSession.sparkContext.broadcast(Dictionary(column))


def grams(text: Column, *sizes: int) -> Column:
    """Distinct runs of so many characters, for each of the sizes; none of a shorter text. Linear in the text's length."""

    def runs(c: Column, n: int) -> Column:
        begins = F.slice(c, F.lit(1), F.greatest(F.size(c) - (n - 1), F.lit(0)))
        return F.transform(begins, lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, n)]))

    characters = F.array(F.filter(F.split(text, ""), lambda x: x != ""))  # bound once, so that no run walks the text again
    return F.flatten(F.transform(characters, lambda c: F.array_distinct(F.concat(*[runs(c, n) for n in sizes]))))


def gram_index(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """gram, term of the distinct terms (term; neither null nor empty): the gram of each that is rarest in some of the texts (text)."""
    seen = texts.select("text").limit(COUNTED).select(F.explode(grams(F.col("text"), GRAM)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    own = terms.filter("term <> ''").select("term").distinct()
    all_grams = own.select("term", F.explode(F.when(F.length("term") < GRAM, F.array("term")).otherwise(grams(F.col("term"), GRAM))).alias("gram"))
    counted = all_grams.join(seen, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return counted.select("gram", "term")


def _distinct(terms: DataFrame) -> DataFrame:
    return terms.filter("term <> ''").select("term").distinct()


def terms_in(texts: DataFrame, terms: DataFrame, key: str, sent_terms: int = SENT_TERMS) -> DataFrame:
    """key, term: each text (key, text) with each distinct term (term) that it contains, as written. Keys are unique.

    A dictionary of up to sent_terms terms, counted before, is sent to all tasks: texts are not shuffled. Beyond, keys and grams
    meet the index by a join, and what they meet is joined with the texts for the check.
    """
    texts, own = texts.select(key, "text").filter("text is not null"), _distinct(terms)
    if own.count() <= sent_terms:
        shared = _sent(own)

        def work(batches):
            for batch in batches:
                for part in _slices(batch, "text"):
                    text, term = shared.value.pairs(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(text)), shared.value.terms.take(pa.array(term))], names=[key, "term"])

        return texts.mapInArrow(work, f"`{key}` {texts.schema[key].dataType.simpleString()}, term string")
    index = gram_index(terms, texts)
    sizes = sorted({min(GRAM, r[0]) for r in own.select(F.least(F.length("term"), F.lit(GRAM))).distinct().collect()})  # at most GRAM rows
    if not sizes:
        return texts.select(key, F.lit(None).cast("string").alias("term")).filter("false")
    met = texts.select(key, F.explode(grams(F.col("text"), *sizes)).alias("gram")).join(index, "gram").select(key, "term")
    return met.join(texts, key).filter(F.contains("text", F.col("term"))).select(key, "term")


def count_terms(texts: DataFrame, terms: DataFrame, key: str, samples: int, sent_terms: int = SENT_TERMS) -> DataFrame:
    """term, n, firsts: for each distinct term (term) that is in a text (key, text), the number of texts and their first keys, ascending.

    A task counts by slices of texts, and sends a row for each slice and term: not one for each text and term, which are
    hundreds for each text. Dictionaries of more than sent_terms terms: by the pairs of terms_in.
    """
    texts, own = texts.select(key, "text").filter("text is not null"), _distinct(terms)
    kind = texts.schema[key].dataType.simpleString()
    if own.count() <= sent_terms:
        shared = _sent(own)

        def work(batches):
            for batch in batches:
                for part in _slices(batch, "text"):
                    part = part.take(pc.sort_indices(part.column(key)))
                    text, term = shared.value.pairs(part.column("text"))
                    order = np.argsort(term, kind="stable")
                    text, term = text[order], term[order]
                    begin = np.flatnonzero(np.diff(term, prepend=-1))
                    n = np.diff(np.append(begin, len(term)))
                    few = np.minimum(n, samples)
                    firsts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32)), part.column(key).take(pa.array(text[_ranges(begin, few)])))
                    yield pa.RecordBatch.from_arrays([shared.value.terms.take(pa.array(term[begin])), pa.array(n), firsts], names=["term", "n", "firsts"])

        parts = stored(texts.mapInArrow(work, f"term string, n long, firsts array<{kind}>"), "terms")
    else:
        parts = terms_in(texts, terms, key, sent_terms).select("term", F.lit(1).cast("long").alias("n"), F.array(key).alias("firsts"))
    each = parts.select("term", F.explode("firsts").alias("key"))
    first = each.withColumn("i", F.row_number().over(W.partitionBy("term").orderBy("key"))).filter(F.col("i") <= samples)
    return parts.groupBy("term").agg(F.sum("n").alias("n")).join(first.groupBy("term").agg(F.array_sort(F.collect_list("key")).alias("firsts")), "term")


def expand_by_table(questions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """qid, expanded: the longest term in the lower-cased question (qid, question), of equals the first, is replaced wherever it
    stands. Questions without one stay as they are. dictionary: pos, term, expansion; terms are lower-case.

    One shuffle, by question: a row for each question, and one for each term in it.
    """
    found = terms_in(questions.select("qid", F.lower("question").alias("text")), dictionary, "qid")
    first = dictionary.groupBy("term").agg(F.min_by(F.struct("pos", "expansion"), "pos").alias("x")).select("term", "x.*")
    hits = found.join(first, "term").select("qid", F.lit(None).cast("string").alias("question"), F.struct(F.length("term").alias("size"), (-F.col("pos")).alias("pos"), "term", "expansion").alias("hit"))
    none = F.lit(None).cast(hits.schema["hit"].dataType)
    both = hits.unionByName(questions.select("qid", "question", none.alias("hit"))).groupBy("qid").agg(F.max("question").alias("question"), F.max("hit").alias("hit"))
    return both.select("qid", F.when(F.col("hit").isNull(), F.col("question")).otherwise(F.replace(F.lower("question"), F.col("hit.term"), F.col("hit.expansion"))).alias("expanded"))
