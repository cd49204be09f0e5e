"""Quality by a generalised additive model with pairwise interactions.

Features are shares and means of a text's bytes, words and lines. Each is cut into bins; shallow trees, boosted over the
features in turn, add up to one lookup table for each feature, and then to tables for the pairs of features that explain
most of the rest. A score is the sum of table entries, taken for a whole batch at once.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, the first by a hash of the id), which the driver
gets as features, not as texts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import PLAIN, class_table, fold_in, hash_words, raw, read, slices, whole_texts, words

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, RATE, LEAVES = 120, 0.1, 3

UPPER = class_table(lambda b: 0x41 <= b <= 0x5A)
LETTER = class_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
DIGIT = class_table(lambda b: 0x30 <= b <= 0x39)
STOP = class_table(lambda b: b in b".,;:?\"'()-")
BAR = class_table(lambda b: b == 0x7C)
SYMBOL = class_table(lambda b: 0x21 <= b <= 0x7E and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b in b".,;:?\"'()-|"))
HIGH = class_table(lambda b: b >= 0x80)
LINE = class_table(lambda b: b != 0x0A)

FEATURES = (
    "log_words",
    "word_bytes",
    "word_spread",
    "short_words",
    "upper",
    "digits",
    "stops",
    "bars",
    "symbols",
    "high",
    "symbol_ends",
    "distinct_words",
    "top_word",
    "doubled_words",
    "line_words",
    "distinct_lines",
    "long_words",
)


def _repeats(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its most frequent one occurs."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[at], np.diff(np.append(at, len(h))))
    return np.bincount(row[at], minlength=rows), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, any length; empty texts have 0 in all."""
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets, PLAIN)
    count, size = np.diff(first), np.diff(offsets)
    row, length = np.repeat(np.arange(rows), count), ends - starts
    sums = lambda x, i: np.bincount(i, x, rows)
    n, b = np.maximum(count, 1), np.maximum(size, 1)

    def share(table):
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[offsets[1:]] - total[offsets[:-1]]

    mean = sums(length, row) / n
    spread = np.sqrt(np.maximum(sums(length.astype(float) ** 2, row) / n - mean**2, 0))
    h = hash_words(data, starts, ends)
    distinct, top = _repeats(h, row, rows)
    doubled = np.zeros(len(h), bool)
    doubled[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    last = SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    line_starts, line_ends, first_line = words(data, offsets, LINE)
    lines = np.diff(first_line)
    line_row = np.repeat(np.arange(rows), lines)
    distinct_lines, _ = _repeats(hash_words(data, line_starts, line_ends), line_row, rows)
    some = np.maximum(lines, 1)
    out = np.stack([
        np.log1p(count), mean, spread, sums(length <= 3, row) / n, share(UPPER) / np.maximum(share(LETTER), 1), share(DIGIT) / b, share(STOP) / n,
        share(BAR) / n, share(SYMBOL) / b, share(HIGH) / b, sums(last, row) / n, distinct / n, top / n, sums(doubled, row) / n, count / some, distinct_lines / some, sums(length > 20, row) / n,
    ], axis=1)
    out[count == 0] = 0
    return out


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _best_cut(g: np.ndarray, w: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best cut of bins low to high."""
    if high - low < 2:
        return 0.0, low
    a, b = np.cumsum(g[low:high])[:-1], np.cumsum(w[low:high])[:-1]
    all_g, all_w = g[low:high].sum(), w[low:high].sum()
    gain = a**2 / (b + 1) + (all_g - a) ** 2 / (all_w - b + 1) - all_g**2 / (all_w + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), low + at + 1


def _tree(g: np.ndarray, w: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A step function over bins: Newton steps of a tree with so many leaves."""
    bounds = [(0, len(g))]
    while len(bounds) < leaves:
        gain, at, i = max((*_best_cut(g, w, *part), i) for i, part in enumerate(bounds))
        if gain <= 1e-9:
            break
        low, high = bounds.pop(i)
        bounds += [(low, at), (at, high)]
    out = np.zeros(len(g))
    for low, high in bounds:
        out[low:high] = g[low:high].sum() / (w[low:high].sum() + 1)
    return out


def _quarters(g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree with one cut in each of two dimensions."""
    k, m = g.shape
    best, out = 0.0, np.zeros((k, m))
    cg, cw = g.cumsum(0).cumsum(1), w.cumsum(0).cumsum(1)
    for i in range(1, k):
        a = np.stack([cg[i - 1, :-1], cg[i - 1, -1] - cg[i - 1, :-1], cg[-1, :-1] - cg[i - 1, :-1], cg[-1, -1] - cg[i - 1, -1] - cg[-1, :-1] + cg[i - 1, :-1]])
        b = np.stack([cw[i - 1, :-1], cw[i - 1, -1] - cw[i - 1, :-1], cw[-1, :-1] - cw[i - 1, :-1], cw[-1, -1] - cw[i - 1, -1] - cw[-1, :-1] + cw[i - 1, :-1]])
        gain = (a**2 / (b + 1)).sum(0)
        j = int(np.argmax(gain)) if m > 1 else -1
        if j >= 0 and gain[j] > best:
            best = float(gain[j])
            step = a[:, j] / (b[:, j] + 1)
            out = np.empty((k, m))
            out[:i, : j + 1], out[:i, j + 1 :], out[i:, : j + 1], out[i:, j + 1 :] = step
    return best, out


class Additive:
    """score = logistic(base + sum of tables); tables over bins of one feature or of two."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS):
        self.cuts = [_cuts(c, BINS) for c in x.T]
        self.coarse = [_cuts(c, PAIR_BINS) for c in x.T]
        base = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(base / (1 - base)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not len(y) or y.min() == y.max():
            return
        bins = [np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)]
        coarse = [np.searchsorted(c, v, side="right") for c, v in zip(self.coarse, x.T, strict=True)]
        total = np.full(len(y), self.base)
        residual = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
        for _ in range(rounds):
            for f, own in enumerate(bins):
                g, w = residual()
                k = len(self.tables[f])
                step = RATE * _tree(np.bincount(own, g, k), np.bincount(own, w, k))
                self.tables[f] += step
                total += step[own]
        shape = lambda a, b: (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)

        def grid(a, b, v):
            k, m = shape(a, b)
            return np.bincount(coarse[a] * m + coarse[b], v, k * m).reshape(k, m)

        g, w = residual()
        gains = sorted(((_quarters(grid(a, b, g), grid(a, b, w))[0], a, b) for a, b in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
        self.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain > 1e-9]
        self.pair_tables = [np.zeros(shape(a, b)) for a, b in self.pairs]
        for _ in range(rounds // 2):
            for i, (a, b) in enumerate(self.pairs):
                g, w = residual()
                step = RATE * _quarters(grid(a, b, g), grid(a, b, w))[1]
                self.pair_tables[i] += step
                total += step[coarse[a], coarse[b]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for c, table, v in zip(self.cuts, self.tables, x.T, strict=True):
            total += table[np.searchsorted(c, v, side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _measure(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = raw(batch.column("text"))
    x = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    return np.concatenate(x) if x else np.zeros((0, len(FEATURES)))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, label and one double column for each feature, of docs (doc_id, label int, text)."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *map(pa.array, _measure(batch).T)], names=["doc_id", "label", *FEATURES])

    return docs.mapInArrow(work, "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Additive:
    """labels: doc_id, label (0 or 1). At most `rows` of them are used, the first by a hash of the id.

    Of several labels of an id one is used; rows of docs that repeat an id count as often. Without labels, or with those of
    one class only, the model is that class's share for all texts.
    """
    sample = labels.filter("label in (0, 1)").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(rows)
    sample = sample.select("doc_id", F.col("label").cast("int").alias("label"))
    known = whole_texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")  # at most `rows` rows are sent
    table = feature_table(known).toArrow().to_pandas().sort_values(["doc_id", *FEATURES])
    return Additive(table[list(FEATURES)].to_numpy(), table.label.to_numpy(float))


def quality(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted.

    Only doc_id and text are read: further columns, whatever their names, play no part. Null texts are empty, and texts
    without words, empty ones too, are scored as what they are, by features that are 0. Texts of any length are measured
    whole. Repeated rows and equal texts get equal scores; a score of exactly `threshold` is predicted 1. Ids may be any 64-bit
    number or null. Empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_measure(batch)))], names=["doc_id", "score"])

    return whole_texts(docs).mapInArrow(work, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


HELD_OUT = (5, 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    out = quality(docs, train(docs, labels.filter(~fold_in(F.col("doc_id"), *HELD_OUT))))
    return out.select("doc_id", fold_in(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score", "predicted")
