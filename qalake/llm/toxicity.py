"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary training texts, give each byte of a text its chance after the bytes before it: up to
ORDER - 1 bytes, from the begin of its word on. Both discount their counts (by more where the count is higher, as modified
Kneser-Ney smoothing does) and back off to shared counts: those of both classes together, and below them continuation
counts, in how many contexts a sequence occurs, of 5, 2 and 1 bytes. So rare expressions, of which a class has seen little
or nothing, get what both classes know of them. All sequences of all training texts count, however rare. A word's first
byte looks at the word before, too: after that its chance backs off to the shared one, times what the class's own first
bytes say of it.

What a byte adds to the difference of the two log-likelihoods is a term (a first byte has two, one of the word before).
Terms of bytes that no class has seen after a known context are the context's; after unknown ones both models agree. A
text is scored by its difference for each byte, and by how far the terms' sums of words, and the terms of the words
before, exceed some bounds, up and down (since a few strong words tell more than many weak ones); a logistic function of
these is fitted on training rows that were not counted. No weight works against the difference, which keeps a share of the
weight it has by itself: with sizes given, the score never falls when a word's difference grows.

The terms are a table in the shared folder, which grows with the training texts. The contexts used most (a bounded number
of terms) are sent to all tasks; words that need others are sent, each distinct one once, to be joined with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import FOLDED, LOWER, cut, fold_in, hash_words, mix, ranges, raw, read, runs, signed, slices, whole_texts, words

#: Bytes of a sequence: a context and the byte after it. Eight fit a number.
ORDER = 8
#: Bytes of a sequence that begins in the word before: up to four of that word's last (or its begin), the space, and the first byte.
ACROSS = 6
#: Shared counts below: of the last so many bytes.
BACKOFF = (5, 2, 1)
#: Discount of counts of both classes, and of a class's counts of 1, 2, and 3 or more.
DISCOUNT, CLASS_DISCOUNTS = 0.75, (1.0, 1.6, 2.2)
THRESHOLD = 0.3
#: Rows that calibrate (a bounded sample, by hash), one of five training rows at most.
CALIBRATION_ROWS = 20_000
#: Labels that are sent to all tasks; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Bytes of text whose counts a task reduces at once.
COUNTED_BYTES = 1 << 20
#: Terms that are sent to all tasks, at most; the rest are joined.
HOT_TERMS = 5_000_000
#: Items that a task remembers to have sent; beyond, some are sent again.
SENT_ITEMS = 1_000_000
#: Words' sums above and below these are summed by themselves.
BOUNDS = (1.0, 2.0, 3.0)
#: Numbers that describe a text.
SUMS = 1 + 2 * len(BOUNDS)
#: Signs of their weights: what the toxic model likes more never lowers a score.
SIGNS = np.array([1.0] * (1 + len(BOUNDS)) + [-1.0] * len(BOUNDS))
#: What the difference keeps, beside the words' sums, of the weight that it has by itself.
LEAST_SHARE = 0.1
SPACE = np.uint8(0x20)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Above a context's bytes, where a sequence has text: contexts and sequences are kept in one table.
CONTEXT = np.uint64(1 << 56)


class Events:
    """The bytes of texts (lower-cased, a space on both sides of a word) with their contexts.

    code: context and byte as a number, last byte lowest. Each word has two items: its first byte after the word before (0
    where there is none), and its bytes and the space behind after its own begin. begin: where items begin. row: each
    item's text. bytes and items: of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        starts, ends, first = words(data, offsets, FOLDED)
        count, length = np.diff(first), ends - starts
        row = np.repeat(np.arange(len(count)), count)
        at = np.cumsum(length + 1) - length  # in a text of all words, a space before and after each
        n = int(length.sum()) + len(length) + 1
        text = np.full(n + 7, SPACE)
        text[:7] = 0
        text[7 + ranges(at, length)] = data[ranges(starts, length)]
        eight = np.ndarray((n,), ">u8", text, 0, (1,))
        inner = ranges(at, length + 1)
        base = np.cumsum(length + 2) - length - 2
        self.code = np.zeros(int((length + 2).sum()), np.uint64)
        self.code[ranges(base + 1, length + 1)] = eight[inner].astype(np.uint64) & MASKS[np.minimum(ranges(np.full(len(at), 2), length + 1), ORDER)]
        later = np.flatnonzero(row[1:] == row[:-1]) + 1
        self.code[base[later]] = eight[at[later]].astype(np.uint64) & MASKS[np.minimum(length[later - 1] + 3, ACROSS)]
        self.begin = np.empty(2 * len(at), np.int64)
        self.begin[::2], self.begin[1::2] = base, base + 1
        self.row = np.repeat(row, 2)
        self.bytes = np.bincount(row, length + 1, len(count)).astype(np.int64)
        self.items = 2 * count
        self.words = (data, starts, ends)

    def names(self) -> np.ndarray:
        """Hashes that name items: of what their terms depend on."""
        out = np.empty(len(self.begin), np.uint64)
        out[::2] = mix(self.code[self.begin[::2]].copy())
        out[1::2] = hash_words(*self.words, seed=5)
        return out


# -- the table of terms -----------------------------------------------------------------------------------------------


def _counts(batches):
    """Sequences' counts by class."""
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        data, offsets = raw(batch.column("text"))
        for i, j in slices(offsets, COUNTED_BYTES):
            own = Events(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            begin = np.append(own.begin, len(own.code))
            toxic = np.zeros(len(own.code), np.int64)
            if len(own.row):
                toxic[begin[0] :] = np.repeat(label[i + own.row], np.diff(begin))
            real = own.code > 0
            g, number = np.unique(own.code[real], return_inverse=True)
            c1 = np.bincount(number, toxic[real], len(g)).astype(np.int64)
            c0 = np.bincount(number, minlength=len(g)) - c1
            yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(c0), pa.array(c1)], names=["g", "c0", "c1"])


def _context(s: str) -> Column:
    return F.shiftrightunsigned(F.col(s), 8)


def _last(s: str, n: int) -> Column:
    return F.col(s).bitwiseAND(F.lit(int(MASKS[n])))


def _shared(grams: DataFrame) -> DataFrame:
    """s (BACKOFF[0] bytes), p: chances by continuation counts."""
    levels = []
    rows = grams.select(F.col("g").alias("s"))
    for n in BACKOFF:
        rows = rows.groupBy(_last("s", n).alias("s")).agg(F.count("*").alias("n"))
        levels.append(rows)
    every = W.partitionBy(_context("s"))  # what follows one context: at most 256 rows
    p = levels[-1].select("s", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("p"))  # one row for each byte
    for n, rows in zip(BACKOFF[-2::-1], levels[-2::-1], strict=True):
        below = BACKOFF[BACKOFF.index(n) + 1]
        joined = rows.join(F.broadcast(p.withColumnRenamed("s", "b")), F.col("b") == _last("s", below))  # at most 2^16 rows are sent
        p = joined.select("s", ((F.col("n") - DISCOUNT + DISCOUNT * F.count("*").over(every) * F.col("p")) / F.sum("n").over(every)).alias("p"))
    return p


def terms(rows: DataFrame) -> DataFrame:
    """ctx, n (its count), w (the term of what it was never seen with), grams (array of g and v: the terms of what it was) of rows (text, toxic)."""
    grams = cut(rows.mapInArrow(_counts, "g long, c0 long, c1 long").groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "grams")
    rows = grams.join(_shared(grams).withColumnRenamed("s", "b"), F.col("b") == _last("g", BACKOFF[0])).withColumn("ctx", _context("g"))
    own = W.partitionBy("ctx")
    c = F.col("c0") + F.col("c1")
    q = (c - DISCOUNT + DISCOUNT * F.count("*").over(own) * F.col("p")) / F.sum(c).over(own)

    def discount(k: int) -> Column:
        one, two, more = CLASS_DISCOUNTS
        n = F.col(f"c{k}")
        return F.when(n == 0, 0.0).when(n == 1, one).when(n == 2, two).otherwise(more)

    rows = rows.select("g", "ctx", "c0", "c1", q.alias("q"), *[F.sum(f"c{k}").over(own).alias(f"s{k}") for k in (0, 1)], *[F.sum(discount(k)).over(own).alias(f"d{k}") for k in (0, 1)])
    left = lambda k: F.when(F.col(f"s{k}") > 0, F.col(f"d{k}") / F.col(f"s{k}")).otherwise(1.0)
    given = lambda k, tilt=F.lit(1.0): F.when(F.col(f"s{k}") > 0, (F.col(f"c{k}") - discount(k)) / F.col(f"s{k}")).otherwise(0.0) + left(k) * F.col("q") * tilt
    # a word's first byte after the word before: shared chances are tilted by the class's first bytes
    heads = rows.filter(F.col("ctx") == int(SPACE)).select(_last("g", 1).alias("head"), (given(0) / F.col("q")).alias("r0"), (given(1) / F.col("q")).alias("r1"))
    after = (_last("ctx", 1) == int(SPACE)) & (F.col("ctx") != int(SPACE))
    rows = rows.join(F.broadcast(heads), after & (F.col("head") == _last("g", 1)), "left")  # one row for each byte is sent
    tilt = lambda k: F.coalesce(f"r{k}", F.lit(1.0))
    v = F.log(given(1, tilt(1))) - F.log(given(0, tilt(0))) - F.log(tilt(1)) + F.log(tilt(0))
    rows = rows.select("g", "ctx", (F.col("s0") + F.col("s1")).alias("n"), (F.log(left(1)) - F.log(left(0))).alias("w"), v.alias("v"))
    return rows.groupBy("ctx").agg(F.max("n").alias("n"), F.max("w").alias("w"), F.collect_list(F.struct("g", "v")).alias("grams"))  # at most 256 of a context


class Lookup:
    """A hash table of numbers (none 0) with values, by linear probing, all keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(1.3 * len(keys)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.keys[place] == 0
            self.keys[place[free]] = keys[left[free]]
            own = self.keys[place] == keys[left]
            self.values[place[own]] = values[left[own]]
            left, place = left[~own], (place[~own] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 if absent), and whether they are there."""
        place = self._place(keys)
        got = self.keys[place]
        known = got == keys
        value = np.where(known, self.values[place], np.float32(0)).astype(float)
        left = np.flatnonzero(~known & (got != 0))
        place = place[left]
        while len(left):
            place = (place + 1) & self.mask
            got = self.keys[place]
            same = got == keys[left]
            value[left[same]], known[left[same]] = self.values[place[same]], True
            more = ~same & (got != 0)
            left, place = left[more], place[more]
        return value, known


def frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The terms of the contexts with the largest counts, most at most (all contexts of a count or none): keys, values, and whether these are all."""
    size = F.sum(F.size("grams") + 1)
    sizes = sorted(table.groupBy(F.least("n", F.lit(5000)).alias("n")).agg(size.alias("terms")).collect(), reverse=True)  # at most 5,000 rows
    room, least = most, None
    for n, number in sizes:
        room -= number
        if room < 0:
            break
        least = n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), not sizes
    hot = table.filter(F.col("n") >= least)
    own = hot.select((F.col("ctx") + F.lit(int(CONTEXT))).alias("f"), F.col("w").cast("float").alias("v"))
    found = own.unionByName(hot.select(F.explode("grams").alias("e")).select(F.col("e.g").alias("f"), F.col("e.v").cast("float").alias("v"))).toArrow()
    return found.column("f").to_numpy().view(np.uint64), found.column("v").to_numpy(), room >= 0


# -- scores -----------------------------------------------------------------------------------------------------------

class Hot:
    """The frequent terms as they are sent, made ready once in a worker."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.terms, self.table = (keys, values), None

    def ready(self) -> Lookup:
        if self.table is None:
            self.table, self.terms = Lookup(*self.terms), None
        return self.table


def parts(value: np.ndarray) -> list[np.ndarray]:
    """A sum of terms, and how far it exceeds each bound, up and down."""
    return [value, *(np.maximum(value - t, 0) for t in BOUNDS), *(np.maximum(-value - t, 0) for t in BOUNDS)]


def part_columns(value: Column) -> list[Column]:
    """The same as columns."""
    return [value, *(F.greatest(value - t, F.lit(0.0)) for t in BOUNDS), *(F.greatest(-value - t, F.lit(0.0)) for t in BOUNDS)]


def _values(own: Events, table: Lookup, complete: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's term, and whether it is known."""
    value, known = table.find(own.code)
    rest = np.flatnonzero(~known & (own.code > 0))
    value[rest], there = table.find((own.code[rest] >> np.uint64(8)) | CONTEXT)
    known[:] = True
    if not complete:
        known[rest[~there]] = False
    return value, known


def _means(sums: np.ndarray, size: np.ndarray, items: np.ndarray) -> np.ndarray:
    out = sums / np.maximum(items, 1)[:, None]
    out[:, 0] = sums[:, 0] / np.maximum(size, 1)
    return out


def _describe(text: pa.Array, table: Lookup) -> np.ndarray:
    """SUMS means of each text, where all terms are in the table."""
    data, offsets = raw(text)
    out = []
    for i, j in slices(offsets):
        own = Events(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        item = np.add.reduceat(_values(own, table, True)[0], own.begin) if len(own.begin) else np.zeros(0)
        out.append(_means(np.stack([np.bincount(own.row, p, j - i) for p in parts(item)], axis=1).astype(float), own.bytes, own.items))
    return np.concatenate(out) if out else np.zeros((0, SUMS))


def _scores(x: np.ndarray, weights: np.ndarray, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights + b, -40, 40)))


PROBES = "key long, bytes long, items long, x array<double>, cold array<long>, times array<long>, item long, base double, codes array<long>"


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values))


def _probes(hot):
    """For each text its sizes, the sums of its items with frequent terms, and its other items; for each of those, once, what is known of it and its other codes."""

    def work(batches):
        table = hot.value.ready()
        sent = np.zeros(0, np.int64)  # items that this task has sent
        for batch in batches:
            key = batch.column("key")
            data, offsets = raw(batch.column("text"))
            for i, j in slices(offsets):
                own = Events(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(own.begin):
                    continue
                value, known = _values(own, table, False)
                item = np.add.reduceat(value, own.begin)
                cold = ~np.logical_and.reduceat(known, own.begin)
                sums = np.stack([np.bincount(own.row[~cold], p, j - i) for p in parts(item[~cold])], axis=1).astype(float)  # of nothing, whole numbers
                name, row = signed(own.names()), own.row
                order = np.flatnonzero(cold)
                order = order[np.lexsort((name[order], row[order]))]
                at = runs(row[order], name[order])
                one = order[at[:-1]]
                some = np.flatnonzero(own.bytes)
                docs = len(some)
                none = lambda n, t: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays([
                    key.take(pa.array(i + some)), pa.array(own.bytes[some]), pa.array(own.items[some]), _lists(sums[some].ravel(), np.full(docs, SUMS)),
                    _lists(name[one], np.bincount(row[one], minlength=j - i)[some]), _lists(np.diff(at), np.bincount(row[one], minlength=j - i)[some]),
                    none(docs, pa.int64()), none(docs, pa.float64()), none(docs, pa.list_(pa.int64())),
                ], names=NAMES)
                fresh, first = np.unique(name[one], return_index=True)
                new = ~np.isin(fresh, sent, assume_unique=True)
                one = one[first[new]]
                sent = np.union1d(sent if len(sent) < SENT_ITEMS else sent[:0], fresh[new])
                stop = np.append(own.begin[1:], len(value))[one]
                place = ranges(own.begin[one], stop - own.begin[one])
                owner = np.repeat(np.arange(len(one)), stop - own.begin[one])
                open_ = ~known[place]
                n = len(one)
                yield pa.RecordBatch.from_arrays([
                    *(none(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()))),
                    pa.array(name[one]), pa.array(item[one]), _lists(signed(own.code[place[open_]]), np.bincount(owner[open_], minlength=n)),
                ], names=NAMES)

    return work


NAMES = [c.split()[0] for c in PROBES.split(", ")]


class Model:
    """Terms of the two models' difference, as a table and the frequent ones by themselves, and the calibration."""

    def __init__(self, table: DataFrame, hot_terms: int = HOT_TERMS):
        self.table = table
        *hot, self.complete = frequent(table, hot_terms)
        self.hot = table.sparkSession.sparkContext.broadcast(Hot(*hot))
        self.weights, self.b = np.zeros(SUMS), 0.0
        self.weights[0] = 1

    def evidence(self, rows: DataFrame) -> DataFrame:
        """key and x (SUMS means) of rows (key, text). Equal keys are for equal texts; texts without words may be left out."""
        hot = self.hot
        if self.complete:

            def describe(batches):
                for batch in batches:
                    x = _describe(batch.column("text"), hot.value.ready())
                    yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(x.ravel(), np.full(len(x), SUMS))], names=["key", "x"])

            return rows.mapInArrow(describe, "key long, x array<double>").groupBy("key").agg(F.max("x").alias("x"))
        found = cut(rows.mapInArrow(_probes(hot), PROBES), "probes")
        docs = found.filter("item is null").dropDuplicates(["key"])
        items = found.filter("item is not null").groupBy("item").agg(F.min_by(F.struct("base", "codes"), "base").alias("own"))
        codes = items.select("item", F.explode("own.codes").alias("code"))
        seen = F.filter("grams", lambda e: e["g"] == F.col("code"))
        codes = codes.join(self.table.select("ctx", "w", "grams"), F.shiftrightunsigned("code", 8) == F.col("ctx")).select("item", F.coalesce(F.get(seen, F.lit(0))["v"], F.col("w")).alias("v"))
        items = items.select("item", F.col("own.base").alias("v")).unionByName(codes).groupBy("item").agg(F.sum("v").alias("v"))
        cold = docs.select("key", F.explode(F.arrays_zip("cold", "times")).alias("e")).select("key", F.col("e.cold").alias("item"), F.col("e.times").alias("n")).join(items, "item")
        # terms, not their parts, are shuffled: a row is added up where its text's others are
        cold = cold.select("key", F.col("v").cast("float").alias("v"), F.col("n").cast("int").alias("n")).repartition("key")
        cold = cold.groupBy("key").agg(*[F.sum(p * F.col("n")).alias(f"c{i}") for i, p in enumerate(part_columns(F.col("v").cast("double")))])
        size = lambda i: F.col("items" if i else "bytes")
        means = [(F.get("x", F.lit(i)) + F.coalesce(f"c{i}", F.lit(0.0))) / size(i) for i in range(SUMS)]
        return docs.join(cold, "key", "left").select("key", F.array(*means).alias("x"))

    def score(self, x: Column) -> Column:
        z = F.lit(float(self.b))
        for i, weight in enumerate(self.weights):
            z = z + F.coalesce(F.get(x, F.lit(i)), F.lit(0.0)) * float(weight)
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit y to x: the normalised difference by itself first, then all sums beside LEAST_SHARE of its weight, with SIGNS."""
        if not len(x) or y.min() == y.max():
            base = (y.sum() + 0.5) / (len(y) + 2)
            self.b = float(np.log(base / (1 - base)))
            return
        least = LEAST_SHARE * logistic(x[:, :1], y, SIGNS[:1])[0][0]
        self.weights, self.b = logistic(x, y, SIGNS, least * x[:, 0])
        self.weights[0] += least


def logistic(x: np.ndarray, y: np.ndarray, signs: np.ndarray, offset: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Weights of the given signs and intercept of a logistic regression, by projected Newton steps with a weak pull to 0."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = np.inf
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    signs, beta = np.append(signs, 0.0), np.zeros(z.shape[1])

    def loss(beta: np.ndarray) -> float:
        s = z @ beta + offset
        return np.logaddexp(0, s).sum() - y @ s + 0.05 * beta @ beta

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta + offset, -40, 40)))
        slope = z.T @ (p - y) + 0.1 * beta
        free = ~((signs != 0) & (beta == 0) & (slope * signs > 0))  # others would leave their side
        weight = np.maximum(p * (1 - p), 1e-9)
        step = np.zeros(len(beta))
        step[free] = np.linalg.solve((z[:, free] * weight[:, None]).T @ z[:, free] + 0.1 * np.eye(int(free.sum())), -slope[free])
        size, before = 1.0, loss(beta)
        new = np.where(signs * (beta + step) < 0, 0.0, beta + step)
        while loss(new) > before and size > 1e-6:
            size /= 2
            new = np.where(signs * (beta + size * step) < 0, 0.0, beta + size * step)
        done = np.abs(new - beta).max() < 1e-9
        beta = new
        if done:
            break
    weights = beta[:-1] / scale
    return weights, float(beta[-1] - (weights * mean).sum())


def train(docs: DataFrame, labels: DataFrame, hot_terms: int = HOT_TERMS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic int). Four fifths of them are counted, the rest calibrates."""
    labels = labels.filter("toxic in (0, 1)").dropDuplicates(["doc_id"])
    rest = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    counted = labels.filter(~rest)
    small = counted.count() <= BROADCAST_LABELS
    rows = docs.join(F.broadcast(counted) if small else counted, "doc_id").select("doc_id", "text", "toxic")
    # a text that is copied counts once
    once = rows.groupBy(F.xxhash64("text", "toxic").alias("t")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    rows = rows.join(F.broadcast(once) if small else once, "doc_id", "left_semi").select("text", "toxic")
    model = Model(cut(terms(rows), "terms"), hot_terms)
    sample = labels.filter(rest).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CALIBRATION_ROWS)
    rows = docs.join(F.broadcast(sample), "doc_id").select(text_key(F.col("text")).alias("key"), "text", F.col("toxic").cast("double").alias("y"))  # at most CALIBRATION_ROWS rows are sent
    found = rows.select("key", "y").join(model.evidence(rows.select("key", "text")), "key", "left").orderBy("key", "y").toArrow()
    model.calibrate(np.array([np.zeros(SUMS) if x is None else x for x in found.column("x").to_pylist()]).reshape(-1, SUMS), found.column("y").to_numpy())
    return model


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted.

    Only doc_id and text are read: further columns, whatever their names, play no part. Null texts, empty ones and texts
    without words have no evidence and get the score that the calibration gives to none. Texts of any length are read
    whole. Repeated rows and equal texts get equal scores, and a score of exactly THRESHOLD is predicted 1. Empty tables
    give no rows; with labels of one class only, all texts get about that class's share as their score, and 0.25, which is
    not toxic, without any.
    """
    if model.complete:
        hot, weights, b = model.hot, model.weights, model.b

        def work(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(_describe(batch.column("text"), hot.value.ready()), weights, b))], names=["doc_id", "score"])

        scored = whole_texts(docs).mapInArrow(work, "doc_id long, score double")
    else:
        rows = whole_texts(docs).select("doc_id", text_key(F.col("text")).alias("key"), "text")
        scored = rows.select("doc_id", "key").join(model.evidence(rows.select("key", "text")), "key", "left").select("doc_id", model.score(F.col("x")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic; nulls, empty texts and repeats as in toxicity()."""
    if model.complete:
        hot, weights, b, at = model.hot, model.weights, model.b, docs.columns.index("text")

        def keep(batches):
            for batch in batches:
                text = batch.column(at) if pa.types.is_string(batch.schema.field(at).type) else pc.cast(batch.column(at), pa.string())
                yield batch.filter(pa.array(_scores(_describe(text, hot.value.ready()), weights, b) < THRESHOLD))

        return docs.mapInArrow(keep, docs.schema)
    rows = whole_texts(docs).select(text_key(F.col("text")).alias("key"), "text")
    scored = model.evidence(rows)
    toxic = scored.filter(model.score(F.col("x")) >= THRESHOLD).select(F.col("key").alias("toxic_key"))
    if 1 / (1 + np.exp(-np.clip(model.b, -40, 40))) >= THRESHOLD:  # texts without words too
        known = scored.filter(model.score(F.col("x")) < THRESHOLD).select(F.col("key").alias("kept_key"))
        return docs.join(known, text_key(docs["text"]) == known["kept_key"], "left_semi")
    return docs.join(toxic, text_key(docs["text"]) == toxic["toxic_key"], "left_anti")


HELD_OUT = (4, 2)


def trained(spark: SparkSession, sf_dir: str) -> Model:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    docs = whole_texts(read(spark, sf_dir, "documents"))
    return train(docs, labels.filter(~fold_in(F.col("doc_id"), *HELD_OUT)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(read(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return out.select("doc_id", fold_in(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score", "predicted")
