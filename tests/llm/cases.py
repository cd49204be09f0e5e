"""Documents with the hard cases: nulls, empty and long texts, ties, repeats, copies and near copies."""

import random

WORDS = ["the", "of", "tion", "and", "re", "in", "éau", "that", "ing", "or", "a|b", "x***", "Über", "the,", "12", "日本"]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n)).strip()


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([30, 60, 70, 120])) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows and (own := (rng.choice(rows)[1] or "").split(" ")):
            own[rng.randrange(len(own))] = "changed"
            text = " ".join(own)
        elif kind == 2:
            text = " ".join([prose(rng, rng.randrange(40)), rng.choice(passages), prose(rng, rng.randrange(40)), rng.choice(passages)])
        else:
            text = prose(rng, rng.randrange(1, 200))
        rows.append((i * 3 % 181, text, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(text or "")))
    rows += [(900, None, None, None, 0), (901, "", "en", "s0", 0), (902, " \n ", "en", "s0", 3), (903, "a" * 700, "en", "s1", 700), (904, "la la " * 200, "en", "s1", 1200)]
    rows += [(905, "la la " * 120 + "end", "en", "s1", 723), (906, "one two three " * 90, "en", "s1", 0), (907, ("one two three " * 90)[4:], None, "s1", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows=None):
    """With further columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.select("*", *[F.lit(1).alias(c) for c in ("doc", "h", "size", "digest", "shard", "n", "spans", "tie", "kept", "class_id", "rid", "p", "word")])
