"""Rule tables, as lists that callers pass, compiled to column expressions: no join, no Python per row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def first_match(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """The value of the first case that holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for condition, value in reversed(cases):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def keyword_class(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """The name of the first rule (name, keywords) of which the text contains a keyword."""
    return first_match([(contains_any(text, words), name) for name, words in rules], default)


def rewrite(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular expressions replaced one after the other."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def first_rule_value(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The value of the first rule (keyword, value) whose keyword the text contains; null if none."""
    return first_match([(F.contains(text, F.lit(word)), value) for word, value in rules])


def fold_pack(parts: Column, limit: Column, size=F.length, joint: str = "\n\n", block: int = 128) -> Column:
    """Greedy packing: parts join the open pack as long as it stays within the limit; a part above it stands alone.

    Parts are folded block by block. Closed packs are appended to their block's array only, and a block hands its open pack
    on, so that n packs cost n * block copies at most and not n * n.
    """
    none = F.expr("cast(array() as array<string>)")
    start = F.array(F.struct(none.alias("done"), F.lit(None).cast("string").alias("open")))

    def step(state: Column, part: Column) -> Column:
        joined = F.concat(state["open"], F.lit(joint), part)
        fits = state["open"].isNull() | (size(joined) <= limit)
        done = F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), F.when(state["open"].isNull(), part).when(fits, joined).otherwise(part).alias("open"))

    def fold(states: Column, own: Column) -> Column:
        return F.concat(states, F.array(F.aggregate(own, F.struct(none.alias("done"), F.element_at(states, -1)["open"].alias("open")), step)))

    def close(states: Column) -> Column:
        return F.concat(F.flatten(F.transform(states, lambda s: s["done"])), F.filter(F.array(F.element_at(states, -1)["open"]), lambda x: x.isNotNull()))

    def blocks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(block)), lambda i: F.slice(p, i, block))

    # as an element, the parts' own expression is evaluated once for all blocks
    packed = F.transform(F.array(parts), lambda p: F.aggregate(blocks(p), start, fold, close))
    return F.when(parts.isNotNull(), F.get(packed, F.lit(0)))
