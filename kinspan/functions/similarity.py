"""Similarities of strings and sets, as column expressions; null where a side has nothing to compare."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's elements that b has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, F.least(F.char_length(a), F.char_length(b)) / longest)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits per step."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of the three ratios between shared words and shared words with each side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (x <= y or y <= x):
        return 1.0
    rest_a, rest_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    core = len(" ".join(sorted(shared)))
    gap = int(core > 0)
    full_a, full_b = core + gap + len(rest_a), core + gap + len(rest_b)
    best = 1 - (len(rest_a) + len(rest_b) - 2 * lcs(rest_a, rest_b)) / (full_a + full_b)
    if not core:
        return best
    return max(best, 1 - (gap + len(rest_a)) / (core + full_a), 1 - (gap + len(rest_b)) / (core + full_b))


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple, float | None] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if (x, y) not in seen:
                seen[x, y] = f(x, y) if x and y else None
            out.append(seen[x, y])
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


indel_ratio = _pairwise(indel)
token_sort_ratio = _pairwise(token_sort)
token_set_ratio = _pairwise(token_set)


def indel_ratio_native(a: Column, b: Column) -> Column:
    """The indel ratio as nested folds over characters, for plans without Python; slower than the batched function."""
    left, right = F.split(a, ""), F.split(b, "")
    letters = F.filter(right, lambda x: x != "")

    def row(previous: Column, ch: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("cells"), F.lit(1).alias("j"))

        def cell(acc: Column, other: Column) -> Column:
            last = F.element_at(acc["cells"], acc["j"])
            value = F.when(other == ch, F.element_at(previous, acc["j"]) + 1).otherwise(F.greatest(last, F.element_at(previous, acc["j"] + 1)))
            return F.struct(F.concat(acc["cells"], F.array(value)).alias("cells"), (acc["j"] + 1).alias("j"))

        return F.aggregate(letters, start, cell, lambda acc: acc["cells"])

    zeros = F.array_repeat(F.lit(0), (F.size(letters) + 1).cast("int"))
    last = F.aggregate(F.filter(left, lambda x: x != ""), zeros, row)
    total = F.char_length(a) + F.char_length(b)
    return F.when((F.char_length(a) > 0) & (F.char_length(b) > 0), 2.0 * F.element_at(last, -1) / total)


def register(spark: SparkSession) -> None:
    """Makes the batched functions callable from SQL."""
    for name, f in (("indel_ratio", indel_ratio), ("token_sort_ratio", token_sort_ratio), ("token_set_ratio", token_set_ratio)):
        spark.udf.register(name, f)
