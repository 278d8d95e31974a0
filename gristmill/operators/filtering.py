"""Membership filters: keep or exclude rows whose key is in a reference table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.values import as_text, column, fold, require


#: Types whose values are equal where their texts are, so that they are compared as they are.
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.BooleanType)


def _keys(df: DataFrame, ref: DataFrame, pairs: Sequence[tuple[str, str]], case_insensitive: bool) -> tuple[list[Column], DataFrame]:
    """Key columns of ``df``, and the reference keys as ``_ref_0``, ``_ref_1`` …; nulls are left out of the reference."""
    require(df, [a for a, _ in pairs])
    require(ref, [b for _, b in pairs])
    left, right = [], []
    for i, (a, b) in enumerate(pairs):
        kind = df.schema[a].dataType
        if kind == ref.schema[b].dataType and isinstance(kind, EXACT):
            one, other = column(a), column(b)
        else:
            one, other = (fold(as_text(d, n), not case_insensitive) for d, n in ((df, a), (ref, b)))
        left.append(one)
        right.append(other.alias(f"_ref_{i}"))
    return left, ref.select(*right).dropna()


def membership_filter(df: DataFrame, ref: DataFrame, pairs: Sequence[tuple[str, str]], keep: bool = True, case_insensitive: bool = False) -> DataFrame:
    """Rows of ``df`` whose key columns equal those of some reference row, as text (whole numbers, dates and such of one type as they are); ``keep=False`` for all others.

    A null in a key never matches, so excluding keeps rows with a null key.
    Works on a streaming ``df`` with a static reference.  The reference is not
    made distinct first: then both sides exchange, and a hot key can be split.
    """
    if not pairs:
        raise ValueError("a membership filter needs a pair of columns")
    left, keys = _keys(df, ref, pairs, case_insensitive)
    on = reduce(lambda a, b: a & b, [k == F.col(f"_ref_{i}") for i, k in enumerate(left)])
    return df.join(keys, on, "left_semi" if keep else "left_anti")


def membership_counts(df: DataFrame, ref: DataFrame, pairs: Sequence[tuple[str, str]], case_insensitive: bool = False, keep: bool = True) -> DataFrame:
    """One row: total_main, total_ref, matches, kept, excluded, null_keys."""
    left, keys = _keys(df, ref, pairs, case_insensitive)
    keys = keys.distinct().withColumn("_hit", F.lit(True))
    names = [f"_key_{i}" for i in range(len(left))]
    # rows are counted per key before the join, so a hot key is one row in it
    per = df.select(*[k.alias(n) for n, k in zip(names, left)]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    on = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"_ref_{i}") for i, n in enumerate(names)])
    null = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    hit = F.col("_hit").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    counts = per.join(keys, on, "left").agg(
        total(F.lit(True)).alias("total_main"), total(hit).alias("matches"), total(hit if keep else ~hit).alias("kept"),
        total(~hit if keep else hit).alias("excluded"), total(null).alias("null_keys"),
    )
    return counts.crossJoin(ref.agg(F.count(F.lit(1)).alias("total_ref")))
