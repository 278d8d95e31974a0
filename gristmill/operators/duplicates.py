"""Duplicate rows by key: what to keep, what repeats, what is unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gristmill.operators.places import HOT_ROWS, numbered
from gristmill.values import column, join_back, ordering, require, total_order


def _order(df: DataFrame, order_by: Sequence[str | tuple[str, bool]], keep: str) -> list[Column]:
    """The order in which the kept row of a key comes first; all columns break ties."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    if keep == "first":
        return total_order(df, order_by)
    total_order(df, order_by)  # the same checks
    named = [i if isinstance(i, tuple) else (i, False) for i in order_by]
    rest = [n for n in df.columns if n not in {p for p, _ in named} and not isinstance(df.schema[n].dataType, T.MapType)]
    return [column(n).asc_nulls_first() if down else column(n).desc_nulls_first() for n, down in [*named, *[(r, False) for r in rest]]]


def _ranked(df: DataFrame, keys: Sequence[str], order: list[Column], upto: int) -> DataFrame:
    """The first ``upto`` rows of each key with their place ``_rn``; each task takes its own first ones before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*map(column, keys)).orderBy(*order))).where(F.col("_rn") <= upto)


def duplicates(
    df: DataFrame, keys: Sequence[str] | None, order_by: Sequence[str | tuple[str, bool]] | None = None, keep: str = "first", dups_mode: str = "all", sort: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> dict[str, DataFrame]:
    """``kept`` (one row per key), ``uniques`` (keys that occur once) and ``dups``.

    No keys compares whole rows.  Nulls in keys are equal.  ``dups_mode`` is
    all, exemplar (one per repeated key) or extra (all but the kept).  Row order
    decides what is kept, so give ``order_by``; whole-row keys need none.
    ``sort`` orders the dups by key, which is a second shuffle.  For ``extra``
    the rows of a key are ordered in one task, or over several if there are more
    than ``hot_rows`` (None leaves out the count).  Not for streaming input.
    """
    whole = not keys
    keys = list(keys or df.columns)
    require(df, keys)
    order = _order(df, order_by or (keys if whole else None), keep)
    # the first row tells what is kept, the first two whether the key is repeated: a hot key is cut to them map-side
    two = _ranked(df, keys, order, 2).withColumn("_n", F.max("_rn").over(W.partitionBy(*map(column, keys))))
    if dups_mode == "exemplar":
        dups = two.where("_n = 2 and _rn = 1")
    elif dups_mode == "all":
        dups = join_back(df, df.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias("_n")), keys, ["_n"]).where("_n > 1")
    elif dups_mode == "extra":
        dups = numbered(df, keys, order, "_rn", hot_rows).where("_rn > 1")  # which rows these are takes the order within each key
    else:
        raise ValueError("dups_mode is all, exemplar or extra")
    clean = lambda d: d.drop("_n", "_rn")
    return {"kept": clean(_ranked(df, keys, order, 1)), "uniques": clean(two.where("_n = 1")), "dups": clean(dups).orderBy(*ordering(keys)) if sort else clean(dups)}


def duplicate_counts(df: DataFrame, keys: Sequence[str] | None = None, dups_mode: str = "all") -> DataFrame:
    """One row of counts from the key counts alone; rows themselves are not moved."""
    keys = list(keys or df.columns)
    require(df, keys)
    per = df.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") > 1
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    dups = {"all": total(F.when(more, F.col("n"))), "exemplar": F.count_if(more), "extra": total(F.when(more, F.col("n") - 1))}[dups_mode]
    return per.agg(
        total(F.col("n")).alias("total"), F.count_if(more).alias("dup_groups"), total(F.when(more, F.col("n"))).alias("dup_rows"),
        total(F.when(more, F.col("n") - 1)).alias("extra"), F.count(F.lit(1)).alias("kept"), F.count_if(F.col("n") == 1).alias("uniques"), dups.alias("dups"),
    )
