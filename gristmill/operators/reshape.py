"""Pivot and unpivot."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.places import medians
from gristmill.operators.relational import aggregate_column
from gristmill.values import as_text, column, is_numeric, require


#: A pivot of more columns than this is an error, as Spark's own pivot has it.
MOST_COLUMNS = 10_000


def pivot_values(df: DataFrame, pivot: str, most: int = MOST_COLUMNS) -> list[str]:
    """The column names a pivot will have: distinct non-null values as text, sorted; more than ``most`` is an error."""
    rows = df.where(column(pivot).isNotNull()).select(as_text(df, pivot).alias("v")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{pivot} has more than {most} values; give the values to pivot or raise the limit")
    return sorted(r["v"] for r in rows)


def pivot_table(
    df: DataFrame, index: Sequence[str], pivot: str, value: str, agg: str = "SUM",
    values: Sequence[Any] | None = None, order_by: Sequence[str | tuple[str, bool]] | None = None,
) -> DataFrame:
    """One row per index key, one column per pivot value.

    Rows with a null index or pivot value vanish; the sum of only nulls is 0; a
    missing cell is null.  Give ``values`` to spare the job that finds them.
    """
    if not index:
        raise ValueError("a pivot needs an index column")
    require(df, [*index, pivot, value])
    names = list(values) if values is not None else pivot_values(df, pivot)
    clash = [n for n in names if n in index]
    if clash:
        raise ValueError(f"pivot values named like an index column: {', '.join(clash)}")
    rows = df.dropna(subset=[*index, pivot]).withColumn("_pivot", as_text(df, pivot))
    if agg.upper() == "MEDIAN" and is_numeric(df, value):
        # found by rank, one value a cell; a missing cell has none
        found = medians(rows, [*index, "_pivot"], {"_middle": column(value)})
        return found.groupBy(*map(column, index)).pivot("_pivot", names).agg(F.max("_middle")).select(*map(column, index), *[column(str(n)) for n in names])
    cell = aggregate_column(df, agg, value, order_by)
    if agg.upper() == "SUM":
        cell = F.coalesce(cell, F.lit(0).cast(dict(df.groupBy().agg(cell.alias("x")).dtypes)["x"]))
    # a count of rows tells a cell of nulls from a missing cell
    wide = rows.groupBy(*map(column, index)).pivot("_pivot", names).agg(cell.alias("v"), F.count(F.lit(1)).alias("n"))
    return wide.select(*map(column, index), *[F.when(column(f"{n}_n") > 0, column(f"{n}_v")).alias(str(n)) for n in names])


def unpivot_table(df: DataFrame, columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per value column; all other columns are ids; nulls stay.  Columns of mixed types become text."""
    require(df, columns)
    ids = [n for n in df.columns if n not in columns]
    if name in ids or value in ids or name == value:
        raise ValueError("names used twice")
    if len({df.schema[c].dataType for c in columns}) > 1:
        df = df.select(*map(column, ids), *[as_text(df, c).alias(c) for c in columns])
    return df.unpivot([column(i) for i in ids], [column(c) for c in columns], name, value)
