"""Stacking inputs on top of each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators.places import written
from gristmill.values import column

#: Repeated row hashes that are broadcast at most, 16 bytes each.
MOST_HASHES = 1_000_000


def row_hashes(df: DataFrame) -> list[Column]:
    """Two hashes of whole rows, null told from any value."""
    cells = [x for n in df.columns for x in (column(n).isNull(), column(n))]
    return [F.xxhash64(F.lit(seed), *cells) for seed in (1, 2)]


def distinct_rows(df: DataFrame, hashes: Sequence[Column] | None = None, most: int = MOST_HASHES) -> DataFrame:
    """The distinct rows of ``df``, equal to ``df.distinct()``, without moving rows that occur once.

    Only 128-bit hashes of rows are exchanged; rows whose hash no other row has
    stay where they are, and the others are compared in full, so a clash of
    hashes costs time, never a row.  With more than ``most`` repeated hashes, and
    on streams, it is the plain distinct.  Runs a job.
    """
    plain = df.isStreaming or any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields)
    if plain or not df.columns:
        return df.distinct()
    first, second = hashes or row_hashes(df)
    marked = df.withColumns({"_row_h0": first, "_row_h1": second})
    repeated = written(marked.groupBy("_row_h0", "_row_h1").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_row_h0", "_row_h1"))
    if repeated.count() > most:
        return df.distinct()
    small, by = F.broadcast(repeated), ["_row_h0", "_row_h1"]  # counted
    once = marked.join(small, by, "left_anti").select(*map(column, df.columns))
    return once.union(marked.join(small, by, "left_semi").select(*map(column, df.columns)).distinct())


def stack(inputs: Sequence[DataFrame], by_name: bool = True, distinct: bool = False) -> DataFrame:
    """UNION ALL by name (missing columns null) or by position (names of the first); then distinct if asked (``distinct_rows``)."""
    if not inputs:
        raise ValueError("nothing to stack")
    if by_name:
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
    else:
        widths = {len(d.columns) for d in inputs}
        if len(widths) > 1:
            raise ValueError(f"inputs of {' and '.join(map(str, sorted(widths)))} columns cannot be stacked by position")
        out = reduce(lambda a, b: a.union(b), inputs)
    return distinct_rows(out) if distinct else out


def alignment_report(inputs: Sequence[DataFrame]) -> DataFrame:
    """Column × input: position, presence and type, from the schemas alone."""
    spark = inputs[0].sparkSession
    names = list(dict.fromkeys(n for d in inputs for n in d.columns))
    rows = [
        (n, k, n in d.columns, d.columns.index(n) + 1 if n in d.columns else None, d.schema[n].dataType.simpleString() if n in d.columns else None)
        for n in names
        for k, d in enumerate(inputs, 1)
    ]
    return spark.createDataFrame(rows, "column string, input int, present boolean, position int, type string")
