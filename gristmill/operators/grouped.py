"""Group values on every row.

Values of a whole group come from one aggregate, combined map-side and joined
back, so a key with a large share of the rows is never sorted in one task;
medians are found by rank (``gristmill.operators.places``); without keys the
join is with one row.  The functions that give each row its place in an order
(occurrence, prev, next, concat, and first and last beside them) are windows.
Keys of more than ``hot_rows`` rows are ordered over several tasks instead, run
by run, and every run gets from the others what it lacks; whether there are such
keys is counted beforehand.  ``concat`` puts a key's whole text on each of its
rows, so that text has to fit into one row in any case.  Not for streaming input.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.functions.rules import dnf
from gristmill.operators.places import HOT_ROWS, hot_keys, medians, neighbours, split_hot
from gristmill.values import as_text, column, join_back, numeric, one_direction, place_key, require, total_order

SUMMARIES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
ORDERED = ("occurrence", "first", "last", "prev", "next", "concat")


def with_group_columns(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | tuple[str, bool]] | None, functions: Sequence[dict[str, Any]], ties: str | None = "all_columns",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add one column per function ``{fn, name, column, enabled}``; an existing name is replaced.

    fn: occurrence, group_size, count_distinct, is_duplicate, sum, avg, min,
    max, median, share, first, last, prev, next, concat.  All see the input's
    columns, not each other's.  ``hot_rows`` None leaves out the count of large keys.
    """
    functions = [f for f in functions if f.get("enabled", True)]
    require(df, [*keys, *[f["column"] for f in functions if f.get("column")]])
    names = [f.get("name") or f["fn"] for f in functions]
    if len(set(names)) != len(names):
        raise ValueError("names used twice")
    kinds = {f["fn"] for f in functions}
    unknown = kinds - {"group_size", "count_distinct", "is_duplicate", "median", "share", *SUMMARIES, *ORDERED}
    if unknown:
        raise ValueError(f"unknown group function {', '.join(sorted(unknown))}")
    placed = kinds & (set(ORDERED) - {"first", "last"})
    # first and last are aggregates only where nothing else orders the key anyway
    at_ends = place_key(df, order_by, ties) if kinds & {"first", "last"} and not placed and one_direction(order_by) else None
    windows = {f"_fn_{k}": f for k, f in enumerate(functions) if f["fn"] in ORDERED and not at_ends}

    out = _ordered(df, keys, total_order(df, order_by, ties), windows, hot_rows) if windows else df
    wholes = {f"_fn_{k}": c for k, f in enumerate(functions) if f"_fn_{k}" not in windows and (c := _whole(f, at_ends)) is not None}
    if wholes:
        out = join_back(out, df.groupBy(*map(column, keys)).agg(*[c.alias(n) for n, c in wholes.items()]), keys, list(wholes))
    middles = {f"_fn_{k}": column(f["column"]) for k, f in enumerate(functions) if f["fn"] == "median"}
    if middles:
        out = join_back(out, medians(df, keys, middles), keys, list(middles))
    for k, f in enumerate(functions):
        if f["fn"] == "is_duplicate":
            both = list(dict.fromkeys([*keys, f["column"]]))
            out = join_back(out, df.groupBy(*map(column, both)).agg(F.count(F.lit(1)).alias(f"_fn_{k}")), both, [f"_fn_{k}"])
    out = out.withColumns({f"_fn_{k}": _finish(f, F.col(f"_fn_{k}")) for k, f in enumerate(functions)})
    for k, name in enumerate(names):
        out = out.withColumn(name, F.col(f"_fn_{k}")).drop(f"_fn_{k}") if name in df.columns else out.withColumnRenamed(f"_fn_{k}", name)
    return out


def _ordered(df: DataFrame, keys: Sequence[str], order: list[Column], windows: dict[str, dict[str, Any]], hot_rows: int | None) -> DataFrame:
    """The columns that depend on the order within a key: windows, and run by run for the keys that have more than ``hot_rows`` rows."""
    by = W.partitionBy(*map(column, keys)).orderBy(*order)
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    value = {n: as_text(df, f["column"]) if f["fn"] == "concat" else column(f["column"]) if f.get("column") else F.lit(None) for n, f in windows.items()}

    def window(n: str, fn: str) -> Column:
        if fn == "concat":
            texts = F.collect_list(value[n]).over(whole)
            return F.when(F.size(texts) > 0, F.array_join(texts, ", "))
        if fn in ("first", "last"):
            return (F.first if fn == "first" else F.last)(value[n]).over(whole)
        return (F.row_number() if fn == "occurrence" else F.lag(value[n]) if fn == "prev" else F.lead(value[n])).over(by)

    hot = hot_keys(df, keys, hot_rows) if hot_rows is not None else None
    cold, large = split_hot(df, hot, keys) if hot is not None else (df, None)
    parts = []
    if cold is not None:
        parts.append(cold.withColumns({n: window(n, f["fn"]) for n, f in windows.items()}))
    if large is not None:
        parts.append(neighbours(large, keys, order, {n: (f["fn"], value[n]) for n, f in windows.items()}))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _whole(f: dict[str, Any], at_ends: tuple[Column, bool] | None) -> Column | None:
    fn, c = f["fn"], column(f["column"]) if f.get("column") else None
    if fn == "group_size":
        return F.count(F.lit(1))
    if fn == "count_distinct":
        return F.count_distinct(c)
    if fn in SUMMARIES:
        return SUMMARIES[fn](c)
    if fn in ("first", "last") and at_ends:
        key, down = at_ends
        return (F.min_by if (fn == "first") != down else F.max_by)(c, key)
    return F.sum(c) if fn == "share" else None


def _finish(f: dict[str, Any], got: Column) -> Column:
    """The column of a function; ``got`` is what aggregates and windows have prepared for it."""
    fn = f["fn"]
    if fn == "share":
        return column(f["column"]).cast("double") / F.nullif(got.cast("double"), F.lit(0.0))
    if fn == "is_duplicate":
        return F.when(got > 1, "oui").otherwise("non")
    return got


def value_when(
    df: DataFrame, keys: Sequence[str], name: str, condition: dict[str, Any], source: str | Column, reducer: str = "first",
    order_by: Sequence[str | tuple[str, bool]] | None = None, fallback: Any = None, ties: str | None = "all_columns",
) -> DataFrame:
    """Take ``source`` on the rows that meet a rule condition, reduce it per group, give it to every row.

    reducer: first, last, min, max, sum, avg or concat.  Rows that do not match
    and nulls are ignored; ``fallback`` stands where nothing is left.
    """
    require(df, keys)
    src = column(source) if isinstance(source, str) else source
    met = dnf(df, condition, case_sensitive=True)
    v = F.when(met, src)
    if reducer in ("first", "last") and one_direction(order_by):
        key, down = place_key(df, order_by, ties)
        got = (F.min_by if (reducer == "first") != down else F.max_by)(v, F.when(v.isNotNull(), key))
    elif reducer in ("first", "last", "concat"):
        whole = W.partitionBy(*map(column, keys)).orderBy(*total_order(df, order_by, ties)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        texts = F.collect_list(v.cast("string")).over(whole)
        windowed = F.when(F.size(texts) > 0, F.array_join(texts, ", ")) if reducer == "concat" else (F.first if reducer == "first" else F.last)(v, ignorenulls=True).over(whole)
        got = None
    elif reducer in ("min", "max", "sum", "avg"):
        number = numeric(df, source) if isinstance(source, str) else src.cast("string").try_cast("double")
        got = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}[reducer](F.when(met, number))
    else:
        raise ValueError(f"unknown reducer {reducer}")
    if got is None:
        out = df.withColumn("_v", windowed)
    else:
        out = join_back(df, df.groupBy(*map(column, keys)).agg(got.alias("_v")), keys, ["_v"])
    if fallback is not None:
        kind = dict(out.dtypes)["_v"]
        out = out.withColumn("_v", F.coalesce("_v", F.lit(fallback).cast(kind) if kind != "string" else F.lit(str(fallback))))
    return out.withColumn(name, F.col("_v")).drop("_v") if name in df.columns else out.withColumnRenamed("_v", name)


def apply_group_functions(df: DataFrame, keys: Sequence[str], order_by, window: Sequence[dict[str, Any]] = (), when: Sequence[dict[str, Any]] = ()) -> DataFrame:
    """The window functions first, then each ``value_when`` in turn, which may use the columns before it."""
    if window:
        df = with_group_columns(df, keys, order_by, window)
    for f in when:
        df = value_when(df, f.get("keys") or keys, f["name"], f["condition"], f["source"], f.get("reducer", "first"), f.get("order_by") or order_by, f.get("fallback"))
    return df


