"""Projection, predicates, joins, grouping, ordering: the everyday query operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.places import medians
from gristmill.operators.stacking import distinct_rows
from gristmill.values import as_text, column, is_numeric, join_safe, ordering, place_key, require, total_order

# --- projection --------------------------------------------------------------


def select_items(df: DataFrame, items: Sequence[dict[str, Any]] | None = None, distinct: bool = False) -> DataFrame:
    """Select columns ``{column, alias}`` or expressions ``{expression, alias}``; nothing listed selects all.

    ``distinct`` keeps one of equal rows (``stacking.distinct_rows``, which runs a job).
    """
    out = []
    for item in items or ():
        if item.get("expression"):
            c, name = F.expr(item["expression"]), item.get("alias") or item["expression"]
        else:
            require(df, [item["column"]])
            c, name = column(item["column"]), item.get("alias") or item["column"]
        out.append(c.alias(name))
    df = df.select(*out) if out else df
    return distinct_rows(df) if distinct else df


def select_columns(df: DataFrame, items: Sequence[dict[str, Any]]) -> DataFrame:
    """Order, drop and rename by ``{name, keep, rename}``; unlisted columns follow, unknown names are ignored.

    The first item of a name counts.
    """
    told = {i["name"]: i for i in reversed(items)}
    listed = dict.fromkeys(i["name"] for i in items if i["name"] in df.columns)
    order = {n: told.get(n, {}) for n in [*listed, *df.columns]}
    names = {n: how.get("rename") or n for n, how in order.items() if how.get("keep", True)}
    repeated = [n for n, k in Counter(names.values()).items() if k > 1]
    if not names or repeated:
        raise ValueError(f"names used twice: {', '.join(sorted(repeated))}" if repeated else "no column is kept")
    return df.select(*[column(n).alias(new) for n, new in names.items()])


def sql_over(spark: SparkSession, query: str, **inputs: DataFrame) -> DataFrame:
    """Run SQL over named inputs, written as ``{name}`` in the query, with the session's own rights."""
    return spark.sql(query, **inputs)


# --- predicates --------------------------------------------------------------

COMPARISONS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def literal(value: Any, kind: str = "text") -> Column:
    """A typed literal: text, number, boolean, or raw (an SQL expression)."""
    if kind == "raw":
        return F.expr(str(value))
    if kind == "number":
        if isinstance(value, bool):
            raise ValueError(f"not a number: {value!r}")
        if isinstance(value, (int, float)):
            return F.lit(value)
        text = str(value).strip()
        try:
            return F.lit(int(text)) if text.lstrip("+-").isdigit() else F.lit(float(text))
        except ValueError as e:
            raise ValueError(f"not a number: {value!r}") from e
    if kind == "boolean":
        return F.lit(str(value).strip().lower() in ("true", "1", "yes", "oui", "vrai"))
    return F.lit(str(value))


def predicate(op: str, left: Column | str, value: Any = None, value2: Any = None, value_type: str = "text") -> Column:
    """One WHERE or HAVING condition."""
    c = column(left) if isinstance(left, str) else left
    op = op.strip().upper()
    if op in COMPARISONS:
        return COMPARISONS[op](c, literal(value, value_type))
    if op in ("LIKE", "NOT LIKE"):
        got = c.like(str(value))
    elif op == "ILIKE":
        got = c.ilike(str(value))
    elif op in ("IN", "NOT IN"):
        items = value if isinstance(value, (list, tuple)) else [x.strip() for x in str(value or "").split(",")]
        items = [x for x in items if x != ""]
        if not items:
            raise ValueError("an empty list")
        got = c.isin(*[literal(x, value_type) for x in items])
    elif op == "IS NULL":
        return c.isNull()
    elif op == "IS NOT NULL":
        return c.isNotNull()
    elif op == "BETWEEN":
        return c.between(literal(value, value_type), literal(value2, value_type))
    else:
        raise ValueError(f"unknown operator {op}")
    return ~got if op.startswith("NOT ") else got


def chain(conditions: Sequence[tuple[str, Column]]) -> Column:
    """A flat AND/OR list, each condition with the connector before it; AND binds tighter."""
    if not conditions:
        return F.lit(True)
    runs: list[list[Column]] = [[conditions[0][1]]]
    for connector, c in conditions[1:]:
        if connector.upper() == "OR":
            runs.append([c])
        else:
            runs[-1].append(c)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, run) for run in runs])


# --- joins -------------------------------------------------------------------


def join_inputs(left: DataFrame, joins: Sequence[tuple[DataFrame, str, Sequence[tuple[str, str]]]]) -> DataFrame:
    """Join further inputs in turn: ``(right, inner|left|right|full|cross, [(left column, right column), …])``.

    A left column may come from any earlier input.  Pairs are ANDed equalities,
    so Catalyst sees equi-joins and picks the strategy.
    """
    out = left
    for right, how, pairs in joins:
        clash = [c for c in right.columns if c in out.columns]
        if clash:
            raise ValueError(f"columns on both sides, rename them first: {', '.join(clash)}")
        if how == "cross":
            out = out.crossJoin(right)
            continue
        if how not in ("inner", "left", "right", "full"):
            raise ValueError(f"unknown join {how}")
        if not pairs:
            raise ValueError("a join needs a pair of columns")
        require(out, [a for a, _ in pairs])
        require(right, [b for _, b in pairs])
        out = out.join(right, reduce(lambda x, y: x & y, [out[f"`{a}`"] == right[f"`{b}`"] for a, b in pairs]), how)
    return out


# --- aggregation -------------------------------------------------------------


def aggregate_column(df: DataFrame, func: str, name: str | None, order_by: Sequence[str | tuple[str, bool]] | None = None) -> Column:
    """One aggregate by name; FIRST, LAST and STRING_AGG need an order."""
    func = func.upper()
    if name is None:
        if func != "COUNT":
            raise ValueError(f"{func} needs a column")
        return F.count(F.lit(1))
    require(df, [name])
    c = column(name)
    simple = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "COUNT_DISTINCT": F.count_distinct, "MEDIAN": F.median, "STDDEV": F.stddev_samp}
    if func in simple:
        return simple[func](c)
    if func not in ("FIRST", "LAST", "STRING_AGG"):
        raise ValueError(f"unknown aggregate {func}")
    total_order(df, order_by)  # an order is required
    if func == "STRING_AGG":
        # the order travels with the value, so the text does not depend on how rows were dealt
        sort = [i if isinstance(i, tuple) else (i, False) for i in order_by]
        rows = F.collect_list(F.when(c.isNotNull(), F.struct(*[column(n).alias(f"k{k}") for k, (n, _) in enumerate(sort)], as_text(df, name).alias("v"))))

        def compare(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for f, down in reversed([*((f"k{k}", d) for k, (_, d) in enumerate(sort)), ("v", False)]):
                less, more = (a[f] > b[f], a[f] < b[f]) if down else (a[f] < b[f], a[f] > b[f])
                out = (
                    F.when(a[f].isNull() & b[f].isNull(), out).when(a[f].isNull(), F.lit(1)).when(b[f].isNull(), F.lit(-1))
                    .when(less, F.lit(-1)).when(more, F.lit(1)).otherwise(out)
                )
            return out

        texts = F.transform(F.array_sort(rows, compare), lambda x: x["v"])
        return F.when(F.size(rows) > 0, F.array_join(texts, ", "))
    key, down = place_key(df, order_by)
    return (F.min_by if (func == "FIRST") != down else F.max_by)(c, key)


def aggregate(
    df: DataFrame, group_by: Sequence[str], items: Sequence[tuple[str, str | None, str]], order_by: Sequence[str | tuple[str, bool]] | None = None,
    having: Sequence[tuple[str, str, str | None, str, Any]] | None = None,
) -> DataFrame:
    """Group and aggregate ``(function, column, alias)``; no keys is one global row.

    ``having`` lists ``(connector, function, column, operator, number)``; its
    helper columns are dropped.  Medians of numbers are found by rank and joined
    to the other aggregates, so no group's values meet in one task.
    """
    require(df, group_by)
    names = [*group_by, *[a for _, _, a in items]]
    if len(set(names)) != len(names):
        raise ValueError("names used twice")
    wanted = [*items, *[(f, c, f"_having_{k}") for k, (_, f, c, _, _) in enumerate(having or ())]]
    middles = {a: column(c) for f, c, a in wanted if f.upper() == "MEDIAN" and c in df.columns and is_numeric(df, c)}
    aggs = [aggregate_column(df, f, c, order_by).alias(a) for f, c, a in wanted if a not in middles]
    out = df.groupBy(*map(column, group_by)).agg(*aggs) if aggs or not middles else None
    if middles:
        found = medians(df, group_by, middles)
        out = found if out is None else join_safe(out, found, group_by, "left") if group_by else out.crossJoin(F.broadcast(found))  # one row each
        out = out.select(*map(column, group_by), *[column(a) for _, _, a in wanted])
    if having:
        out = out.where(chain([(con, predicate(op, F.col(f"_having_{k}"), v, value_type="number")) for k, (con, _, _, op, v) in enumerate(having)]))
        out = out.drop(*[f"_having_{k}" for k in range(len(having))])
    return out


def sort_limit(df: DataFrame, order_by: Sequence[str | tuple[str, bool]] = (), limit: int | str | None = None) -> DataFrame:
    """Order by keys with nulls last, then limit; 0 or blank is no limit."""
    if order_by:
        df = df.orderBy(*ordering(order_by))
    if limit in (None, "", 0):
        return df
    try:
        n = int(limit)
    except (TypeError, ValueError) as e:
        raise ValueError(f"not a row count: {limit!r}") from e
    return df.limit(n) if n else df
