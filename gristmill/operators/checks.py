"""Checks over groups of rows: every row gets its group's verdict.

All checks that share their keys come from one grouped aggregate, joined back
with null-safe equality.  Distinct counts, however many, come from one long
plan beside it: a row gives a hash of its value to each check that counts it,
equal (key, check, hash) are merged early, and what is left is counted.  A row
passes if its group passes all checks; a group in which no row meets a check's
premise passes that check.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.rules import dnf
from gristmill.values import as_text, column, fold, is_text, join_safe, numeric, require

COMPARE = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
}


def _value(df: DataFrame, name: str, case_sensitive: bool) -> Column:
    """The value that is compared: folded text, or the value itself."""
    return fold(column(name), case_sensitive) if is_text(df, name) else column(name)


def _text(df: DataFrame, name: str, case_sensitive: bool) -> Column:
    return fold(F.coalesce(as_text(df, name), F.lit("")), case_sensitive)


def hashes(*cs: Column) -> list[Column]:
    """Two 64-bit hashes that tell values apart, null from all others; -0.0 is 0.0."""
    marked = [x for c in cs for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *marked) for seed in (1, 2)]


class Parts:
    """What the verdicts of a set of checks need: aggregates, and distinct counts, each under a name of its own."""

    def __init__(self):
        self.aggregates: list[Column] = []
        self.distincts: list[tuple[Column, list[Column]]] = []

    def of(self, aggregate: Column) -> Column:
        self.aggregates.append(aggregate)
        return F.col(f"_agg_{len(self.aggregates) - 1}")

    def count_if(self, p: Column) -> Column:
        return self.of(F.count_if(p))

    def distinct(self, p: Column, *cs: Column) -> Column:
        """Distinct values among rows that meet ``p``; null counts as a value."""
        self.distincts.append((p, hashes(*cs)))
        return F.coalesce(F.col(f"_distinct_{len(self.distincts) - 1}"), F.lit(0))

    def at_most_one(self, p: Column, *cs: Column) -> Column:
        """Whether the rows that meet ``p`` have one value at most; null counts as a value.  Needs no distinct count, and its buffers are numbers whatever the type."""
        ends = [(self.of(F.min(F.when(p, h))), self.of(F.max(F.when(p, h)))) for h in hashes(*cs)]
        return reduce(lambda x, y: x & y, [F.coalesce(low == high, F.lit(True)) for low, high in ends])

    def per_key(self, df: DataFrame, keys: Sequence[Column]) -> DataFrame:
        """One row per key ``_g0, _g1, …`` with all parts."""
        names = [f"_g{i}" for i in range(len(keys))]
        named = [k.alias(n) for k, n in zip(keys, names)]
        out = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_agg_rows"), *[c.alias(f"_agg_{k}") for k, c in enumerate(self.aggregates)])
        if not self.distincts:
            return out
        seen = F.array(*[F.when(p, F.struct(F.lit(k).alias("_check"), *[h.alias(f"_h{i}") for i, h in enumerate(hs)])) for k, (p, hs) in enumerate(self.distincts)])
        rows = df.select(*named, F.explode(seen).alias("_seen")).where("_seen is not null").select(*names, "_seen.*")
        each = rows.groupBy(*names, "_check", "_h0", "_h1").agg(F.lit(1).alias("_one"))
        counts = each.groupBy(*names).agg(*[F.count_if(F.col("_check") == k).alias(f"_distinct_{k}") for k in range(len(self.distincts))])
        return join_safe(out, counts, names, "left") if names else out.crossJoin(F.broadcast(counts))  # one row each


def check_verdict(df: DataFrame, check: dict[str, Any], parts: Parts, case_sensitive: bool = False) -> Column | None:
    """The verdict of one check over the parts it has asked for, or None if it is not configured."""
    kind, name, other, raw = check.get("check") or check.get("type"), check.get("column"), check.get("column2"), check.get("value")
    p = dnf(df, check["when"], case_sensitive) if (check.get("when") or {}).get("groups") else F.lit(True)
    guarded = lambda v: F.coalesce(v, F.lit(True)) | (parts.count_if(p) == 0)
    if kind == "rows_satisfy":
        if not (check.get("then") or {}).get("groups"):
            return None
        return parts.count_if(p & ~dnf(df, check["then"], case_sensitive)) == 0
    if kind in ("size_eq", "size_min", "size_max", "distinct_eq", "distinct_min", "distinct_max"):
        try:
            n = int(check.get("n", raw))
        except (TypeError, ValueError):
            return None
        if kind.startswith("size"):
            got = parts.count_if(p)
        else:
            if not name:
                return None
            require(df, [name])
            if kind == "distinct_max" and n == 1:
                return guarded(parts.at_most_one(p, _value(df, name, case_sensitive)))
            got = parts.distinct(p, _value(df, name, case_sensitive))
        return guarded({"eq": got == n, "min": got >= n, "max": got <= n}[kind.split("_")[1]])
    if not name:
        return None
    require(df, [name, *([other] if other else [])])
    c, v = column(name), _value(df, name, case_sensitive)
    if kind == "no_null":
        return guarded(parts.count_if(p & c.isNull()) == 0)
    if kind == "not_all_null":
        return guarded(parts.count_if(p & c.isNotNull()) > 0)
    if kind == "all_null":
        return guarded(parts.count_if(p & c.isNotNull()) == 0)
    if kind == "unique":
        return guarded(parts.distinct(p, v) == parts.count_if(p))
    if kind == "constant":
        return guarded(parts.at_most_one(p, v))
    if kind in ("contains", "not_contains"):
        if other:
            hit = _text(df, name, case_sensitive).contains(_text(df, other, case_sensitive))
        elif raw is None or str(raw) == "":
            return None
        else:
            hit = fold(as_text(df, name), case_sensitive) == (str(raw) if case_sensitive else str(raw).lower())
        n = parts.count_if(p & F.coalesce(hit, F.lit(False)))
        return guarded(n > 0 if kind == "contains" else n == 0)
    if not other:
        return None
    if kind == "rows_cols_cmp":
        op = check.get("op") or "eq"
        if op in ("eq", "ne"):
            ok = COMPARE[op](_text(df, name, case_sensitive), _text(df, other, case_sensitive))
        else:
            ok = COMPARE[op](numeric(df, name), numeric(df, other))
        return guarded(parts.count_if(p & ~F.coalesce(ok, F.lit(False))) == 0)
    if kind == "distinct_cmp":
        return guarded(COMPARE[check.get("op") or "eq"](parts.distinct(p, v), parts.distinct(p, _value(df, other, case_sensitive))))
    if kind == "determines":
        return guarded(parts.distinct(p, v) == parts.distinct(p, v, _value(df, other, case_sensitive)))
    raise ValueError(f"unknown check {kind}")


def group_verdicts(df: DataFrame, keys: Sequence[str], conditions: dict[str, Sequence[dict[str, Any]]], case_sensitive: bool = False) -> DataFrame:
    """Add one boolean column per named list of checks, all over the same keys.

    Keys are compared as values with nulls equal, folded like checked text.  No
    keys: the whole table is one group.
    """
    require(df, keys)
    parts, verdicts = Parts(), {}
    for name, checks in conditions.items():
        each = [v for v in (check_verdict(df, c, parts, case_sensitive) for c in checks) if v is not None]
        if not each:
            raise ValueError(f"{name}: no check is configured")
        verdicts[name] = reduce(lambda a, b: a & b, each)
    folded = [_value(df, k, case_sensitive) for k in keys]
    names = [f"_g{i}" for i in range(len(keys))]
    per = parts.per_key(df, folded).select(*names, *[v.alias(n) for n, v in verdicts.items()])
    if not keys:
        return df.crossJoin(F.broadcast(per))  # one row
    on = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(n)) for k, n in zip(folded, names)])
    return df.join(per, on, "left").drop(*names)


def group_verdict(df: DataFrame, keys: Sequence[str], checks: Sequence[dict[str, Any]], case_sensitive: bool = False, name: str = "verdict") -> DataFrame:
    """Add the verdict of one list of checks."""
    return group_verdicts(df, keys, {name: checks}, case_sensitive)
