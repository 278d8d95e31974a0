"""Profiles of columns and keys, breakdowns, and previews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.functions.rules import mask, rule
from gristmill.operators.checks import hashes
from gristmill.operators.places import medians, written
from gristmill.values import NUMERIC, as_text, column, is_numeric, ordering, place_key, require, sure

EMPTY = "(vide)"
MET, UNMET = "Respecté", "Non respecté"


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000.0 / whole + 0.5) / 10.0).otherwise(F.lit(0.0))


# --- one column ----------------------------------------------------------------


def column_stats(df: DataFrame, name: str) -> DataFrame:
    """One row: total, nulls, null_pct, distinct and, for numbers, min, max, avg, median, stddev."""
    require(df, [name])
    c = column(name)
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("distinct")]
    if is_numeric(df, name):
        aggs += [F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.stddev_samp(c).alias("stddev")]
    out = df.agg(*aggs).withColumn("null_pct", _pct(F.col("nulls"), F.col("total")))
    return out.crossJoin(F.broadcast(medians(df, [], {"median": c}))) if is_numeric(df, name) else out  # one row each


def histogram(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed; a constant column is one bin.  Empty bins are listed."""
    require(df, [name])
    x = df.where(column(name).isNotNull()).select(column(name).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low is not null")
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / F.nullif(width, F.lit(0.0))))).otherwise(0).cast("int")
    counts = x.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends is one row
    frame = ends.select("low", "high", F.explode(F.when(F.col("high") > F.col("low"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))).alias("bin"))
    lo = F.when(F.col("high") > F.col("low"), F.col("low") + F.col("bin") * width).otherwise(F.col("low"))
    hi = F.when(F.col("high") > F.col("low"), F.col("low") + (F.col("bin") + 1) * width).otherwise(F.col("high"))
    return frame.join(counts, "bin", "left").select("bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def heavy_keys(df: DataFrame, keys: Sequence[str], n: int, count: str = "count", buckets: int = 65_536) -> DataFrame:
    """Exact counts of all keys that can be among the ``n`` most frequent ones, and of few others.

    Keys are counted by hash bucket first, and no key is more frequent than its
    bucket.  The exact counts of the keys in the fullest buckets give a count
    that the n-th key has at least; only buckets that reach it are counted by key, so
    the many rare keys of a skewed column are never exchanged.  Where all
    buckets reach it this is the full count.
    """
    require(df, keys)
    rows = df.select(*map(column, keys), F.pmod(F.xxhash64(*[x for k in keys for x in (column(k).isNull(), column(k))]), F.lit(buckets)).alias("_bucket"))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    counted = lambda of: rows.join(F.broadcast(of.select("_bucket")), "_bucket", "left_semi").groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias(count))  # noqa: E731 at most ``buckets`` rows
    sample = counted(sizes.orderBy(F.desc("_in_bucket"), "_bucket").limit(2 * n)).select(F.col(f"`{count}`").alias("_c"))
    least = sample.orderBy(F.desc("_c")).limit(n).agg(F.when(F.count(F.lit(1)) == n, F.min("_c")).otherwise(F.lit(0)).alias("_least"))
    return counted(sizes.crossJoin(F.broadcast(least)).where(F.col("_in_bucket") >= F.col("_least")))


def top_values(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The most frequent values, null among them; ties by value."""
    require(df, [name])
    per = heavy_keys(df.select(column(name).alias("value")), ["value"], n)
    return per.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(n)


def column_profile(df: DataFrame, name: str) -> dict[str, DataFrame]:
    """stats, histogram (numbers only) and top_values of one column."""
    out = {"stats": column_stats(df, name), "top_values": top_values(df, name)}
    if is_numeric(df, name):
        out["histogram"] = histogram(df, name)
    return out


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: type, min, max, approximate distinct count, avg, std, quartiles, count, null_pct.

    Counts, ends and moments are one aggregate that compiles to a loop, sketches
    another one beside it.  Quartiles come from a sketch whose ranks are off by
    about a third of a percent.
    """
    quarters = F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])
    exact, sketches, rows = [F.count(F.lit(1)).alias("_total")], [], []
    null = F.lit(None).cast("string")
    for k, f in enumerate(df.schema.fields):
        c, number = column(f.name), isinstance(f.dataType, NUMERIC)
        plain = f.dataType.simpleString()
        sortable = not plain.startswith(("map", "array", "struct"))
        exact.append(F.count(c).alias(f"_n{k}"))
        sketches.append(F.approx_count_distinct(c if sortable else F.to_json(c)).alias(f"_d{k}"))
        if sortable:
            exact += [F.min(c).alias(f"_min{k}"), F.max(c).alias(f"_max{k}")]
        if number:
            exact += [F.avg(c).alias(f"_a{k}"), F.stddev_samp(c).alias(f"_s{k}")]
            sketches.append(F.kll_sketch_agg_double(c.cast("double"), 1000).alias(f"_q{k}"))
        known = (F.col(f"_n{k}") > 0) & (F.kll_sketch_get_n_double(F.col(f"_q{k}")) > 0) if number else None
        at = lambda i: F.when(known, F.get(F.kll_sketch_get_quantile_double(F.col(f"_q{k}"), quarters), i)) if number else F.lit(None).cast("double")  # noqa: B023, E731
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(plain).alias("type"), *[(F.col(f"_{e}{k}").cast("string") if sortable else null).alias(e) for e in ("min", "max")], F.col(f"_d{k}").alias("approx_distinct"),
                *[(F.col(f"_{p}{k}") if number else F.lit(None).cast("double")).alias(a) for p, a in (("a", "avg"), ("s", "std"))], *[at(i).alias(a) for i, a in enumerate(("q25", "q50", "q75"))],
                F.col("_total").alias("count"), _pct(F.col("_total") - F.col(f"_n{k}"), F.col("_total")).alias("null_pct"),
            )
        )
    return df.agg(*exact).crossJoin(F.broadcast(df.agg(*sketches))).select(F.inline(F.array(*rows)))  # one row each


def profile_sketches(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles that can be merged: for each group of ``by`` (a day, a load) and each other column, counts, ends, moments and sketches.

    Written to a table, they let new data be profiled alone and added to what is
    known (``merge_profiles``).  Sketches have a bounded size: KLL for
    quantiles (ranks within about a third of a percent), HLL for distinct counts
    (within about 2 %).
    """
    require(df, by)
    aggs, rows, none = [F.count(F.lit(1)).alias("_rows")], [], lambda kind: F.lit(None).cast(kind)
    for k, f in enumerate(f for f in df.schema.fields if f.name not in by):
        c, number = column(f.name), isinstance(f.dataType, NUMERIC)
        text, x = as_text(df, f.name), column(f.name).cast("double")
        aggs += [F.count(c).alias(f"_n{k}"), F.hll_sketch_agg(text).alias(f"_d{k}")]
        if number:
            aggs += [F.min(x).alias(f"_lo{k}"), F.max(x).alias(f"_hi{k}"), F.avg(x).alias(f"_a{k}"), F.var_pop(x).alias(f"_v{k}"), F.kll_sketch_agg_double(x, 1000).alias(f"_q{k}")]
        else:
            aggs += [F.min(text).alias(f"_lo{k}"), F.max(text).alias(f"_hi{k}")]
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"), F.col(f"_n{k}").alias("filled"),
            *[(F.col(f"_{e}{k}") if number == numeric else none("double" if numeric else "string")).alias(f"{name}_{'number' if numeric else 'text'}") for numeric in (True, False) for e, name in (("lo", "min"), ("hi", "max"))],
            *[(F.col(f"_{e}{k}") if number else none(kind)).alias(name) for e, name, kind in (("a", "avg", "double"), ("v", "variance", "double"), ("q", "quantiles", "binary"))], F.col(f"_d{k}").alias("distinct"),
        ))
    return df.groupBy(*map(column, by)).agg(*aggs).select(*map(column, by), F.inline(F.array(*rows)))


def merge_profiles(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and group of ``by``) from the sketches of any number of parts."""
    n, total = F.col("filled"), F.sum("filled")
    mean = F.sum(n * F.col("avg")) / F.nullif(F.sum(F.when(F.col("avg").isNotNull(), n)), F.lit(0))
    squares = F.sum(n * (F.col("variance") + F.col("avg") * F.col("avg")))
    out = sketches.groupBy(*map(column, by), "column", "type").agg(
        F.sum("rows").alias("rows"), (F.sum("rows") - total).alias("nulls"), *[f(c).alias(c) for f, c in ((F.min, "min_number"), (F.max, "max_number"), (F.min, "min_text"), (F.max, "max_text"))],
        mean.alias("avg"), F.when(total > 1, F.sqrt(F.greatest(F.lit(0.0), squares - total * mean * mean) / (total - 1))).alias("std"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct", True)).alias("approx_distinct"), F.kll_merge_agg_double("quantiles").alias("_q"),
    )
    known = F.kll_sketch_get_n_double("_q") > 0
    quarters = F.when(known, F.kll_sketch_get_quantile_double("_q", F.array(*map(F.lit, (0.25, 0.5, 0.75)))))
    return out.withColumns({name: F.get(quarters, i) for i, name in enumerate(("q25", "q50", "q75"))}).drop("_q")


# --- breakdowns ------------------------------------------------------------------


def _cut(end: str):
    """The part of a text before the first separator or after the last one, or so many characters of that end."""

    def part(s: Column, how: dict[str, Any]) -> Column:
        n, sep = how["n"], how["sep"]
        if how["by"] == "chars":
            taken = F.substring(s, 1, n) if end == "prefix" else F.substring(s, -n, n)
            return taken if n > 0 else F.when(s.isNotNull(), F.lit(""))
        return F.substring_index(s, sep, 1 if end == "prefix" else -1) if sep else s

    return part


#: What a row counts under, by kind: its text form and the settings in, the key out.
KEYS = {
    "values": lambda s, how: s,
    "length": lambda s, how: F.length(s).cast("string"),
    "prefix": _cut("prefix"),
    "suffix": _cut("suffix"),
    "rule": lambda s, how: F.when(rule(how["df"], how["spec"] or {}, how["case_sensitive"], how["name"]), MET).otherwise(UNMET),
    "mask": lambda s, how: F.when(mask(how["df"], how["name"], how["segments"] or [], how["case_sensitive"]), MET).otherwise(UNMET),
}


def breakdown_key(df: DataFrame, name: str, kind: str = "values", by: str = "sep", sep: str = "", n: int = 3, spec: dict[str, Any] | None = None, segments=None, case_sensitive: bool = False) -> Column:
    """What a row counts under: its value, the start or end of it, its length, or whether it meets a rule or mask."""
    if kind not in KEYS:
        raise ValueError(f"unknown breakdown {kind}")
    return KEYS[kind](as_text(df, name), {"df": df, "name": name, "by": by, "sep": sep, "n": n, "spec": spec, "segments": segments, "case_sensitive": case_sensitive})


def breakdown(df: DataFrame, name: str, kind: str = "values", top: int = 12, **how) -> DataFrame:
    """``(key, count, pct)`` of the most frequent keys and what is left over; ties by key.

    Every row repeats other (rows not shown), distinct, nulls and total; a column
    without any value has one row with a null key and a count of 0.
    """
    require(df, [name])
    rows = df.select(breakdown_key(df, name, kind, **how).alias("key"), column(name).isNull().alias("null"))
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.count_if("null").alias("nulls"))
    total = per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), F.count("key").alias("distinct"))
    shown = per.where("key is not null").orderBy(F.desc("count"), "key").limit(max(1, top)).select(F.when(F.col("key") == "", EMPTY).otherwise(F.col("key")).alias("key"), "count")
    shown = shown.withColumn("listed", F.sum("count").over(W.partitionBy()))  # at most ``top`` rows
    out = total.join(F.broadcast(shown), F.lit(True), "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))  # one row with the few shown
    other = F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("nulls") - F.coalesce("listed", F.lit(0)))
    return out.select("key", "count", _pct(F.col("count"), F.col("total")).alias("pct"), other.alias("other"), "distinct", "nulls", "total")


# --- keys --------------------------------------------------------------------------


def _sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        raise ValueError("a key analysis needs a key column")
    require(df, keys)
    return df.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias("_size"))


def key_analysis(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: is this a candidate key, and how large are its groups?"""
    per, n = _sizes(df, keys), F.col("_size")
    null = reduce(lambda a, b: a | b, [column(k).isNull() for k in keys])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = per.agg(
        total(n).alias("total"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(n > 1).alias("dup_keys"), F.count_if(n == 1).alias("singletons"),
        total(F.when(n > 1, n)).alias("rows_in_dups"), total(F.when(null, n)).alias("null_keys"), F.coalesce(F.min(n), F.lit(0)).alias("group_min"),
        F.coalesce(F.max(n), F.lit(0)).alias("group_max"), F.coalesce(F.floor(F.sum(n) * 100.0 / F.count(F.lit(1)) + 0.5) / 100.0, F.lit(0.0)).alias("group_avg"),
    )
    middle = medians(per, [], {"group_median": n}).withColumn("group_median", F.coalesce("group_median", F.lit(0.0)))
    out = out.crossJoin(F.broadcast(middle))  # one row each
    return out.withColumn("unique", (F.col("distinct_keys") == F.col("total")) & (F.col("total") > 0)).withColumn("uniqueness_pct", _pct(F.col("distinct_keys"), F.col("total")))


def key_distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys by group size: 1, 2, 3, 4–5, 6–10, 11+."""
    n = F.col("_size")
    place = F.when(n <= 3, n).when(n <= 5, 4).when(n <= 10, 5).otherwise(6).cast("int")
    label = F.element_at(F.array(*map(F.lit, ("1", "2", "3", "4–5", "6–10", "11+"))), F.col("place"))
    return _sizes(df, keys).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("keys")).select("place", label.alias("size"), "keys")


def key_groups(df: DataFrame, keys: Sequence[str], top: int = 12, largest: bool = True, sample_rows: int = 20, order_by: Sequence[str | tuple[str, bool]] | None = None) -> DataFrame:
    """Rows of the largest (or smallest) groups, at most ``sample_rows`` of each, with ``group_size`` and ``row_in_group``."""
    per = heavy_keys(df, keys, top, "_size") if largest and keys else _sizes(df, keys)
    first = F.desc("_size") if largest else F.asc("_size")
    heads = per.orderBy(first, *ordering(keys)).limit(top).select(*[column(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_size")
    on = reduce(lambda a, b: a & b, [column(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    rest = [n for n in df.columns if n not in keys]
    part = W.partitionBy(*map(column, keys)).orderBy(*ordering(order_by or rest or keys))
    rows = df.join(F.broadcast(heads), on)  # at most ``top`` rows
    rows = rows.withColumn("row_in_group", F.row_number().over(part)).where(F.col("row_in_group") <= sample_rows)
    return rows.withColumnRenamed("_size", "group_size").drop(*[f"_k{i}" for i in range(len(keys))])


def key_consistency(df: DataFrame, keys: Sequence[str], batch: int = 16) -> DataFrame:
    """For every other column, the number of keys within which it varies (null is a value), with an example key and up to 6 of its values.

    Two values that differ are enough to vary, so no distinct count is needed:
    the least and the largest of two hashes in one mergeable pass per batch of
    columns, computed once.  The values of the example keys come from a second
    pass over their rows alone.  Runs a job.
    """
    require(df, keys)
    others = [n for n in df.columns if n not in keys]
    if not others:
        raise ValueError("no column besides the key")
    key = F.struct(*map(column, keys))
    parts = []
    for at in range(0, len(others), batch):
        part = others[at : at + batch]
        ends = [x.alias(f"_{e}{i}_{k}") for k, c in enumerate(part) for i, h in enumerate(hashes(as_text(df, c))) for e, x in (("lo", F.min(h)), ("hi", F.max(h)))]
        per = df.groupBy(*map(column, keys)).agg(*ends)
        varies = lambda k: (F.col(f"_lo0_{k}") != F.col(f"_hi0_{k}")) | (F.col(f"_lo1_{k}") != F.col(f"_hi1_{k}"))
        one = per.agg(*[x for k in range(len(part)) for x in (F.count_if(varies(k)).alias(f"_v{k}"), F.min(F.when(varies(k), key)).alias(f"_e{k}"))])
        parts.append(one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{k}").alias("varying_groups"), F.to_json(F.col(f"_e{k}")).alias("example_key")) for k, c in enumerate(part)]))))
    out = written(reduce(DataFrame.unionByName, parts))
    # the rows of the example keys (one key per column), long by column; the distinct values among them
    wanted = out.select(F.col("column").alias("_column"), F.col("example_key").alias("_example")).where("_example is not null")
    pairs = F.array(*[F.struct(F.lit(c).alias("_column"), as_text(df, c).alias("_value")) for c in others])
    rows = df.withColumn("_example", F.to_json(key)).join(F.broadcast(wanted.select("_example").distinct()), "_example", "left_semi").select("_example", F.inline(pairs))
    values = rows.where("_value is not null").join(F.broadcast(wanted), ["_example", "_column"], "left_semi").distinct()
    first = F.row_number().over(W.partitionBy("_column").orderBy("_value"))
    values = values.withColumn("_place", first).where(F.col("_place") <= 6).groupBy("_column").agg(F.array_sort(F.collect_list("_value")).alias("example_values"))
    out = out.join(values, out["column"] == values["_column"], "left").drop("_column")
    out = out.withColumn("example_values", F.coalesce("example_values", F.array().cast("array<string>")))
    return out.withColumn("constant", F.col("varying_groups") == 0).orderBy("constant", F.desc("varying_groups"), "column")


def example_values(df: DataFrame, keys: Sequence[str], values: Sequence[Any], name: str, n: int = 6) -> DataFrame:
    """Up to ``n`` distinct values of a column within one key."""
    same = reduce(lambda a, b: a & b, [column(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, values)])
    return df.where(same & column(name).isNotNull()).select(as_text(df, name).alias(name)).distinct().orderBy(name).limit(n)


def key_rows(df: DataFrame, keys: Sequence[str], q: str, limit: int = 200) -> DataFrame:
    """Rows of which some key column contains ``q`` as text, ordered by key."""
    require(df, keys)
    hit = reduce(lambda a, b: a | b, [F.lower(as_text(df, k)).contains(q.lower()) for k in keys])
    rest = [n for n in df.columns if n not in keys]
    return df.where(hit).orderBy(*ordering([*keys, *rest])).limit(limit)


def report(df: DataFrame, specs: Sequence[dict[str, Any]] | None = None) -> dict[str, DataFrame]:
    """A DataFrame per analysis ``{kind, column, key, top, …}``; by default one breakdown of values per column."""
    out: dict[str, DataFrame] = {}
    for spec in specs or [{"kind": "values", "column": c} for c in df.columns]:
        spec = dict(spec)
        kind, title = spec.pop("kind", "values"), spec.pop("title", None)
        if kind == "keys":
            keys = spec.get("key") or [spec["column"]]
            name = title or "keys: " + ", ".join(keys)
            out[name] = key_analysis(df, keys)
            continue
        c = spec.pop("column")
        spec = {("spec" if k == "rule" else k): v for k, v in spec.items() if k in ("top", "by", "sep", "n", "rule", "segments", "case_sensitive")}
        out[title or f"{kind}: {c}"] = breakdown(df, c, kind, **spec)
    return out


# --- preview -------------------------------------------------------------------------


def preview(
    df: DataFrame, filters: Sequence[dict[str, Any]] = (), q: str = "", sort: str | None = None, descending: bool = False, limit: int = 50, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and one row of counts: filtered and total.

    Filters ``{column, op: equals | contains | is_null, value}`` are ANDed;
    ``q`` is searched in the text of every column.  Other operators mean
    contains.  A page behind many rows of an order is looked for by its place
    (``deep_page``).
    """
    keep = F.lit(True)
    for f in filters:
        if f["column"] not in df.columns:
            continue
        c, op, v = column(f["column"]), f.get("op") or "contains", f.get("value")
        if op == "is_null":
            keep = keep & c.isNull()
        elif op == "equals":
            value = F.lit(str(v)).try_cast(df.schema[f["column"]].dataType.simpleString())
            keep = keep & sure(c == value, c, value)
        else:
            keep = keep & sure(F.lower(as_text(df, f["column"])).contains(str(v or "").lower()), c)
    if q:
        keep = keep & reduce(lambda a, b: a | b, [sure(F.lower(as_text(df, n)).contains(q.lower()), column(n)) for n in df.columns])
    rows = df.where(keep)
    if sort:
        require(df, [sort])
        rest = [n for n in df.columns if n != sort]
        rows = rows.orderBy(*ordering([(sort, descending), *rest]))
    page = rows.offset(offset).limit(limit) if offset else rows.limit(limit)
    if sort and offset > DEEP:
        page = deep_page(df.where(keep), [(sort, descending), *rest], limit, offset)
    return page, df.agg(F.count_if(keep).alias("filtered"), F.count(F.lit(1)).alias("total"))


#: Rows before a page from which its place is looked for; rows of a sample that narrows the search.
DEEP, SAMPLE = 100_000, 2_000


def deep_page(df: DataFrame, order: Sequence[str | tuple[str, bool]], limit: int, offset: int, deep: int = DEEP, sample_rows: int = SAMPLE) -> DataFrame:
    """The page behind ``offset`` rows without ordering those before it in one task.

    A sample of sort keys gives two ends that the page probably lies between;
    exact counts of the rows before each end tell whether it does, and what lies
    between is searched in the same way until few rows precede the page.  A
    sample that misleads costs a step, never a row.  Runs jobs.
    """
    named = [i if isinstance(i, tuple) else (i, False) for i in order]
    # the first key decides the direction; keys of another direction are left to the final sort
    same = [n for n, down in named if down == named[0][1]] if len({d for _, d in named}) == 1 else [named[0][0]]
    key, down = place_key(df, [(n, named[0][1]) for n in same], ties=None)
    before = (lambda a, b: a > b) if down else (lambda a, b: a < b)
    rows, skip, within = df, offset, df.count()
    while skip > deep and within > sample_rows:
        ordered = F.array_sort(F.collect_list("k"))
        picked = rows.select(key.alias("k")).sample(fraction=min(1.0, sample_rows / within), seed=3).agg((F.reverse(ordered) if down else ordered).alias("ks"))
        share, spread = F.lit(skip / within), 4 * F.sqrt(F.lit(skip / within * (1 - skip / within)) / F.size("ks"))
        reach = F.lit(limit / within)
        at = lambda x: F.get(F.col("ks"), F.floor(x * F.size("ks")).cast("int"))
        ends = written(picked.select(F.when(share - spread > 0, at(share - spread)).alias("low"), F.when(share + reach + spread < 1, at(share + reach + spread)).alias("high")))
        inside = rows.withColumn("_page_key", key).crossJoin(F.broadcast(ends))  # one row
        low, high, own = F.col("low"), F.col("high"), F.col("_page_key")
        early, late = F.coalesce(before(own, low), F.lit(False)), F.coalesce(before(high, own), F.lit(False))
        n = inside.agg(F.count_if(early).alias("early"), F.count_if(late).alias("late")).first()
        keep_low, keep_high = n["early"] <= skip, within - n["late"] >= min(within, skip + limit)
        drop = (early if keep_low else F.lit(False)) | (late if keep_high else F.lit(False))
        left = within - (n["early"] if keep_low else 0) - (n["late"] if keep_high else 0)
        if left >= within:
            break  # rows equal in the sort key, which no end can part
        rows = inside.where(~drop).select(*map(column, df.columns))
        skip, within = skip - (n["early"] if keep_low else 0), left
    return rows.orderBy(*ordering(order)).offset(skip).limit(limit)
