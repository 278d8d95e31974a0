"""Places of rows in an order, and medians, without a key in one task.

The rows are written once in range partitions of (keys, order).  What a
partition holds of a key is a *run*; the table of runs is small (a row for each
partition and one more for each key) and tells how many rows of the key lie in
earlier partitions and what their edge rows are.  A row's place is then its
place in its run and what the run carries over.  Rows that are equal in all
order columns are dealt by a number of their own, so they can be split as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.session import shared_folder
from gristmill.values import column, join_safe, require

#: Column names of this module; input columns of these names are refused.
MID, PART, RUN_ROWS, RUN_START, BEFORE = "_place_mid", "_place_part", "_place_rows", "_place_start", "_place_before"
#: Rows of a key from which its places are found run by run.
HOT_ROWS = 2_000_000


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``df`` written in range partitions of (keys, order), with its place ``_place_mid``: the partition in the upper bits, the row in the lower 33."""
    clash = {MID, PART, RUN_ROWS, RUN_START, BEFORE} & set(df.columns)
    if clash:
        raise ValueError(f"reserved names: {', '.join(sorted(clash))}")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[column(k).asc_nulls_first() for k in keys], *order]
    dealt = df.withColumn(MID, F.monotonically_increasing_id())
    rows = dealt.repartitionByRange(n, *by, F.col(MID)).sortWithinPartitions(*by, F.col(MID))
    return written(rows.withColumn(MID, F.monotonically_increasing_id())).withColumn(PART, F.shiftright(MID, 33).cast("int"))


def runs(rows: DataFrame, keys: Sequence[str], **edges: Column) -> DataFrame:
    """One row for each partition and key: ``_place_start``, ``_place_rows`` and ``_place_before``, the rows in earlier partitions.

    ``edges`` adds aggregates of a run.
    """
    per = rows.groupBy(PART, *map(column, keys)).agg(F.min(MID).alias(RUN_START), F.count(F.lit(1)).alias(RUN_ROWS), *[c.alias(n) for n, c in edges.items()])
    upto = F.sum(RUN_ROWS).over(W.partitionBy(*map(column, keys)).orderBy(PART).rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn(BEFORE, upto - F.col(RUN_ROWS))


def with_runs(rows: DataFrame, per: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row with the columns of its run; nulls in keys are equal."""
    per = per.withColumnRenamed(PART, "_run_part")
    per = per.withColumnsRenamed({k: f"_run_{i}" for i, k in enumerate(keys)})
    on = F.col(PART) == F.col("_run_part")
    for i, k in enumerate(keys):
        on = on & column(k).eqNullSafe(F.col(f"_run_{i}"))
    return rows.join(per, on).drop("_run_part", *[f"_run_{i}" for i in range(len(keys))])


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, total: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with the place of every row within its key, from 0, in ``name``, and the rows of the key in ``total``.  Runs jobs."""
    rows = in_order(df, keys, order, partitions)
    per = runs(rows, keys)
    if total:
        per = per.withColumn(total, F.sum(RUN_ROWS).over(W.partitionBy(*map(column, keys))))
    return with_runs(rows, per, keys).withColumn(name, F.col(BEFORE) + F.col(MID) - F.col(RUN_START)).drop(MID, PART, RUN_ROWS, RUN_START, BEFORE)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, or None; so there are at most the table's rows through ``hot_rows`` of them.  Runs one or two counts."""
    if df.count() <= hot_rows:
        return None
    hot = written(df.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).drop("_n"))
    return None if hot.isEmpty() else hot


def split_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
    """The rows of all other keys, and those of the hot ones."""
    if not keys:
        return None, df
    small = F.broadcast(hot.select(*[column(k).alias(f"_hot_{i}") for i, k in enumerate(keys)]))  # few by the meaning of hot
    on = reduce(lambda a, b: a & b, [df[f"`{k}`"].eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)])
    return df.join(small, on, "left_anti"), df.join(small, on, "left_semi")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``df`` with the place of every row within its key, from 1: by a window, and run by run for keys of more than ``hot_rows`` rows."""
    row = F.row_number().over(W.partitionBy(*map(column, keys)).orderBy(*order)).cast("long")
    hot = hot_keys(df, keys, hot_rows) if hot_rows is not None else None
    if hot is None:
        return df.withColumn(name, row)
    cold, large = split_hot(df, hot, keys)
    large = with_place(large, keys, order, name).withColumn(name, F.col(name) + 1)
    return large if cold is None else cold.withColumn(name, row).unionByName(large)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[Column], wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with columns that depend on the order within a key, found run by run.

    ``wanted`` names ``(occurrence | first | last | prev | next | concat, value)``;
    what a run needs of the others are their counts, edge values and joined texts.
    """
    rows = in_order(df.withColumns({f"_val_{i}": v for i, (_, v) in enumerate(wanted.values())}), keys, order)
    value = lambda i: F.col(f"_val_{i}")
    edges: dict[str, Column] = {}
    for i, (fn, _) in enumerate(wanted.values()):
        if fn in ("first", "prev", "last", "next"):
            edges |= {f"_head_{i}": F.min_by(F.struct(value(i)), MID), f"_tail_{i}": F.max_by(F.struct(value(i)), MID)}
        elif fn == "concat":
            texts = F.array_sort(F.collect_list(F.when(value(i).isNotNull(), F.struct(F.col(MID).alias("at"), value(i).alias("t")))))
            edges[f"_head_{i}"] = F.when(F.size(texts) > 0, F.array_join(texts["t"], ", "))
    per, by = runs(rows, keys, **edges), W.partitionBy(*map(column, keys)).orderBy(PART)
    whole, carried = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), {}
    for i, (fn, _) in enumerate(wanted.values()):
        head, tail = F.col(f"_head_{i}"), F.col(f"_tail_{i}")
        if fn in ("first", "last"):
            carried[f"_edge_{i}"] = (F.first(head) if fn == "first" else F.last(tail)).over(whole)
        elif fn in ("prev", "next"):
            carried[f"_edge_{i}"] = (F.lag(tail) if fn == "prev" else F.lead(head)).over(by)
        elif fn == "concat":
            texts = F.collect_list(head).over(whole)
            carried[f"_edge_{i}"] = F.when(F.size(texts) > 0, F.array_join(texts, ", "))
    out = with_runs(rows, per.withColumns(carried).drop(*edges), keys)
    inside, place = W.partitionBy(PART, *map(column, keys)).orderBy(MID), F.col(MID) - F.col(RUN_START)
    made = {}
    for i, (name, (fn, _)) in enumerate(wanted.items()):
        edge = F.col(f"_edge_{i}")
        if fn == "occurrence":
            made[name] = (F.col(BEFORE) + place + 1).cast("int")
        elif fn in ("first", "last"):
            made[name] = edge[f"_val_{i}"]
        elif fn == "concat":
            made[name] = edge
        elif fn == "prev":
            made[name] = F.when(place == 0, edge[f"_val_{i}"]).otherwise(F.lag(value(i)).over(inside))
        else:
            made[name] = F.when(place == F.col(RUN_ROWS) - 1, edge[f"_val_{i}"]).otherwise(F.lead(value(i)).over(inside))
    return out.withColumns(made).select(*map(column, df.columns), *made)


#: Where the values of a key are cut to look for its median: close around the middle, so that little lies between.
CUTS = (0.25, 0.4, 0.49, 0.51, 0.6, 0.75)


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One row per key with the exact median of each numeric value, as double; without keys one row.

    Selection by rank: a sketch of bounded size gives each key a few cut points,
    mergeable counts tell between which of them the middle rank lies, and only
    the values there (one of fifty, as a rule) are counted and ordered.  Cut points
    that are off cost time, never exactness; no task holds a key's values.
    Nulls are ignored; a key without values has null.
    """
    require(df, keys)
    names, own = list(values), [f"_m{i}" for i in range(len(keys))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_what"), v.cast("double").alias("_value")) for i, v in enumerate(values.values())]))
    rows = df.select(*[column(k).alias(n) for k, n in zip(keys, own)], each.alias("_each")).select(*own, "_each.*").where("_value is not null")
    by = [*own, "_what"]
    sketch = F.kll_sketch_agg_double("_value", 800)
    cuts = rows.groupBy(*by).agg(sketch.alias("_sketch"))
    cuts = cuts.select(*by, F.when(F.kll_sketch_get_n_double("_sketch") > 0, F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, CUTS)))).alias("_cuts"))
    place = lambda: sum(F.when(F.col("_value") > F.get("_cuts", F.lit(i)), 1).otherwise(0) for i in range(len(CUTS)))
    cut = join_safe(rows, cuts, by).withColumn("_place", place())
    sizes = cut.groupBy(*by, "_place").agg(F.count(F.lit(1)).alias("_n"))
    part = W.partitionBy(*by)
    total, upto = F.sum("_n").over(part), F.sum("_n").over(part.orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    low, high = F.floor((total + 1) / 2), F.floor((total + 2) / 2)  # ranks from 1: the middle one, or the two around it
    sizes = sizes.select(*by, "_place", low.alias("_low"), high.alias("_high"), (upto - F.col("_n")).alias("_before"), upto.alias("_upto"))
    chosen = sizes.where("(_before < _low and _low <= _upto) or (_before < _high and _high <= _upto)")
    inside = join_safe(cut.select(*by, "_place", "_value"), chosen.drop("_upto"), [*by, "_place"])
    counts = inside.groupBy(*by, "_place", "_value").agg(F.count(F.lit(1)).alias("_n"), F.max("_before").alias("_before"), F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    run = F.col("_before") + F.sum("_n").over(W.partitionBy(*by, "_place").orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", run)
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") < F.col(rank)) & (F.col(rank) <= F.col("_upto")), F.col("_value")))
    got = counts.groupBy(*by).agg(at("_low").alias("_a"), at("_high").alias("_b"))
    found = got.groupBy(*own).agg(*[F.max(F.when(F.col("_what") == i, F.col("_a") * 0.5 + F.col("_b") * 0.5)).alias(n) for i, n in enumerate(names)])
    if not keys:
        return found
    every = df.select(*[column(k).alias(n) for k, n in zip(keys, own)]).distinct()
    return join_safe(every, found, own, "left").withColumnsRenamed(dict(zip(own, keys)))
