"""Queries of profiling: columns, breakdowns, keys, previews."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.profiling import (
    breakdown,
    column_stats,
    deep_page,
    histogram,
    key_analysis,
    key_consistency,
    key_distribution,
    key_groups,
    key_rows,
    merge_profiles,
    preview,
    profile_sketches,
    report,
    summarize,
    top_values,
)
from gristmill.plans.tables import Tables, register
from gristmill.session import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)


def _pct(part: str, whole: str = "count(*)") -> str:
    return f"floor({part} * 1000.0::DOUBLE / {whole} + 0.5) / 10.0"


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE l_quantity IS NULL) AS nulls, count(DISTINCT l_quantity) AS distinct, min(l_quantity) AS min, max(l_quantity) AS max,
round(avg(l_quantity), 6) AS avg, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS stddev, {_pct('count(*) FILTER (WHERE l_quantity IS NULL)')} AS null_pct FROM lineitem""")
def profile_numeric(t: Tables) -> DataFrame:
    return column_stats(t.lineitem, "l_quantity").withColumns({"avg": F.round("avg", 6), "stddev": F.round("stddev", 6)})


@query("""WITH e AS (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer), n AS (SELECT CAST(least(9, floor((c_acctbal - low) / ((high - low) / 10))) AS INTEGER) AS bin, count(*) AS count FROM customer, e GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, low + b * ((high - low) / 10) AS lo, low + (b + 1) * ((high - low) / 10) AS hi, coalesce(count, 0) AS count FROM e, (SELECT unnest(range(0, 10)) AS b) LEFT JOIN n ON bin = b""")
def profile_histogram(t: Tables) -> DataFrame:
    return histogram(t.customer, "c_acctbal")


@query("SELECT nullif(o_orderpriority, '5-LOW') AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, value NULLS LAST LIMIT 10")
def profile_top_values(t: Tables) -> DataFrame:
    return top_values(t.orders.select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio")), "prio")


@query()
def profile_summary(t: Tables) -> DataFrame:
    return summarize(t.lineitem)


_LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "column", CAST(min({n}) AS VARCHAR) AS min, CAST(max({n}) AS VARCHAR) AS max, count(*) AS count, {_pct(f"count(*) FILTER (WHERE {n} IS NULL)")} AS null_pct FROM lineitem""" for n in _LINEITEM))
def profile_summary_exact(t: Tables) -> DataFrame:
    """The part of the summary that is not approximate."""
    return summarize(t.lineitem).select("column", "min", "max", "count", "null_pct")


_MERGED = ("o_orderkey", "o_custkey", "o_totalprice")


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "column", count(*) AS rows, CAST(count(*) - count({n}) AS BIGINT) AS nulls, CAST(min({n}) AS DOUBLE) AS low, CAST(max({n}) AS DOUBLE) AS high, round(CAST(avg({n}) AS DOUBLE), 4) AS avg,
round(CAST(stddev_samp({n}) AS DOUBLE), 2) AS std, true AS distinct_within, true AS quartiles_within FROM orders""" for n in _MERGED))
def profile_merged(t: Tables) -> DataFrame:
    """Orders profiled year by year into a table of sketches, and merged from it: exact parts, and whether the others are within 5 % and 1 %."""
    folder = f"{shared_folder(t.spark)}/profiles-{uuid.uuid4().hex}"
    orders = t.orders.select(F.year("o_orderdate").alias("year"), *_MERGED)
    profile_sketches(orders, ["year"]).write.partitionBy("year").parquet(folder)
    merged = merge_profiles(t.spark.read.parquet(folder))
    exact = orders.agg(*[F.count_distinct(n).alias(n) for n in _MERGED]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("exact")) for n in _MERGED])))
    long = orders.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in _MERGED])))
    ends = [(c, q) for c, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    ranks = long.join(F.broadcast(merged.select(F.col("column").alias("name"), *[c for c, _ in ends])), "name").groupBy("name").agg(
        *[((F.count_if(F.col("x") < F.col(c)) <= F.count(F.lit(1)) * (q + 0.01)) & (F.count_if(F.col("x") <= F.col(c)) >= F.count(F.lit(1)) * (q - 0.01))).alias(f"_{c}") for c, q in ends]
    )  # one row a column
    out = merged.join(exact, F.col("column") == F.col("name")).drop("name").join(ranks, F.col("column") == F.col("name"))
    near = F.abs(F.col("approx_distinct") - F.col("exact")) <= F.col("exact") * 0.05
    return out.select("column", "rows", "nulls", F.col("min_number").alias("low"), F.col("max_number").alias("high"), F.round("avg", 4).alias("avg"), F.round("std", 2).alias("std"), near.alias("distinct_within"), (F.col("_q25") & F.col("_q50") & F.col("_q75")).alias("quartiles_within"))


def _breakdown_sql(key: str, source: str, column: str, top: int = 12) -> str:
    return f"""WITH r AS (SELECT {key} AS key, {column} IS NULL AS missing FROM {source}), k AS (SELECT key, count(*) AS count FROM r WHERE key IS NOT NULL GROUP BY key), s AS (SELECT * FROM k ORDER BY count DESC, key LIMIT {top}),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE missing) AS nulls FROM r)
SELECT CASE WHEN key = '' THEN '(vide)' ELSE key END AS key, count, floor(count * 1000.0::DOUBLE / total + 0.5) / 10.0 AS pct, CAST(greatest(0, total - nulls - (SELECT sum(count) FROM s)) AS BIGINT) AS other, (SELECT count(*) FROM k) AS distinct, nulls, total FROM s, t"""


@query(_breakdown_sql("nullif(o_orderpriority, '5-LOW')", "orders", "nullif(o_orderpriority, '5-LOW')", 3))
def breakdown_values(t: Tables) -> DataFrame:
    return breakdown(t.orders.select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio")), "prio", top=3)


@query(_breakdown_sql("split_part(p_name, ' ', 1)", "part", "p_name", 4))
def breakdown_prefix(t: Tables) -> DataFrame:
    return breakdown(t.part, "p_name", "prefix", by="sep", sep=" ", top=4)


@query(_breakdown_sql("right(p_brand, 2)", "part", "p_brand"))
def breakdown_suffix(t: Tables) -> DataFrame:
    return breakdown(t.part, "p_brand", "suffix", by="chars", n=2)


@query(_breakdown_sql("CAST(length(p_name) AS VARCHAR)", "part", "p_name"))
def breakdown_length(t: Tables) -> DataFrame:
    return breakdown(t.part, "p_name", "length")


@query(_breakdown_sql("CASE WHEN p_name LIKE '%ring%' THEN 'Respecté' ELSE 'Non respecté' END", "part", "p_name"))
def breakdown_rule(t: Tables) -> DataFrame:
    return breakdown(t.part, "p_name", "rule", spec={"test": "contains", "value": "RING"})


@query(_breakdown_sql("CASE WHEN regexp_full_match(p_brand, 'Brand#[0-9]{2}') THEN 'Respecté' ELSE 'Non respecté' END", "part", "p_brand"))
def breakdown_mask(t: Tables) -> DataFrame:
    return breakdown(t.part, "p_brand", "mask", segments=[{"type": "literal", "value": "brand#"}, {"type": "digit", "length": 2}])


_SIZES = "SELECT l_orderkey, nullif(l_linenumber, 7) AS line, count(*) AS n FROM lineitem GROUP BY 1, 2"


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey", "nullif(l_linenumber, 7) AS line", "l_returnflag", "l_linestatus")


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS dup_keys, count(*) FILTER (WHERE n = 1) AS singletons, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_dups,
CAST(coalesce(sum(n) FILTER (WHERE line IS NULL), 0) AS BIGINT) AS null_keys, min(n) AS group_min, max(n) AS group_max, floor(sum(n) * 100.0::DOUBLE / count(*) + 0.5) / 100.0 AS group_avg, median(n) AS group_median,
count(*) = sum(n) AS unique, {_pct('count(*)', 'sum(n)')} AS uniqueness_pct FROM ({_SIZES})""")
def key_profile(t: Tables) -> DataFrame:
    return key_analysis(_lines(t), ["l_orderkey", "line"])


@query(f"""SELECT CAST(CASE WHEN n <= 3 THEN n WHEN n <= 5 THEN 4 WHEN n <= 10 THEN 5 ELSE 6 END AS INTEGER) AS place, CASE WHEN n <= 3 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '4–5' WHEN n <= 10 THEN '6–10' ELSE '11+' END AS size, count(*) AS keys
FROM ({_SIZES}) GROUP BY 1, 2""")
def key_sizes(t: Tables) -> DataFrame:
    return key_distribution(_lines(t), ["l_orderkey", "line"])


@query("""WITH k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5), r AS (SELECT o_orderkey, o_custkey, o_totalprice, n AS group_size, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row_in_group FROM orders JOIN k USING (o_custkey))
SELECT * FROM r WHERE row_in_group <= 20""")
def key_largest_groups(t: Tables) -> DataFrame:
    return key_groups(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], top=5, order_by=["o_orderkey"])


@query("""WITH v AS (SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS s, count(DISTINCT o_orderpriority) > 1 AS p, count(DISTINCT o_custkey % 5) > 1 AS m FROM orders GROUP BY 1)
SELECT x.*, CASE WHEN constant THEN [] ELSE (SELECT list(DISTINCT s.val ORDER BY s.val)[:6] FROM (SELECT o_custkey, 'o_orderstatus' AS col, o_orderstatus AS val FROM orders UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT o_custkey, 'm', CAST(o_custkey % 5 AS VARCHAR) FROM orders) s WHERE s.o_custkey = x.example AND s.col = x."column") END AS example_values FROM (
SELECT 'o_orderstatus' AS "column", count(*) FILTER (WHERE s) AS varying_groups, min(o_custkey) FILTER (WHERE s) AS example, count(*) FILTER (WHERE s) = 0 AS constant FROM v
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE p), min(o_custkey) FILTER (WHERE p), count(*) FILTER (WHERE p) = 0 FROM v UNION ALL SELECT 'm', count(*) FILTER (WHERE m), min(o_custkey) FILTER (WHERE m), count(*) FILTER (WHERE m) = 0 FROM v) x""")
def key_varying_columns(t: Tables) -> DataFrame:
    out = key_consistency(t.orders.selectExpr("o_custkey", "o_orderstatus", "o_orderpriority", "o_custkey % 5 AS m"), ["o_custkey"], batch=2)
    return out.withColumn("example", F.get_json_object("example_key", "$.o_custkey").cast("long")).drop("example_key")


@query("""WITH k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n, o_custkey LIMIT 6), r AS (SELECT o_orderkey, o_custkey, n AS group_size, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row_in_group FROM orders JOIN k USING (o_custkey))
SELECT * FROM r WHERE row_in_group <= 3""")
def key_smallest_groups(t: Tables) -> DataFrame:
    return key_groups(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], top=6, largest=False, sample_rows=3, order_by=["o_orderkey"])


@query(f"""SELECT 'values: o_orderstatus' AS analysis, key, count FROM ({_breakdown_sql("o_orderstatus", "orders", "o_orderstatus")})
UNION ALL SELECT 'first letter', key, count FROM ({_breakdown_sql("left(o_orderpriority, 1)", "orders", "o_orderpriority", 2)})
UNION ALL SELECT 'keys: o_custkey', 'distinct', count(DISTINCT o_custkey) FROM orders""")
def report_tables(t: Tables) -> DataFrame:
    """A report of three analyses, each made by its own plan, stacked with its title."""
    specs = [{"kind": "values", "column": "o_orderstatus"}, {"kind": "prefix", "column": "o_orderpriority", "by": "chars", "n": 1, "top": 2, "title": "first letter"}, {"kind": "keys", "key": ["o_custkey"]}]
    made = report(t.orders, specs)
    parts = [d.select(F.lit(name).alias("analysis"), "key", "count") if "key" in d.columns else d.select(F.lit(name).alias("analysis"), F.lit("distinct").alias("key"), F.col("distinct_keys").alias("count")) for name, d in made.items()]
    return reduce(lambda a, b: a.union(b), parts)


@query("""SELECT CAST(NULL AS VARCHAR) AS key, CAST(0 AS BIGINT) AS count, CAST(0 AS DOUBLE) AS pct, CAST(0 AS BIGINT) AS other, CAST(0 AS BIGINT) AS distinct, count(*) AS nulls, count(*) AS total FROM orders""")
def breakdown_of_nothing(t: Tables) -> DataFrame:
    """A column without any value still says how many rows there are."""
    return breakdown(t.orders.select(F.expr("nullif(o_orderstatus, o_orderstatus)").alias("none")), "none")


@query("SELECT * FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains(c_name, 'build') ORDER BY c_mktsegment, c_name LIMIT 200")
def key_drill_down(t: Tables) -> DataFrame:
    return key_rows(t.customer, ["c_mktsegment", "c_name"], "Build")


@query("""SELECT * FROM customer WHERE c_nationkey = 7 AND contains(lower(c_mktsegment), 'mach') AND (contains(CAST(c_custkey AS VARCHAR), '1') OR contains(lower(c_name), '1') OR contains(CAST(c_nationkey AS VARCHAR), '1') OR contains(CAST(c_acctbal AS VARCHAR), '1') OR contains(c_mktsegment, '1'))
ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 5 OFFSET 1""")
def preview_page(t: Tables) -> DataFrame:
    filters = [{"column": "c_nationkey", "op": "equals", "value": "7"}, {"column": "c_mktsegment", "op": "contains", "value": "Mach"}]
    return preview(t.customer, filters, q="1", sort="c_acctbal", descending=True, limit=5, offset=1)[0]


_DEEP = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


@query(f"""WITH r AS (SELECT {_DEEP}, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS n, count(*) OVER () AS rows FROM lineitem) SELECT {_DEEP} FROM r WHERE n > rows * 9 // 10 AND n <= rows * 9 // 10 + 50""")
def deep_page_prices(t: Tables) -> DataFrame:
    """Fifty line items behind nine tenths of all, by price."""
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return deep_page(items, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], 50, items.count() * 9 // 10, deep=1000)


@query("SELECT count(*) FILTER (WHERE c_nationkey = 7) AS filtered, count(*) AS total FROM customer")
def preview_counts(t: Tables) -> DataFrame:
    return preview(t.customer, [{"column": "c_nationkey", "op": "equals", "value": "7"}])[1]
