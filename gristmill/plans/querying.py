"""Queries of the query builder: projection, filters, joins, aggregates, stacking, duplicates, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.duplicates import duplicate_counts, duplicates
from gristmill.operators.filtering import membership_counts, membership_filter
from gristmill.operators.relational import aggregate, chain, join_inputs, predicate, select_columns, select_items, sort_limit, sql_over
from gristmill.operators.reshape import pivot_table, unpivot_table
from gristmill.operators.stacking import alignment_report, stack
from gristmill.plans.tables import Tables, register

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)


@query("""
SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n_lines,
  count(DISTINCT o_orderkey) AS n_orders, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity > 5 GROUP BY n_name HAVING count(*) > 10 ORDER BY revenue DESC NULLS LAST, n_name LIMIT 20""")
def sales_by_nation(t: Tables) -> DataFrame:
    rows = t.lineitem.where(chain([("", predicate(">=", "l_shipdate", "TIMESTAMP_NTZ '1995-01-01 00:00:00'", value_type="raw")), ("AND", predicate(">", "l_quantity", 5, value_type="number"))]))
    rows = join_inputs(rows, [(t.orders, "inner", [("l_orderkey", "o_orderkey")]), (t.customer, "inner", [("o_custkey", "c_custkey")]), (t.nation, "inner", [("c_nationkey", "n_nationkey")])])
    rows = rows.withColumn("amount", F.expr("cast(l_extendedprice * (1 - l_discount) as decimal(18,4))"))
    out = aggregate(
        rows, ["n_name"],
        [("SUM", "amount", "revenue"), ("COUNT", None, "n_lines"), ("COUNT_DISTINCT", "o_orderkey", "n_orders"), ("MIN", "l_quantity", "min_qty"), ("MAX", "l_quantity", "max_qty")],
        having=[("", "COUNT", None, ">", 10)],
    )
    return sort_limit(out.withColumn("revenue", F.col("revenue").cast("double")), [("revenue", True), "n_name"], 20)


@query("""
SELECT p_partkey, p_name, p_type, p_size FROM part
WHERE p_name LIKE '%ring%' AND p_type NOT LIKE 'ECO%' OR p_brand ILIKE 'brand#1%' AND p_size IN (1, 5, 10, 15, 20) OR p_size BETWEEN 40 AND 42 AND p_retailprice IS NOT NULL OR p_name IS NULL""")
def predicates_all(t: Tables) -> DataFrame:
    conditions = [
        ("", predicate("LIKE", "p_name", "%ring%")), ("AND", predicate("NOT LIKE", "p_type", "ECO%")), ("OR", predicate("ILIKE", "p_brand", "brand#1%")),
        ("AND", predicate("IN", "p_size", "1, 5, 10, 15, 20", value_type="number")), ("OR", predicate("BETWEEN", "p_size", 40, 42, "number")),
        ("AND", predicate("IS NOT NULL", "p_retailprice")), ("OR", predicate("IS NULL", "p_name")),
    ]
    return select_items(t.part.where(chain(conditions)), [{"column": c} for c in ("p_partkey", "p_name", "p_type", "p_size")])


@query("SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND (c_acctbal >= 1000 OR c_acctbal < 0) AND c_nationkey <> 3 AND c_custkey <= 5000")
def predicates_not_in(t: Tables) -> DataFrame:
    either = chain([("", predicate(">=", "c_acctbal", 1000, value_type="number")), ("OR", predicate("<", "c_acctbal", "0", value_type="number"))])
    return t.customer.where(chain([("", predicate("NOT IN", "c_mktsegment", "BUILDING, MACHINERY")), ("AND", either), ("AND", predicate("<>", "c_nationkey", 3, value_type="number")), ("AND", predicate("<=", "c_custkey", 5000, value_type="number"))]))


@query("SELECT DISTINCT c_mktsegment AS segment FROM customer")
def distinct_segments(t: Tables) -> DataFrame:
    return select_items(t.customer, [{"column": "c_mktsegment", "alias": "segment"}], distinct=True)


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderstatus) AS status FROM orders")
def select_expressions(t: Tables) -> DataFrame:
    return select_items(t.orders, [{"column": "o_orderkey"}, {"expression": "o_totalprice * 2", "alias": "twice"}, {"expression": "upper(o_orderstatus)", "alias": "status"}])


@query("SELECT c_name AS client, c_custkey, c_nationkey, c_mktsegment FROM customer")
def column_manager(t: Tables) -> DataFrame:
    return select_columns(t.customer, [{"name": "c_name", "rename": "client"}, {"name": "absent"}, {"name": "c_acctbal", "keep": False}])


@query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def raw_sql_join(t: Tables) -> DataFrame:
    return sql_over(t.spark, "SELECT r_name, count(*) AS nations FROM {in1} JOIN {in2} ON n_regionkey = r_regionkey GROUP BY r_name", in1=t.nation, in2=t.region)


_BIG = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"


def _big_orders(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 200000").select("o_custkey", "o_orderkey", "o_totalprice")


def _customers(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 2000").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name, b.* FROM (SELECT * FROM customer WHERE c_acctbal > 2000) LEFT JOIN ({_BIG}) b ON c_custkey = o_custkey")
def join_left(t: Tables) -> DataFrame:
    return join_inputs(_customers(t), [(_big_orders(t), "left", [("c_custkey", "o_custkey")])])


@query(f"SELECT c_custkey, c_name, b.* FROM (SELECT * FROM customer WHERE c_acctbal > 2000) RIGHT JOIN ({_BIG}) b ON c_custkey = o_custkey")
def join_right(t: Tables) -> DataFrame:
    return join_inputs(_customers(t), [(_big_orders(t), "right", [("c_custkey", "o_custkey")])])


@query(f"SELECT c_custkey, c_name, b.* FROM (SELECT * FROM customer WHERE c_acctbal > 2000) FULL JOIN ({_BIG}) b ON c_custkey = o_custkey")
def join_full(t: Tables) -> DataFrame:
    return join_inputs(_customers(t), [(_big_orders(t), "full", [("c_custkey", "o_custkey")])])


@query("SELECT * FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return join_inputs(t.region, [(t.nation, "cross", [])])


@query("SELECT * FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 5000)")
def membership_keep(t: Tables) -> DataFrame:
    return membership_filter(t.orders, t.customer.where("c_acctbal > 5000"), [("o_custkey", "c_custkey")])


@query("""SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(o_orderpriority) AS p, o_orderstatus AS s FROM orders WHERE o_totalprice > 450000) r
  WHERE lower(nullif(o.o_orderpriority, '5-LOW')) = r.p AND lower(o.o_orderstatus) = lower(r.s))""")
def membership_exclude(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio"), F.lower("o_orderstatus").alias("status"))
    ref = t.orders.where("o_totalprice > 450000").select("o_orderpriority", "o_orderstatus")
    return membership_filter(rows, ref, [("prio", "o_orderpriority"), ("status", "o_orderstatus")], keep=False, case_insensitive=True).drop("status")


@query("""WITH m AS (SELECT nullif(o_orderpriority, '5-LOW') AS p FROM orders), r AS (SELECT o_orderpriority AS p FROM orders WHERE o_totalprice > 480000 AND o_orderpriority <> '1-URGENT')
SELECT count(*) AS total_main, count(*) FILTER (WHERE p IN (SELECT p FROM r)) AS matches, count(*) FILTER (WHERE p IN (SELECT p FROM r)) AS kept,
  count(*) FILTER (WHERE p IS NULL OR p NOT IN (SELECT p FROM r)) AS excluded, count(*) FILTER (WHERE p IS NULL) AS null_keys, (SELECT count(*) FROM r) AS total_ref FROM m""")
def membership_count(t: Tables) -> DataFrame:
    rows = t.orders.select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"))
    ref = t.orders.where("o_totalprice > 480000 AND o_orderpriority <> '1-URGENT'").select(F.col("o_orderpriority").alias("q"))
    return membership_counts(rows, ref, [("p", "q")])


@query("""SELECT o_orderstatus, median(o_totalprice) AS med, round(stddev_samp(o_totalprice), 4) AS sd, round(avg(o_totalprice), 4) AS mean, count(*) AS n, count(DISTINCT o_custkey) AS clients FROM orders GROUP BY o_orderstatus""")
def agg_median_stddev(t: Tables) -> DataFrame:
    out = aggregate(t.orders, ["o_orderstatus"], [("MEDIAN", "o_totalprice", "med"), ("STDDEV", "o_totalprice", "sd"), ("AVG", "o_totalprice", "mean"), ("COUNT", "o_orderkey", "n"), ("COUNT_DISTINCT", "o_custkey", "clients")])
    return out.withColumns({"sd": F.round("sd", 4), "mean": F.round("mean", 4)})


@query("""SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(value, ts) AS last_value, count(*) AS n FROM events GROUP BY user_id""")
def agg_first_last(t: Tables) -> DataFrame:
    return aggregate(t.events, ["user_id"], [("FIRST", "event_type", "first_type"), ("LAST", "value", "last_value"), ("COUNT", None, "n")], order_by=["ts", "event_id"])


@query("SELECT user_id, string_agg(event_type, ', ' ORDER BY ts DESC, event_id) AS types FROM events GROUP BY user_id")
def agg_listagg(t: Tables) -> DataFrame:
    return aggregate(t.events, ["user_id"], [("STRING_AGG", "event_type", "types")], order_by=[("ts", True), "event_id"])


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n, min(o_orderdate) AS first_day FROM orders")
def agg_global(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("p", F.col("o_totalprice").cast("decimal(18,2)"))
    return aggregate(rows, [], [("SUM", "p", "total"), ("COUNT", None, "n"), ("MIN", "o_orderdate", "first_day")]).withColumn("total", F.col("total").cast("double"))


# --- stacking ------------------------------------------------------------------


def _people(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.selectExpr("c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"), t.supplier.selectExpr("s_acctbal AS balance", "s_name AS name")


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_acctbal AS balance, s_name AS name FROM supplier")
def stack_by_name(t: Tables) -> DataFrame:
    return stack(_people(t))


@query("SELECT c_name AS who, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def stack_by_position(t: Tables) -> DataFrame:
    return stack([t.customer.selectExpr("c_name AS who", "c_acctbal AS balance"), t.supplier.select("s_name", "s_acctbal")], by_name=False)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def stack_distinct(t: Tables) -> DataFrame:
    return stack([t.customer.selectExpr("c_nationkey AS nation"), t.supplier.selectExpr("s_nationkey AS nation")], distinct=True)


@query("""WITH c AS (SELECT count(c_name) AS name, count(c_acctbal) AS balance, count(c_mktsegment) AS segment FROM customer), s AS (SELECT count(s_name) AS name, count(s_acctbal) AS balance FROM supplier)
SELECT 'name' AS "column", CAST(1 AS INTEGER) AS input, true AS present, CAST(1 AS INTEGER) AS position, 'string' AS type, name AS filled FROM c UNION ALL SELECT 'balance', 1, true, 2, 'double', balance FROM c
UNION ALL SELECT 'segment', 1, true, 3, 'string', segment FROM c UNION ALL SELECT 'name', 2, true, 2, 'string', name FROM s UNION ALL SELECT 'balance', 2, true, 1, 'double', balance FROM s UNION ALL SELECT 'segment', 2, false, NULL, NULL, 0 FROM s""")
def alignment(t: Tables) -> DataFrame:
    """How the inputs line up, and how many values each one brings to a column."""
    inputs = _people(t)
    counts = [d.agg(*[F.count(c).alias(c) for c in d.columns]).unpivot([], list(d.columns), "column", "filled").withColumn("input", F.lit(k)) for k, d in enumerate(inputs, 1)]
    return alignment_report(inputs).join(stack(counts), ["column", "input"], "left").fillna(0, ["filled"])


# --- duplicates ----------------------------------------------------------------

_KEYED = "SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {d}, event_id {d}) AS rn FROM events"
_COLS = "event_id, ts, user_id, event_type, value, props"


@query(f"SELECT {_COLS} FROM ({_KEYED.format(d='')}) WHERE rn = 1")
def dup_kept(t: Tables) -> DataFrame:
    return duplicates(t.events, ["user_id", "event_type"], ["ts", "event_id"])["kept"]


@query(f"SELECT {_COLS} FROM ({_KEYED.format(d='DESC')}) WHERE rn = 1")
def dup_kept_last(t: Tables) -> DataFrame:
    return duplicates(t.events, ["user_id", "event_type"], ["ts", "event_id"], keep="last")["kept"]


@query(f"SELECT {_COLS} FROM ({_KEYED.format(d='')}) WHERE n > 1")
def dup_all(t: Tables) -> DataFrame:
    return duplicates(t.events, ["user_id", "event_type"], ["ts", "event_id"])["dups"]


@query(f"SELECT {_COLS} FROM ({_KEYED.format(d='')}) WHERE n > 1 AND rn = 1")
def dup_exemplar(t: Tables) -> DataFrame:
    return duplicates(t.events, ["user_id", "event_type"], ["ts", "event_id"], dups_mode="exemplar")["dups"]


@query(f"SELECT {_COLS} FROM ({_KEYED.format(d='')}) WHERE rn > 1")
def dup_extra(t: Tables) -> DataFrame:
    return duplicates(t.events, ["user_id", "event_type"], ["ts", "event_id"], dups_mode="extra")["dups"]


@query("SELECT doc_id, lang, source, n_chars FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1")
def dup_uniques(t: Tables) -> DataFrame:
    return duplicates(t.documents, ["text"], ["doc_id"])["uniques"].drop("text")


@query("""WITH k AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE n > 1) AS dup_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS dup_rows,
  CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS extra, count(*) AS kept, count(*) FILTER (WHERE n = 1) AS uniques, count(*) FILTER (WHERE n > 1) AS dups FROM k""")
def dup_counts(t: Tables) -> DataFrame:
    return duplicate_counts(t.documents, ["text"], dups_mode="exemplar")


# --- reshaping -------------------------------------------------------------------

_STATUS = ("F", "O", "P")


@query("SELECT o_orderpriority, " + ", ".join(f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = '{s}') AS DOUBLE) AS {s}" for s in _STATUS) + " FROM orders GROUP BY o_orderpriority")
def pivot_status_sum(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("p", F.col("o_totalprice").cast("decimal(18,2)"))
    return pivot_table(rows, ["o_orderpriority"], "o_orderstatus", "p").withColumns({s: F.col(s).cast("double") for s in _STATUS})


@query("SELECT o_custkey, " + ", ".join(f"nullif(count(*) FILTER (WHERE o_orderstatus = '{s}'), 0) AS {s}" for s in _STATUS) + " FROM orders GROUP BY o_custkey")
def pivot_status_count(t: Tables) -> DataFrame:
    return pivot_table(t.orders, ["o_custkey"], "o_orderstatus", "o_orderkey", "COUNT", values=_STATUS)


@query("SELECT nullif(o_orderpriority, '5-LOW') AS prio, " + ", ".join(f"median(o_totalprice) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in ("F", "O")) + " FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' GROUP BY 1")
def pivot_status_median(t: Tables) -> DataFrame:
    rows = t.orders.select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio"), F.expr("nullif(o_orderstatus, 'P')").alias("status"), "o_totalprice")
    return pivot_table(rows, ["prio"], "status", "o_totalprice", "MEDIAN")


@query("SELECT user_id, " + ", ".join(f"arg_min(value, ts) FILTER (WHERE event_type = '{e}') AS {e}" for e in ("click", "purchase")) + " FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def pivot_first(t: Tables) -> DataFrame:
    rows = t.events.where("event_type in ('click', 'purchase')").select("user_id", "event_type", "value", "ts", "event_id")
    return pivot_table(rows, ["user_id"], "event_type", "value", "FIRST", order_by=["ts", "event_id"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, name, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount FROM lineitem)
UNPIVOT INCLUDE NULLS (value FOR name IN (l_quantity, l_extendedprice, l_discount))""")
def unpivot_measures(t: Tables) -> DataFrame:
    return unpivot_table(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""SELECT o_orderkey, u.name, u.value FROM orders, LATERAL (SELECT 'status' AS name, o_orderstatus AS value UNION ALL SELECT 'client', CAST(o_custkey AS VARCHAR)) u""")
def unpivot_mixed(t: Tables) -> DataFrame:
    return unpivot_table(t.orders.selectExpr("o_orderkey", "o_orderstatus AS status", "o_custkey AS client"), ["status", "client"])
