"""Queries of preparation: cleaning, casts, spreadsheet functions, group columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import xl
from gristmill.operators.cleaning import apply_casts, clean, clean_report
from gristmill.operators.grouped import value_when, with_group_columns
from gristmill.plans.tables import Tables, register

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)
c = F.col

_MESSY = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ' ' || chr(160) || o_orderpriority || chr(9) END AS prio, replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END AS price, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders"


def _messy(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.when(c("o_orderkey") % 7 != 0, F.concat(F.lit("  "), "o_orderpriority", F.lit("\t"))).alias("prio"),
        F.concat(F.replace(c("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.when(c("o_orderkey") % 5 == 0, "x").otherwise("")).alias("price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
    )


@query(f"""SELECT o_orderkey, coalesce(upper(substr(x, 1, 1)) || lower(substr(x, 2)), 'none') AS prio, price, day
FROM (SELECT *, regexp_replace(replace(trim(replace(replace(prio, chr(160), ' '), chr(9), ' ')), '-', '_'), '([0-9])_', '\\1: ') AS x FROM ({_MESSY}))""")
def clean_text(t: Tables) -> DataFrame:
    steps = [
        {"op": "trim", "column": "prio"}, {"op": "replace", "column": "prio", "find": "-", "replace": "_"},
        {"op": "replace", "column": "prio", "find": "([0-9])_", "replace": "\\1: ", "regex": True}, {"op": "capitalize", "column": "prio"},
        {"op": "fillna", "column": "prio", "value": "none"}, {"op": "upper", "column": "absent"}, {"op": "upper", "column": "prio", "enabled": False},
    ]
    return clean(_messy(t), steps)


@query(f"""SELECT o_orderkey, abs(try_cast(replace(price, ',', '.') AS DOUBLE)) AS price, CAST(round_even(try_cast(replace(price, ',', '.') AS DOUBLE), 0) AS BIGINT) AS whole,
round_even(try_cast(replace(price, ',', '.') AS DOUBLE) * 10.0, 0) / 10.0 AS tenth FROM ({_MESSY})""")
def clean_numbers(t: Tables) -> DataFrame:
    rows = _messy(t).select("o_orderkey", "price", c("price").alias("whole"), c("price").alias("tenth"))
    return clean(rows, [{"op": "to_number", "column": "price"}, {"op": "abs", "column": "price"}, {"op": "to_integer", "column": "whole"}, {"op": "to_number", "column": "tenth"}, {"op": "round", "column": "tenth", "digits": 1}])


@query(f"SELECT o_orderkey, try_strptime(day, '%d/%m/%Y') AS day, try_strptime(day, '%d/%m/%Y') AS guess FROM ({_MESSY})")
def clean_dates(t: Tables) -> DataFrame:
    rows = _messy(t).select("o_orderkey", "day", c("day").alias("guess"))
    return clean(rows, [{"op": "to_date", "column": "day", "format": "%d/%m/%Y"}, {"op": "to_date", "column": "guess"}])


@query(f"""WITH m AS ({_MESSY}), s AS (
SELECT 0 AS step, 'trim' AS op, 'prio' AS "column", prio AS a, trim(replace(replace(prio, chr(160), ' '), chr(9), ' ')) AS b FROM m
UNION ALL SELECT 1, 'to_number', 'price', price, CAST(try_cast(replace(price, ',', '.') AS DOUBLE) AS VARCHAR) || 'n' FROM m
UNION ALL SELECT 2, 'fillna', 'prio', trim(replace(replace(prio, chr(160), ' '), chr(9), ' ')), coalesce(trim(replace(replace(prio, chr(160), ' '), chr(9), ' ')), '') FROM m)
SELECT CAST(step AS INTEGER) AS step, op, "column", count(*) FILTER (WHERE a IS DISTINCT FROM b) AS changed, count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS failed, count(*) FILTER (WHERE a IS NULL) AS was_null FROM s GROUP BY ALL""")
def cleaning_report(t: Tables) -> DataFrame:
    return clean_report(_messy(t), [{"op": "trim", "column": "prio"}, {"op": "to_number", "column": "price"}, {"op": "fillna", "column": "prio", "value": ""}]).drop("samples")


@query(f"""WITH m AS ({_MESSY}), t AS (SELECT o_orderkey, prio AS old, trim(replace(replace(prio, chr(160), ' '), chr(9), ' ')) AS new FROM m), p AS (SELECT o_orderkey, price AS old, replace(price, 'x', '?') AS new FROM m),
s AS (SELECT 0 AS step, row_number() OVER (ORDER BY o_orderkey) AS place, old, new FROM t WHERE old IS DISTINCT FROM new UNION ALL SELECT 1, row_number() OVER (ORDER BY o_orderkey), old, new FROM p WHERE old IS DISTINCT FROM new)
SELECT CAST(step AS INTEGER) AS step, CAST(place AS INTEGER) AS place, old, new FROM s WHERE place <= 5""")
def cleaning_samples(t: Tables) -> DataFrame:
    """Old and new values of the first five rows that each step changes."""
    report = clean_report(_messy(t), [{"op": "trim", "column": "prio"}, {"op": "replace", "column": "price", "find": "x", "replace": "?"}], order_by=["o_orderkey"])
    return report.select("step", F.posexplode("samples")).select("step", (c("pos") + 1).alias("place"), "col.old", "col.new")


_RAW = "SELECT o_orderkey, replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE '' END AS price, CASE WHEN o_orderstatus = 'F' THEN 'Oui' WHEN o_orderstatus = 'O' THEN 'non' ELSE 'peut-etre' END AS closed FROM orders"


def _raw(t: Tables) -> DataFrame:
    price = F.concat(F.replace(c("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.when(c("o_orderkey") % 5 == 0, "?").otherwise(""))
    return t.orders.select("o_orderkey", price.alias("price"), F.when(c("o_orderstatus") == "F", "Oui").when(c("o_orderstatus") == "O", "non").otherwise("peut-etre").alias("closed"))


_CASTS = [{"column": "price", "type": "number"}, {"column": "closed", "type": "boolean"}, {"column": "o_orderkey", "type": "text"}]


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, try_cast(replace(price, ',', '.') AS DOUBLE) AS price, CASE closed WHEN 'Oui' THEN true WHEN 'non' THEN false END AS closed FROM ({_RAW})")
def casts_typed(t: Tables) -> DataFrame:
    return apply_casts(_raw(t), _CASTS, decimal=",")[0]


@query(f"""WITH r AS ({_RAW}) SELECT 'price' AS "column", 'number' AS type, count(*) FILTER (WHERE try_cast(replace(price, ',', '.') AS DOUBLE) IS NULL) AS failed FROM r
UNION ALL SELECT 'closed', 'boolean', count(*) FILTER (WHERE closed = 'peut-etre') FROM r UNION ALL SELECT 'o_orderkey', 'text', 0 FROM r LIMIT 3""")
def casts_report(t: Tables) -> DataFrame:
    return apply_casts(_raw(t), _CASTS, decimal=",")[1]


# --- spreadsheet functions -----------------------------------------------------------


@query("""SELECT page_id, upper(url) AS up, left(url, 8) AS l8, left(url, -3) AS l3, right(url, 4) AS r4, right(url, -5) AS r5, substr(url, 3, 5) AS m, CAST(length(url) AS INTEGER) AS n,
repeat('ab', 3) AS rep, replace(url, '/', '|') AS subs, substr(url, 1, 2) || 'XX' || substr(url, 5) AS repl, concat('p', CAST(page_id AS VARCHAR), NULL) AS cc, 'p' || CAST(page_id AS VARCHAR) AS amp FROM pages""")
def xl_text(t: Tables) -> DataFrame:
    u = c("url")
    return t.pages.select(
        "page_id", xl.upper(u).alias("up"), xl.left(u, 8).alias("l8"), xl.left(u, -3).alias("l3"), xl.right(u, 4).alias("r4"), xl.right(u, -5).alias("r5"), xl.mid(u, 3, 5).alias("m"),
        xl.len_(u).alias("n"), xl.rept("ab", 3).alias("rep"), xl.substitute(u, "/", "|").alias("subs"), xl.replace(u, 3, 2, "XX").alias("repl"),
        xl.concat("p", c("page_id"), F.lit(None)).alias("cc"), xl.concat_values("p", c("page_id")).alias("amp"),
    )


@query("""SELECT page_id, nullif(instr(url, '/'), 0) AS f, CASE WHEN instr(substr(url, 10), '/') > 0 THEN instr(substr(url, 10), '/') + 9 END AS f10, nullif(instr(lower(url), 'http'), 0) AS s, nullif(instr(url, '~none~'), 0) AS absent FROM pages""")
def xl_find(t: Tables) -> DataFrame:
    u = c("url")
    return t.pages.select("page_id", xl.find("/", u).alias("f"), xl.find("/", u, 10).alias("f10"), xl.search("HTTP", u).alias("s"), xl.find("~none~", u).alias("absent")).select(
        "page_id", *[c(n).cast("long").alias(n) for n in ("f", "f10", "s", "absent")]
    )


@query("""SELECT page_id, array_to_string(string_split(url, '/')[:3], '/') AS b3, array_to_string(string_split(url, '/')[4:], '/') AS a3, array_to_string(string_split(url, '/')[:-2], '/') AS bl, array_to_string(string_split(url, '/')[-1:], '/') AS al,
url AS none_b, '' AS none_a, '' AS none_bl, url AS none_al FROM pages""")
def xl_before_after(t: Tables) -> DataFrame:
    u = c("url")
    return t.pages.select(
        "page_id", xl.textbefore(u, "/", 3).alias("b3"), xl.textafter(u, "/", 3).alias("a3"), xl.textbefore(u, "/", -1).alias("bl"), xl.textafter(u, "/", -1).alias("al"),
        xl.textbefore(u, "~~").alias("none_b"), xl.textafter(u, "~~").alias("none_a"), xl.textbefore(u, "~~", -1).alias("none_bl"), xl.textafter(u, "~~", -1).alias("none_al"),
    )


@query("""SELECT page_id, regexp_extract(url, '[0-9]+', 0) AS digits, regexp_extract(url, '//([^/]+)', 1) AS host, regexp_replace(url, '([a-z])([0-9])', '\\1-\\2', 'g') AS dashed FROM pages""")
def xl_regex(t: Tables) -> DataFrame:
    u = c("url")
    return t.pages.select("page_id", xl.regexextract(u, "[0-9]+").alias("digits"), xl.regexextract(u, "//([^/]+)", 1).alias("host"), xl.regexreplace(u, "([a-z])([0-9])", "\\1-\\2").alias("dashed"))


@query("""SELECT o_orderkey, o_totalprice / nullif(o_orderkey % 3, 0) AS d, o_orderkey % 7 AS m, floor(o_totalprice * 10.0 + 0.5) / 10.0 AS r1, floor(o_totalprice / 100.0 * 1.0 + 0.5) AS r0, abs(-o_totalprice) AS a,
power(o_orderkey % 10, 2) AS p, least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey, 500) AS hi, o_totalprice AS one FROM orders""")
def xl_math(t: Tables) -> DataFrame:
    k, p = c("o_orderkey"), c("o_totalprice")
    return t.orders.select(
        "o_orderkey", xl.divide(p, k % 3).alias("d"), xl.mod(k, F.lit(7).cast("long")).alias("m"), xl.round_(p, 1).alias("r1"), xl.round_(p / 100.0).alias("r0"), xl.abs_(-p).alias("a"), xl.power(k % 10, 2).alias("p"),
        xl.min_(k, c("o_custkey")).alias("lo"), xl.max_(k, c("o_custkey"), F.lit(500).cast("long")).alias("hi"), xl.max_(p).alias("one"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'O' OR NOT (o_custkey > 10) THEN 'big' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'P' THEN 1 END AS open,
coalesce(nullif(o_orderpriority, '5-LOW'), 'low') AS prio, nullif(o_orderpriority, '5-LOW') IS NULL AS blank, CAST(o_orderkey AS VARCHAR) AS txt, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS val, try_cast(o_orderstatus AS DOUBLE) AS noval FROM orders""")
def xl_logic(t: Tables) -> DataFrame:
    prio = F.nullif(c("o_orderpriority"), F.lit("5-LOW"))
    big = xl.or_(xl.and_(c("o_totalprice") > 100000, c("o_orderstatus") == "O"), xl.not_(c("o_custkey") > 10))
    return t.orders.select(
        "o_orderkey", xl.if_(big, "big", "small").alias("size"), xl.if_(c("o_orderstatus") == "P", 1).alias("open"), xl.coalesce(prio, "low").alias("prio"), xl.isblank(prio).alias("blank"),
        xl.text(c("o_orderkey")).alias("txt"), xl.value(xl.left(c("o_orderpriority"), 1)).alias("val"), xl.value(c("o_orderstatus")).alias("noval"),
    )


@query("SELECT o_orderkey, o_orderdate < current_date AS past, date_diff('day', CAST(o_orderdate AS DATE), current_date) > 0 AS old FROM orders")
def xl_today(t: Tables) -> DataFrame:
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", (d < xl.today()).alias("past"), (F.date_diff(xl.today(), d) > 0).alias("old"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
def xl_dates(t: Tables) -> DataFrame:
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", xl.year(d).alias("y"), xl.month(d).alias("m"), xl.day(d).alias("d"))


@query("""SELECT c_custkey, split_part(c_name, '#', 2) AS tail, left(c_name, 4) AS head, substr(c_name, 2, 3) AS middle, lower(c_name) AS low, concat_ws(' / ', c_name, c_mktsegment) AS both,
CASE WHEN contains(c_mktsegment, 'BUILD') THEN 'b' ELSE 'o' END AS kind, sign(c_acctbal) * floor(abs(c_acctbal * 1.2) * 100.0 + 0.5) / 100.0 AS taxed FROM customer""")
def xl_guided(t: Tables) -> DataFrame:
    n = c("c_name")
    return xl.with_columns_in_order(
        t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"),
        [
            ("tail", xl.extract(n, "after", "#")), ("head", xl.extract(n, "first", n=4)), ("middle", xl.extract(n, "mid", start=2, n=3)), ("low", xl.transform(n, "lower")),
            ("both", xl.combine([n, c("c_mktsegment")], " / ")), ("kind", xl.condition(c("c_mktsegment"), "contains", "BUILD", "b", "o")), ("taxed", xl.math(c("c_acctbal"), "*", 1.2, 2)),
        ],
    ).drop("c_name", "c_mktsegment", "c_acctbal")


# --- group columns -----------------------------------------------------------------------


@query("""SELECT event_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id) AS group_size, lag(value) OVER w AS before, lead(value) OVER w AS after,
first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opening,
last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closing
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def group_rank_lag(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    functions = [
        {"fn": "occurrence", "name": "place"}, {"fn": "group_size"}, {"fn": "prev", "name": "before", "column": "value"}, {"fn": "next", "name": "after", "column": "value"},
        {"fn": "first", "name": "opening", "column": "event_type"}, {"fn": "last", "name": "closing", "column": "event_type"},
    ]
    return with_group_columns(rows, ["user_id"], ["ts", "event_id"], functions).drop("user_id", "ts", "event_type", "value")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)
SELECT o_orderkey, CAST(sum(p) OVER w AS DOUBLE) AS total, min(p) OVER w AS lo, max(p) OVER w AS hi, round(CAST(p AS DOUBLE) / CAST(sum(p) OVER w AS DOUBLE), 9) AS share FROM o WINDOW w AS (PARTITION BY o_custkey)""")
def group_totals_share(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", c("o_totalprice").cast("decimal(18,2)").alias("p"))
    functions = [{"fn": "sum", "name": "total", "column": "p"}, {"fn": "min", "name": "lo", "column": "p"}, {"fn": "max", "name": "hi", "column": "p"}, {"fn": "share", "column": "p"}]
    out = with_group_columns(rows, ["o_custkey"], None, functions)
    return out.select("o_orderkey", c("total").cast("double").alias("total"), "lo", "hi", F.round("share", 9).alias("share"))


@query("""SELECT o_orderkey, (SELECT count(DISTINCT o_orderpriority) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderpriority <> '5-LOW') AS kinds,
CASE WHEN count(*) OVER (PARTITION BY o_custkey, nullif(o_orderpriority, '5-LOW')) > 1 THEN 'oui' ELSE 'non' END AS twice FROM orders o""")
def group_distinct_conflict(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio"))
    return with_group_columns(rows, ["o_custkey"], None, [{"fn": "count_distinct", "name": "kinds", "column": "prio"}, {"fn": "is_duplicate", "name": "twice", "column": "prio"}]).select("o_orderkey", "kinds", "twice")


@query("""WITH g AS (SELECT user_id, string_agg(event_type, ', ' ORDER BY ts, event_id) AS types, median(value) AS med, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY user_id)
SELECT event_id, types, med, round(mean, 6) AS mean FROM events JOIN g USING (user_id)""")
def group_concat_median(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    functions = [{"fn": "concat", "name": "types", "column": "event_type"}, {"fn": "median", "name": "med", "column": "value"}, {"fn": "avg", "name": "mean", "column": "value"}]
    return with_group_columns(rows, ["user_id"], ["ts", "event_id"], functions).select("event_id", "types", "med", F.round("mean", 6).alias("mean"))


@query("SELECT o_orderkey, count(*) OVER () AS group_size, CAST(sum(o_custkey) OVER () AS BIGINT) AS total, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS kinds FROM orders")
def group_whole_table(t: Tables) -> DataFrame:
    functions = [{"fn": "group_size"}, {"fn": "sum", "name": "total", "column": "o_custkey"}, {"fn": "count_distinct", "name": "kinds", "column": "o_orderpriority"}]
    return with_group_columns(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), [], None, functions).drop("o_custkey", "o_orderpriority")


_BUYS = {"groups": [{"rules": [{"column": "event_type", "test": "equals", "value": "purchase"}]}]}


def _when(t: Tables, **how) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    return value_when(rows, ["user_id"], "got", _BUYS, how.pop("source", "value"), order_by=["ts", "event_id"], **how).select("event_id", "got")


def _when_sql(expr: str) -> str:
    return f"SELECT event_id, got FROM events LEFT JOIN (SELECT user_id, {expr} AS got FROM events WHERE event_type = 'purchase' GROUP BY user_id) USING (user_id)"


@query(_when_sql("arg_min(value, ts)"))
def value_when_first(t: Tables) -> DataFrame:
    return _when(t)


@query(_when_sql("arg_max(props, ts)"))
def value_when_last(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "props")
    return value_when(rows, ["user_id"], "got", _BUYS, "props", "last", order_by=["ts", "event_id"]).select("event_id", "got")


@query("SELECT event_id, coalesce(got, -1.0) AS got FROM (" + _when_sql("max(value)") + ")")
def value_when_max(t: Tables) -> DataFrame:
    return _when(t, reducer="max", fallback=-1)


@query("SELECT event_id, round(got, 6) AS got FROM (" + _when_sql("sum(value)") + ")")
def value_when_sum(t: Tables) -> DataFrame:
    return _when(t, reducer="sum").withColumn("got", F.round("got", 6))


@query("SELECT event_id, coalesce(got, 'aucun') AS got FROM (" + _when_sql("string_agg(CAST(event_id AS VARCHAR), ', ' ORDER BY ts, event_id)") + ")")
def value_when_concat(t: Tables) -> DataFrame:
    return _when(t, source="event_id", reducer="concat", fallback="aucun")
