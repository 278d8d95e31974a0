"""Queries of classification: row rules, masks, group checks, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.rules import dnf, mask, rule, rule_failure_counts, with_failure_reason
from gristmill.operators.checks import group_verdicts
from gristmill.operators.routing import control, key_samples, key_scan, legacy_condition, route, route_counts, split_by, with_flag
from gristmill.plans.tables import Tables, register

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)


def _flags(df: DataFrame, keep: list[str], case_sensitive: bool = False, **rules) -> DataFrame:
    return df.select(*keep, *[rule(df, r, case_sensitive).alias(n) for n, r in rules.items()])


@query("""SELECT c_custkey, lower(c_mktsegment) = 'building' AS eq, lower(c_mktsegment) <> 'building' AS ne, lower(c_name) LIKE 'customer%' AS st, c_name LIKE '%7' AS en, lower(c_mktsegment) LIKE '%mach%' AS co,
lower(c_mktsegment) NOT LIKE '%mach%' AS nc, lower(c_mktsegment) IN ('building', 'automobile') AS li, length(c_mktsegment) = 8 AS le, length(c_mktsegment) >= 9 AS lm, regexp_matches(c_name, '#0+[1-5]') AS rx,
regexp_full_match(c_mktsegment, '(?i)[a-h]+.*') AS rf, coalesce(nullif(c_mktsegment, 'BUILDING'), '') = '' AS em, NOT (lower(c_mktsegment) = 'building') AS ng FROM customer""")
def rules_string(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("seg", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    m = "c_mktsegment"
    return _flags(
        rows, ["c_custkey"],
        eq={"column": m, "test": "equals", "value": "building"}, ne={"column": m, "test": "not_equals", "value": "Building"}, st={"column": "c_name", "test": "starts_with", "value": "CUSTOMER"},
        en={"column": "c_name", "test": "ends_with", "value": "7"}, co={"column": m, "test": "contains", "value": "mach"}, nc={"column": m, "test": "not_contains", "value": "mach"},
        li={"column": m, "test": "is_in", "value": "BUILDING, automobile,"}, le={"column": m, "test": "length_eq", "value": "8"}, lm={"column": m, "test": "length_min", "value": 9},
        rx={"column": "c_name", "test": "regex", "value": "#0+[1-5]"}, rf={"column": m, "test": "regex_full", "value": "[a-h]+.*"}, em={"column": "seg", "test": "is_empty"},
        ng={"column": m, "test": "equals", "value": "building", "negate": True},
    )


@query("""SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_retailprice > 1000 AS gt, p_retailprice >= 1000.5 AS ge, p_size < p_partkey AS lt, p_size <= 7 AS le, false AS bad,
regexp_full_match(replace(substr(p_brand, 7), ',', '.'), '[0-9]+') AS num, false AS unknown FROM part""")
def rules_numeric(t: Tables) -> DataFrame:
    rows = t.part.withColumn("tail", F.expr("substr(p_brand, 7)"))
    return _flags(
        rows, ["p_partkey"],
        eq={"column": "p_size", "test": "num_eq", "value": "10"}, ne={"column": "p_size", "test": "num_ne", "value": 10}, gt={"column": "p_retailprice", "test": "num_gt", "value": 1000},
        ge={"column": "p_retailprice", "test": "num_ge", "value": "1000.5"}, lt={"column": "p_size", "test": "num_lt", "via": "column", "column2": "p_partkey"}, le={"column": "p_size", "test": "num_le", "value": 7},
        bad={"column": "p_name", "test": "num_ne", "value": 1}, num={"column": "tail", "test": "is_numeric"}, unknown={"column": "p_size", "test": "equals", "via": "column", "column2": "absent"},
    )


@query("""SELECT c_custkey, regexp_full_match(substr(c_name, 1, 1), '[A-Za-z]') AS cl, substr(c_name, 9, 1) = '#' AS ce, lower(substr(c_name, 1, 4)) = 'cust' AS se, regexp_full_match(substr(c_name, 10, 9), '[0-9]{9}') AS sc,
regexp_full_match(substr(c_mktsegment, 1, 3), '[A-Z]{3}') AS up FROM customer""")
def rules_positional(t: Tables) -> DataFrame:
    out = _flags(
        t.customer, ["c_custkey", "c_mktsegment"],
        cl={"column": "c_name", "test": "char_class", "position": 1, "charclass": "upper"}, ce={"column": "c_name", "test": "char_equals", "position": 9, "value": "#"},
        se={"column": "c_name", "test": "substr_equals", "start": 1, "length": 4, "value": "CUST"}, sc={"column": "c_name", "test": "substr_class", "start": 10, "length": 9, "charclass": "digit"},
    )
    up = rule(out, {"column": "c_mktsegment", "test": "substr_class", "start": 1, "length": 3, "charclass": "upper"}, True)
    return out.withColumn("up", up).drop("c_mktsegment")


@query("""SELECT p_partkey, p_name LIKE '%ring%' OR p_name LIKE '%bolt%' AS anyof, NOT (p_name LIKE '%ring%' OR p_name LIKE '%bolt%') AS noneof, NOT (p_size IN (1, 2)) AS neg,
(p_size > 10 AND p_name LIKE '%small%') OR p_type = 'PROMO' AS dnf FROM part""")
def rules_multi(t: Tables) -> DataFrame:
    out = _flags(
        t.part, ["p_partkey", "p_name", "p_type", "p_size"],
        anyof={"column": "p_name", "test": "contains", "values": ["ring", "", "bolt"]}, noneof={"column": "p_name", "test": "not_contains", "values": ["ring", "bolt"]},
        neg={"column": "p_size", "test": "equals", "values": ["1", "2"], "negate": True},
    )
    spec = {"groups": [{"rules": [{"column": "p_size", "test": "num_gt", "value": 10}, {"column": "p_name", "test": "contains", "value": "small"}]}, {"rules": []}, {"rules": [{"column": "p_type", "test": "equals", "value": "promo"}]}]}
    return out.withColumn("dnf", dnf(out, spec)).drop("p_name", "p_type", "p_size")


_ABSENT = {"column": "absent", "values": ["a", "b"]}


@query("SELECT p_partkey, false AS ne, false AS neg, false AS nc, false AS via, false AS one FROM part")
def rules_unknown(t: Tables) -> DataFrame:
    """A rule on a column that is not there matches nothing, whatever its test and negation."""
    return _flags(
        t.part, ["p_partkey"], ne=_ABSENT | {"test": "not_equals"}, neg=_ABSENT | {"test": "equals", "negate": True}, nc=_ABSENT | {"test": "not_contains"},
        via={"column": "p_name", "test": "not_equals", "via": "column", "column2": "absent", "values": ["x"]}, one={"column": "absent", "test": "not_equals", "value": "a"},
    )


_NAME_MASK = [{"type": "literal", "value": "Customer#"}, {"type": "digit", "length": 9}]


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]{9}') AS ok, regexp_full_match(c_name, 'Customer#0[0-9]{2,7}[13579]') AS odd FROM customer")
def mask_customer_name(t: Tables) -> DataFrame:
    odd = [{"type": "literal", "value": "CUSTOMER#0"}, {"type": "digit", "min": 2, "max": 7}, {"type": "set", "value": "13579"}]
    return t.customer.select("c_custkey", mask(t.customer, "c_name", _NAME_MASK, True).alias("ok"), mask(t.customer, "c_name", odd).alias("odd"))


_ROUTE_RULES = [
    {"column": "c_acctbal", "test": "num_gt", "value": 0, "label": "solde positif"},
    {"column": "c_mktsegment", "test": "not_equals", "value": "BUILDING", "label": "pas BUILDING"},
    {"column": "c_nationkey", "test": "num_le", "value": 12, "label": "nation <= 12"},
]


@query("""SELECT c_custkey, CASE WHEN NOT c_acctbal > 0 THEN 'solde positif' WHEN c_mktsegment = 'BUILDING' THEN 'pas BUILDING' WHEN c_nationkey > 12 THEN 'nation <= 12' END AS motif,
(CASE WHEN NOT c_acctbal > 0 THEN 1 ELSE 0 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) + (CASE WHEN c_nationkey > 12 THEN 1 ELSE 0 END) AS n FROM customer""")
def failure_reasons(t: Tables) -> DataFrame:
    return with_failure_reason(t.customer, {"groups": [{"rules": _ROUTE_RULES}]}).select("c_custkey", "motif", F.size("failed_rules").alias("n"))


@query("""SELECT CAST(0 AS INTEGER) AS place, 'solde positif' AS label, count(*) FILTER (WHERE NOT c_acctbal > 0) AS failed FROM customer
UNION ALL SELECT 1, 'pas BUILDING', count(*) FILTER (WHERE c_mktsegment = 'BUILDING') FROM customer UNION ALL SELECT 2, 'nation <= 12', count(*) FILTER (WHERE c_nationkey > 12) FROM customer""")
def failure_counts(t: Tables) -> DataFrame:
    return rule_failure_counts(t.customer, {"groups": [{"rules": _ROUTE_RULES}]})


# --- group checks ---------------------------------------------------------------------

_G = "SELECT o_custkey AS g, o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio, o_orderstatus AS status, o_totalprice AS price FROM orders"


def _orders(t: Tables) -> DataFrame:
    return t.orders.selectExpr("o_custkey AS g", "o_orderkey", "nullif(o_orderpriority, '5-LOW') AS prio", "o_orderstatus AS status", "o_totalprice AS price")


def _checks(df: DataFrame, key: str, ident: str, **checks) -> DataFrame:
    out = group_verdicts(df, [key], {n: [c] if isinstance(c, dict) else c for n, c in checks.items()})
    return out.select(ident, *checks)


def _per_group(**verdicts: str) -> str:
    return f"WITH o AS ({_G}), v AS (SELECT g, {', '.join(f'{e} AS {n}' for n, e in verdicts.items())} FROM o GROUP BY g) SELECT o_orderkey, {', '.join(verdicts)} FROM o JOIN v USING (g)"


@query(_per_group(eq="count(*) = 5", at_least="count(*) >= 8", at_most="count(*) <= 12", within="count(*) >= 8 AND count(*) <= 12"))
def check_size(t: Tables) -> DataFrame:
    low, high = {"check": "size_min", "n": 8}, {"check": "size_max", "n": 12}
    return _checks(_orders(t), "g", "o_orderkey", eq={"check": "size_eq", "n": 5}, at_least=low, at_most=high, within=[low, high])


@query(_per_group(none="count(*) FILTER (WHERE prio IS NULL) = 0", filled="count(prio) > 0", nothing="count(prio) = 0"))
def check_null(t: Tables) -> DataFrame:
    return _checks(_orders(t), "g", "o_orderkey", none={"check": "no_null", "column": "prio"}, filled={"check": "not_all_null", "column": "prio"}, nothing={"check": "all_null", "column": "prio"})


_NDV = "count(DISTINCT coalesce(lower(prio), '~'))"


@query(_per_group(uniq=f"{_NDV} = count(*)", const=f"{_NDV} <= 1", three=f"{_NDV} = 3", least=f"{_NDV} >= 4", most=f"{_NDV} <= 2"))
def check_distinct(t: Tables) -> DataFrame:
    return _checks(
        _orders(t), "g", "o_orderkey", uniq={"check": "unique", "column": "prio"}, const={"check": "constant", "column": "prio"}, three={"check": "distinct_eq", "column": "prio", "n": 3},
        least={"check": "distinct_min", "column": "prio", "n": "4"}, most={"check": "distinct_max", "column": "prio", "n": 2},
    )


@query(_per_group(has="count(*) FILTER (WHERE status = 'P') > 0", hasnt="count(*) FILTER (WHERE status = 'P') = 0", sub="count(*) FILTER (WHERE contains(coalesce(lower(prio), ''), lower(status))) > 0"))
def check_contains(t: Tables) -> DataFrame:
    return _checks(
        _orders(t), "g", "o_orderkey", has={"check": "contains", "column": "status", "value": "p"}, hasnt={"check": "not_contains", "column": "status", "value": "P"},
        sub={"check": "contains", "column": "prio", "column2": "status"},
    )


@query(_per_group(num="count(*) FILTER (WHERE NOT o_orderkey < price) = 0", txt="count(*) FILTER (WHERE NOT coalesce(lower(prio), '') <> lower(status)) = 0", cmp=f"{_NDV} > count(DISTINCT status)", bad="false"))
def check_compare(t: Tables) -> DataFrame:
    return _checks(
        _orders(t), "g", "o_orderkey", num={"check": "rows_cols_cmp", "column": "o_orderkey", "column2": "price", "op": "lt"}, txt={"check": "rows_cols_cmp", "column": "prio", "column2": "status", "op": "ne"},
        cmp={"check": "distinct_cmp", "column": "prio", "column2": "status", "op": "gt"}, bad={"check": "rows_cols_cmp", "column": "prio", "column2": "status", "op": "gt"},
    )


@query(_per_group(dep=f"{_NDV} = count(DISTINCT coalesce(lower(prio), '~') || '|' || status)", back="count(DISTINCT status) = count(DISTINCT coalesce(lower(prio), '~') || '|' || status)"))
def check_determines(t: Tables) -> DataFrame:
    return _checks(_orders(t), "g", "o_orderkey", dep={"check": "determines", "column": "prio", "column2": "status"}, back={"check": "determines", "column": "status", "column2": "prio"})


def _is(column: str, value: str) -> dict:
    return {"groups": [{"rules": [{"column": column, "test": "equals", "value": value}]}]}


@query(_per_group(sat="count(*) FILTER (WHERE status = 'F' AND NOT price > 20000) = 0"))
def check_rows_satisfy(t: Tables) -> DataFrame:
    then = {"groups": [{"rules": [{"column": "price", "test": "num_gt", "value": 20000}]}]}
    return _checks(_orders(t), "g", "o_orderkey", sat={"check": "rows_satisfy", "when": _is("status", "F"), "then": then})


@query(_per_group(size="count(*) FILTER (WHERE status = 'P') >= 2 OR count(*) FILTER (WHERE status = 'P') = 0", filled="count(prio) FILTER (WHERE status = 'P') = count(*) FILTER (WHERE status = 'P')", never="true"))
def check_premise(t: Tables) -> DataFrame:
    return _checks(
        _orders(t), "g", "o_orderkey", size={"check": "size_min", "n": 2, "when": _is("status", "P")}, filled={"check": "no_null", "column": "prio", "when": _is("status", "P")},
        never={"check": "all_null", "column": "status", "when": _is("status", "absent")},
    )


# --- routing --------------------------------------------------------------------------

_CONDITIONS = [
    {"id": "big", "groups": [{"rules": [{"column": "o_totalprice", "test": "num_gt", "value": 300000}]}]},
    {"id": "urgent", "kind": "mask", "column": "o_orderpriority", "segments": [{"type": "set", "value": "12"}, {"type": "literal", "value": "-"}, {"type": "letter", "min": 1}]},
    {"id": "busy", "kind": "group", "group_by": ["o_custkey"], "checks": [{"check": "size_min", "n": 15}]},
]
_OUTPUTS = [{"id": "A", "match": {"condition": "big"}}, {"id": "B", "match": {"condition": "urgent", "negate": True}}, {"id": "C", "match": {"condition": "busy"}}]
_MATCH = """SELECT *, o_totalprice > 300000 AS a, NOT regexp_full_match(o_orderpriority, '[12]-[A-Za-z]+') AS b, count(*) OVER (PARTITION BY o_custkey) >= 15 AS c FROM orders"""


@query(f"SELECT o_orderkey, CASE WHEN a THEN 'A' WHEN b THEN 'B' WHEN c THEN 'C' ELSE 'else' END AS route FROM ({_MATCH})")
def route_first(t: Tables) -> DataFrame:
    return route(t.orders, _OUTPUTS, _CONDITIONS).select("o_orderkey", "route")


@query(f"WITH m AS ({_MATCH}) SELECT o_orderkey, 'A' AS route FROM m WHERE a UNION ALL SELECT o_orderkey, 'B' FROM m WHERE b UNION ALL SELECT o_orderkey, 'C' FROM m WHERE c UNION ALL SELECT o_orderkey, 'else' FROM m WHERE NOT (a OR b OR c)")
def route_all(t: Tables) -> DataFrame:
    return route(t.orders, _OUTPUTS, _CONDITIONS, mode="all").select("o_orderkey", "route")


@query(f"SELECT CASE WHEN a THEN 'A' WHEN b THEN 'B' WHEN c THEN 'C' END AS route, count(*) AS rows FROM ({_MATCH}) GROUP BY 1")
def route_count(t: Tables) -> DataFrame:
    return route_counts(route(t.orders, _OUTPUTS, _CONDITIONS, else_output=False))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 OR c_mktsegment = 'BUILDING' THEN 'oui' ELSE 'non' END AS valide FROM customer")
def control_flag(t: Tables) -> DataFrame:
    spec = legacy_condition({"mode": "rules", "combine": "any", "rules": [{"column": "c_acctbal", "test": "num_gt", "value": 0}, {"column": "c_mktsegment", "test": "equals", "value": "building"}]})
    return with_flag(t.customer, spec).select("c_custkey", "valide")


@query("SELECT page_id, CASE WHEN lower(split_part(url, '/', 3)) = 'www.site1.example' THEN 'one' WHEN lower(split_part(url, '/', 3)) = 'www.site2.example' THEN 'two' ELSE 'else' END AS route FROM pages")
def split_host(t: Tables) -> DataFrame:
    return split_by(t.pages, "url", {"type": "segment", "sep": "/", "index": 3}, {"www.site1.example": "one", "www.site2.example": "two"}).select("page_id", "route")


@query("SELECT page_id, CASE WHEN k IN ('html', 'com') THEN k ELSE 'else' END AS route FROM (SELECT page_id, CASE WHEN contains(url, '.') THEN lower(split_part(url, '.', -1)) ELSE '' END AS k FROM pages)")
def split_ext(t: Tables) -> DataFrame:
    return split_by(t.pages, "url", {"type": "after_last", "sep": "."}, ["html", "com"]).select("page_id", "route")


@query("SELECT c_custkey, regexp_full_match(c_mktsegment, '[A-Z]{8,9}') AS ok FROM customer")
def control_mask(t: Tables) -> DataFrame:
    spec = legacy_condition({"mode": "mask", "column": "c_mktsegment", "segments": [{"type": "upper", "min": 8, "max": 9}]})
    sides = control(t.customer, spec, case_sensitive=True)
    return sides["valid"].select("c_custkey", F.lit(True).alias("ok")).union(sides["invalid"].select("c_custkey", F.lit(False)))


@query("""SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN 'small' ELSE 'else' END AS before, CASE WHEN substr(p_brand, 7, 1) = '1' THEN '1' WHEN substr(p_brand, 7, 1) = '2' THEN '2' ELSE 'else' END AS piece,
CASE WHEN regexp_extract(p_brand, '([0-9])$', 1) = '3' THEN '3' ELSE 'else' END AS pattern FROM part""")
def split_extractors(t: Tables) -> DataFrame:
    """Three kinds of extracted keys side by side."""
    out = t.part
    for name, column, extractor, values in (
        ("before", "p_name", {"type": "before_first", "sep": " "}, ["small"]), ("piece", "p_brand", {"type": "substring", "start": 7, "length": 1}, ["1", "2"]), ("pattern", "p_brand", {"type": "regex", "pattern": "([0-9])$"}, ["3"]),
    ):
        out = split_by(out, column, extractor, values).withColumnRenamed("route", name)
    return out.select("p_partkey", "before", "piece", "pattern")


@query("""SELECT DISTINCT o_orderpriority AS raw, lower(split_part(o_orderpriority, '-', -1)) AS key FROM orders ORDER BY raw LIMIT 3""")
def key_raw_samples(t: Tables) -> DataFrame:
    return key_samples(t.orders, "o_orderpriority", {"type": "after_last", "sep": "-"}, n=3)


@query("""WITH k AS (SELECT source AS key, count(*) AS rows, min(source) AS example FROM documents GROUP BY 1)
SELECT key, rows, example, (SELECT count(*) FROM k) AS n_keys, (SELECT count(*) FROM k) > 200 AS truncated FROM k ORDER BY rows DESC, key LIMIT 200""")
def source_scan(t: Tables) -> DataFrame:
    return key_scan(t.documents, "source", {"type": "whole"})
