"""Joins, membership, aggregates, duplicates, stacking and reshaping on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators.duplicates import duplicate_counts, duplicates
from gristmill.operators.filtering import membership_counts, membership_filter
from gristmill.operators.relational import aggregate, chain, join_inputs, literal, predicate, select_columns, sort_limit, sql_over
from gristmill.operators.reshape import pivot_table, unpivot_table
from gristmill.operators.stacking import alignment_report, stack


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("FR", 100, "a"), ("FR", 200, "b"), ("DE", 50, "c"), ("US", 400, "d"), ("DE", 75, "e")], "Country string, Amount long, Client string")


@pytest.fixture(scope="module")
def quarters(spark):
    return spark.createDataFrame([("FR", "Q1", 10), ("FR", "Q2", 20), ("DE", "Q1", 30), ("DE", "Q2", 40)], "Country string, Quarter string, Amount long")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_join_group_order(spark, sales):
    regions = spark.createDataFrame([("FR", "Europe"), ("DE", "Europe"), ("US", "Amerique")], "C string, Region string")
    joined = join_inputs(sales, [(regions, "left", [("Country", "C")])]).where(predicate(">", "Amount", 60, value_type="number"))
    out = sort_limit(aggregate(joined, ["Country", "Region"], [("SUM", "Amount", "total")]), ["total"])
    assert rows(out) == [("DE", "Europe", 75), ("FR", "Europe", 300), ("US", "Amerique", 400)]


def test_order_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert rows(sort_limit(df, ["x"])) == [(1,), (3,), (None,)]
    assert rows(sort_limit(df, [("x", True)], "2")) == [(3,), (1,)]


def test_and_binds_tighter_than_or(spark):
    df = spark.range(6)
    got = chain([("", F.col("id") == 1), ("OR", F.col("id") > 2), ("AND", F.col("id") < 4)])
    assert sorted(r[0] for r in df.where(got).collect()) == [1, 3]


def test_errors_at_plan_time(spark, sales):
    with pytest.raises(ValueError):
        literal("abc", "number")
    with pytest.raises(ValueError):
        predicate("IN", "Amount", " , ")
    with pytest.raises(ValueError):
        sort_limit(sales, limit="many")
    with pytest.raises(ValueError):
        select_columns(sales, [{"name": "Country", "rename": "Client"}])
    with pytest.raises(ValueError):
        select_columns(sales, [{"name": n, "keep": False} for n in sales.columns])
    with pytest.raises(ValueError):
        pivot_table(sales, [], "Country", "Amount")
    with pytest.raises(ValueError):
        aggregate(sales, [], [("FIRST", "Amount", "x")])


def test_aggregates_in_order(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, None)], "k string, o int, v string")
    out = aggregate(df, ["k"], [("FIRST", "v", "first"), ("LAST", "v", "last"), ("STRING_AGG", "v", "all"), ("COUNT", "v", "n"), ("COUNT", None, "rows")], order_by=["o"])
    assert sorted(rows(out)) == [("a", None, "z", "y, z", 2, 3), ("b", None, None, None, 0, 1)]
    down = aggregate(df, ["k"], [("FIRST", "v", "first"), ("STRING_AGG", "v", "all")], order_by=[("o", True)])
    assert sorted(rows(down)) == [("a", "z", "z, y"), ("b", None, None)]


def test_sql_over(spark, sales):
    assert rows(sql_over(spark, "SELECT count(*) FROM {in1} WHERE Amount > 60", in1=sales)) == [(4,)]


def test_duplicates(spark):
    df = spark.createDataFrame([("FR", "a", 100, 1), ("FR", "a", 100, 2), ("DE", "b", 50, 3), ("US", "c", 400, 4), ("FR", "a", 999, 5)], "Country string, Client string, Amount long, o int")
    keys = ["Country", "Client"]
    out = duplicates(df, keys, ["o"])
    assert (out["kept"].count(), out["dups"].count(), out["uniques"].count()) == (3, 3, 2)
    assert duplicates(df, keys, ["o"], dups_mode="exemplar")["dups"].count() == 1
    assert [r["o"] for r in duplicates(df, keys, ["o"], keep="last")["kept"].orderBy("o").collect()] == [3, 4, 5]
    with pytest.raises(ValueError):
        duplicates(df, ["absent"], ["o"])
    with pytest.raises(ValueError):
        duplicates(df, keys)


def test_duplicate_counts_and_whole_rows(spark):
    df = spark.createDataFrame([(x,) for x in "AABCCC"] + [(None,), (None,)], "nom string")
    r = duplicate_counts(df).first()
    assert (r["total"], r["dup_groups"], r["dup_rows"], r["extra"], r["kept"], r["uniques"]) == (8, 3, 7, 4, 4, 1)
    assert duplicates(df, None)["kept"].count() == 4
    assert duplicate_counts(df.where("false")).first()["total"] == 0


def test_membership(spark):
    main = spark.createDataFrame([("A",), (None,), ("C",), ("A",)], "code string")
    ref = spark.createDataFrame([("A",), ("C",), (None,)], "k string")
    assert membership_filter(main, ref, [("code", "k")]).count() == 3
    assert rows(membership_filter(main, ref, [("code", "k")], keep=False)) == [(None,)]
    r = membership_counts(main, ref, [("code", "k")]).first()
    assert (r["total_main"], r["total_ref"], r["matches"], r["kept"], r["excluded"], r["null_keys"]) == (4, 3, 3, 3, 1, 1)
    cased = spark.createDataFrame([("abc",), ("DEF",), ("ghi",)], "code string")
    folded = spark.createDataFrame([("ABC",), ("def",)], "k string")
    assert membership_filter(cased, folded, [("code", "k")]).count() == 0
    assert membership_filter(cased, folded, [("code", "k")], case_insensitive=True).count() == 2


def test_membership_on_pairs_and_numbers(spark):
    main = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 2)], "a string, b long")
    ref = spark.createDataFrame([("x", "1"), ("y", "2")], "ka string, kb string")
    assert sorted(rows(membership_filter(main, ref, [("a", "ka"), ("b", "kb")]))) == [("x", 1), ("y", 2)]


def test_pivot_and_back(spark, quarters):
    wide = pivot_table(quarters, ["Country"], "Quarter", "Amount")
    assert sorted(rows(wide)) == [("DE", 30, 40), ("FR", 10, 20)] and wide.columns == ["Country", "Q1", "Q2"]
    long = unpivot_table(wide, ["Q1", "Q2"], "Quarter", "Amount")
    assert sorted(rows(long)) == sorted(rows(quarters))


def test_pivot_null_rules(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", None, 5), (None, "x", 6), ("b", "y", 7)], "k string, p string, v long")
    assert sorted(rows(pivot_table(df, ["k"], "p", "v"))) == [("a", 0, None), ("b", None, 7)]


def test_unpivot_mixed_types_is_text(spark):
    df = spark.createDataFrame([(1, 2, "z")], "id int, n int, s string")
    assert sorted(rows(unpivot_table(df, ["n", "s"]))) == [(1, "n", "2"), (1, "s", "z")]


def test_stack(spark, quarters):
    more = spark.createDataFrame([("IT", 5)], "Country string, Amount long")
    assert stack([quarters, more]).count() == 5
    with pytest.raises(ValueError):
        stack([quarters, more], by_name=False)
    assert stack([more, more], distinct=True).count() == 1
    missing = alignment_report([quarters, more]).where("not present").collect()
    assert [(r["column"], r["input"]) for r in missing] == [("Quarter", 2)]
