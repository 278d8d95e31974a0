"""Cleaning, casts, spreadsheet functions, group columns and profiles on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions import xl
from gristmill.operators.cleaning import apply_casts, clean, clean_report, java_format
from gristmill.operators.grouped import apply_group_functions, value_when, with_group_columns
from gristmill.operators.profiling import breakdown, column_profile, example_values, histogram, key_analysis, key_consistency, key_distribution, key_groups, key_rows, preview, report, summarize


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(1, "  alice ", "10.5", "Paris"), (2, "BOB", "abc", None), (3, "Carol  ", "30", "Lyon")], "o int, Name string, Price string, City string")


STEPS = [
    {"op": "trim", "column": "Name"}, {"op": "capitalize", "column": "Name"}, {"op": "to_number", "column": "Price"},
    {"op": "fillna", "column": "City", "value": "?"}, {"op": "upper", "column": "Nowhere"}, {"op": "upper", "column": "Name", "enabled": False},
]


def test_clean(messy):
    got = [tuple(r) for r in clean(messy, STEPS).orderBy("o").collect()]
    assert got == [(1, "Alice", 10.5, "Paris"), (2, "Bob", None, "?"), (3, "Carol", 30.0, "Lyon")]


def test_clean_report(messy):
    got = {r["step"]: r for r in clean_report(messy, STEPS, order_by=["o"]).collect()}
    assert got[2]["failed"] == 1 and got[3]["was_null"] == 1 and got[0]["changed"] == 2 and set(got) == {0, 1, 2, 3}
    assert [tuple(s) for s in got[0]["samples"]] == [("  alice ", "alice"), ("Carol  ", "Carol")]
    assert clean_report(messy, []).count() == 0


def test_rounding_and_numbers(spark):
    df = spark.createDataFrame([("2,5", 2.345), ("1d", -1.5), (" 7 ", 2.5)], "s string, x double")
    out = clean(df, [{"op": "to_integer", "column": "s"}, {"op": "round", "column": "x", "digits": 0}])
    assert [tuple(r) for r in out.collect()] == [(2, 2.0), (None, -2.0), (7, 2.0)]
    assert clean(df, [{"op": "round", "column": "x", "digits": 2}]).first()["x"] == pytest.approx(2.35)


def test_trim_unicode_and_replace(spark):
    df = spark.createDataFrame([("\u00a0\t a$b \u00a0",)], "s string")
    assert clean(df, [{"op": "trim", "column": "s"}]).first()[0] == "a$b"
    assert clean(df, [{"op": "trim", "column": "s"}, {"op": "replace", "column": "s", "find": r"(a)\$(b)", "replace": r"\2$\1", "regex": True}]).first()[0] == "b$a"


def test_casts(spark):
    df = spark.createDataFrame([("12,5", "05/03/2024", "oui"), ("7,3", "12/01/2024", "VRAI"), ("abc", "x", "peut-être"), ("1 200,5", None, "non")], "p string, d string, b string")
    out, rep = apply_casts(df, [{"column": "p", "type": "number"}, {"column": "d", "type": "date", "format": "%d/%m/%Y"}, {"column": "b", "type": "boolean"}, {"column": "zz", "type": "text"}], decimal=",", thousands=" ")
    assert out.agg(F.sum("p")).first()[0] == pytest.approx(12.5 + 7.3 + 1200.5)
    assert {r["column"]: r["failed"] for r in rep.collect()} == {"p": 1, "d": 1, "b": 1}
    assert [r["b"] for r in out.collect()] == [True, True, None, False]
    assert str(out.first()["d"]) == "2024-03-05 00:00:00"
    assert java_format("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_text_functions(spark):
    cases = [
        (xl.textafter("C:\\Users\\me\\rapport final.xlsx", "\\", -1), "rapport final.xlsx"), (xl.textbefore(xl.textafter("/var/log/out.csv", "/", -1), "."), "out"),
        (xl.textbefore("a-b-c", "-", 2), "a-b"), (xl.textafter("a-b-c", "-", -2), "b-c"), (xl.textbefore("abc", "-"), "abc"), (xl.textbefore("abc", "-", -1), ""), (xl.textafter("abc", "-", -1), "abc"),
        (xl.left("abc", -1), "ab"), (xl.left("abc", -9), ""), (xl.right("abc", -1), "bc"), (xl.right("abc", 2), "bc"), (xl.mid("abc", 0, 2), "a"), (xl.mid("abc", 2, 5), "bc"),
        (xl.find("X", "aXbXc"), 2), (xl.find("q", "aXbXc"), None), (xl.find("X", "aXbXc", 3), 4), (xl.search("x", "aXbXc"), 2), (xl.replace("abcdef", 1, 3, "XXX"), "XXXdef"),
        (xl.regexreplace("a1b2", "[0-9]", "#"), "a#b#"), (xl.regexextract("AB-12-XY", "-([0-9]+)-", 1), "12"), (xl.regexextract("zz", "[0-9]"), ""), (xl.rept("ab", 3), "ababab"),
        (xl.concat("a", F.lit(None).cast("string"), "b"), "ab"), (xl.concat_values("a", F.lit(None).cast("string")), None), (xl.substitute("a.b", ".", "-"), "a-b"), (xl.trim("\t a "), "\t a"),
    ]
    for c, want in cases:
        assert one(spark, c) == want


def test_number_functions(spark):
    cases = [
        (xl.round_(1.005, 2), 1.0), (xl.round_(2.5), 3.0), (xl.round_(-2.5), -3.0), (xl.round_(1234.0, -2), 1200.0), (xl.divide(1, 0), None), (xl.divide(1, 4), 0.25), (xl.mod(-7, 3), -1), (xl.mod(7, 0), None),
        (xl.min_(F.lit(None).cast("int"), 3, 2), 2), (xl.max_(4), 4), (xl.value("1d"), None), (xl.value(" 1e3 "), 1000.0), (xl.isblank(""), True), (xl.if_(F.lit(False), 1), None), (xl.len_("été"), 3),
        (xl.condition(F.lit("abc"), "contains", "b", 1, 0), 1), (xl.math(7, "/", 3, 2), 2.33), (xl.extract("a:b", "before", ":"), "a"), (xl.combine(["a", 1], "-"), "a-1"), (xl.transform(" A ", "trim"), "A"),
    ]
    for c, want in cases:
        assert one(spark, c) == want
    assert one(spark, xl.today()) is not None


@pytest.fixture(scope="module")
def docs9(spark):
    data = [("A", "ref", "v1", 10, 2), ("A", "x", "v2", 20, 1), ("A", "x", "v3", 30, 3), ("B", "x", "v4", 40, 1), ("B", "ref", "v5", 50, 2), ("C", "x", "v6", 60, 1), ("C", "x", "v7", 70, 2), ("C", "x", "v8", 80, 3), ("D", "ref", "v9", 90, 1)]
    return spark.createDataFrame(data, "doc string, type string, val string, n long, ord long")


def when(docs9, value, source, reducer, **how):
    cond = {"groups": [{"rules": [{"column": "type", "test": "equals", "value": value}]}]}
    got = value_when(docs9, ["doc"], "got", cond, source, reducer, order_by=["ord"], **how)
    return [r["got"] for r in got.groupBy("doc").agg(F.first("got").alias("got")).orderBy("doc").collect()]


def test_value_when(docs9):
    assert when(docs9, "ref", "val", "first") == ["v1", "v5", None, "v9"]
    assert when(docs9, "ref", "val", "first", fallback="-") == ["v1", "v5", "-", "v9"]
    assert when(docs9, "REF", "val", "first") == [None] * 4
    assert when(docs9, "x", "val", "first") == ["v2", "v4", "v6", None]
    assert when(docs9, "x", "val", "last") == ["v3", "v4", "v8", None]
    assert when(docs9, "x", "n", "sum") == [50, 40, 210, None]
    assert when(docs9, "x", "n", "min") == [20, 40, 60, None] and when(docs9, "x", "n", "max") == [30, 40, 80, None]
    assert when(docs9, "x", "n", "avg") == [25, 40, 70, None]
    assert when(docs9, "x", "val", "concat") == ["v2, v3", "v4", "v6, v7, v8", None]
    assert when(docs9, "ref", F.concat("val", F.lit("="), "n"), "first") == ["v1=10", "v5=50", None, "v9=90"]


def test_group_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), (None, 1, 0.0), (None, 2, 0.0)], "k string, o int, v double")
    fns = [{"fn": f, "column": "v", "name": f} for f in ("count_distinct", "is_duplicate", "sum", "median", "share", "first", "last", "prev", "next", "concat")] + [{"fn": "occurrence"}, {"fn": "group_size"}]
    got = {(r["k"], r["o"]): r for r in with_group_columns(df, ["k"], ["o"], fns).collect()}
    r = got[("a", 2)]
    assert (r["count_distinct"], r["sum"], r["median"], r["share"], r["first"], r["last"], r["prev"], r["next"], r["concat"], r["occurrence"], r["group_size"]) == (2, 8.0, 4.0, None, 2.0, 6.0, 2.0, 6.0, "2.0, 6.0", 2, 3)
    r = got[(None, 1)]
    assert (r["count_distinct"], r["is_duplicate"], r["share"]) == (1, "oui", None)
    replaced = with_group_columns(df, ["k"], None, [{"fn": "sum", "column": "v", "name": "v"}])
    assert replaced.columns == ["k", "o", "v"] and replaced.where("k = 'a'").first()["v"] == 8.0
    with pytest.raises(ValueError):
        with_group_columns(df, ["k"], None, [{"fn": "prev", "column": "v"}])
    both = apply_group_functions(df, ["k"], ["o"], [{"fn": "occurrence", "name": "i"}], [{"name": "w", "condition": {"groups": [{"rules": [{"column": "i", "test": "num_eq", "value": 3}]}]}, "source": "v"}])
    assert {r["w"] for r in both.where("k = 'a'").collect()} == {6.0}


@pytest.fixture(scope="module")
def keys6(spark):
    data = [(1, "Alice", "Paris"), (1, "Alice", "Paris"), (1, "Alice", "Lyon"), (2, "Bob", "Nice"), (2, "Bob", "Nice"), (3, "Carol", "Lille")]
    return spark.createDataFrame(data, "client_id long, name string, city string")


def test_keys(keys6):
    r = key_analysis(keys6, ["client_id"]).first()
    assert (r["distinct_keys"], r["dup_keys"], r["singletons"], r["rows_in_dups"], r["group_max"], r["unique"], r["group_median"]) == (3, 2, 1, 5, 3, False, 2.0)
    got = {r["column"]: r for r in key_consistency(keys6, ["client_id"], batch=1).collect()}
    assert got["name"]["constant"] and got["city"]["varying_groups"] == 1 and '"client_id":1' in got["city"]["example_key"]
    assert {r[0] for r in example_values(keys6, ["client_id"], [1], "city").collect()} == {"Paris", "Lyon"}
    assert key_rows(keys6, ["client_id"], "2").count() == 2
    assert {r["size"]: r["keys"] for r in key_distribution(keys6, ["client_id"]).collect()} == {"1": 1, "2": 1, "3": 1}
    assert key_groups(keys6, ["client_id"], top=1).count() == 3 and key_groups(keys6, ["client_id"], top=1, sample_rows=2).count() == 2
    empty = key_analysis(keys6.where("false"), ["client_id"]).first()
    assert (empty["total"], empty["unique"], empty["uniqueness_pct"]) == (0, False, 0.0)


def test_profiles(spark):
    df = spark.createDataFrame([("FR", 10), ("FR", 20), ("DE", 30), ("DE", 40), ("", None)], "Country string, Amount long")
    p = column_profile(df, "Amount")
    r = p["stats"].first()
    assert (r["total"], r["nulls"], r["distinct"], r["min"], r["median"], r["null_pct"]) == (5, 1, 4, 10, 25.0, 20.0)
    assert [b["count"] for b in p["histogram"].orderBy("bin").collect()] == [1, 0, 0, 1, 0, 0, 1, 0, 0, 1]
    assert "histogram" not in column_profile(df, "Country")
    same = histogram(spark.createDataFrame([(5,), (5,)], "x int"), "x").collect()
    assert [(b["lo"], b["hi"], b["count"]) for b in same] == [(5.0, 5.0, 2)]
    assert histogram(df.where("false"), "Amount").count() == 0
    got = [(r["key"], r["count"], r["other"]) for r in breakdown(df, "Country", top=2).collect()]
    assert got == [("DE", 2, 1), ("FR", 2, 1)]
    assert ("(vide)", 1) in [(r["key"], r["count"]) for r in breakdown(df, "Country").collect()]
    assert summarize(df).count() == 2
    assert set(report(df)) == {"values: Country", "values: Amount"}
    page, counts = preview(df, [{"column": "Country", "op": "equals", "value": "FR"}])
    assert page.count() == 2 and tuple(counts.first()) == (2, 5)
    assert preview(df, sort="Amount", descending=True)[0].first()["Amount"] == 40
    assert preview(df, q="de")[0].count() == 2
    assert preview(df, [{"column": "Amount", "op": "equals", "value": "abc"}])[0].count() == 0
    assert preview(df, [{"column": "Amount", "op": "is_null"}])[0].count() == 1


def test_breakdown_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x string")
    assert [tuple(r) for r in breakdown(df, "x").collect()] == [(None, 0, 0.0, 0, 0, 2, 2)]


def test_pivot_of_too_many_values(spark):
    from gristmill.operators.reshape import pivot_values

    df = spark.range(12).selectExpr("cast(id as string) as v")
    assert len(pivot_values(df, "v", 12)) == 12
    with pytest.raises(ValueError):
        pivot_values(df, "v", 11)


def test_consistency_shows_example_values(spark):
    df = spark.createDataFrame([(k, v, "same") for k in (1, 2) for v in "hgfedcba"], "k int, v string, w string")
    got = {r["column"]: (r["example_key"], r["example_values"]) for r in key_consistency(df, ["k"]).collect()}
    assert got == {"v": ('{"k":1}', list("abcdef")), "w": (None, [])}
