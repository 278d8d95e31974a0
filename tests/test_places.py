"""Places within a key and exact medians, also where one key holds all rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gristmill.operators.duplicates import duplicates
from gristmill.operators.grouped import with_group_columns
from gristmill.operators.places import BEFORE, PART, RUN_ROWS, in_order, medians, runs, with_place
from gristmill.operators.profiling import deep_page
from gristmill.operators.relational import aggregate

FUNCTIONS = [
    {"fn": "occurrence", "name": "nth"}, {"fn": "first", "column": "v", "name": "a"}, {"fn": "last", "column": "v", "name": "z"}, {"fn": "prev", "column": "v", "name": "p"},
    {"fn": "next", "column": "v", "name": "n"}, {"fn": "concat", "column": "t", "name": "c"}, {"fn": "group_size", "name": "size"}, {"fn": "median", "column": "v", "name": "m"},
]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    rows = [("hot" if i % 5 else None, r.choice([None, *range(40)]), r.choice(["x", "y", None]), r.randrange(300)) for i in range(2000)]
    rows += [("cold", i, "z", -i) for i in range(50)] + [("hot", 7, "x", 3)] * 200  # equal rows too
    return spark.createDataFrame(rows, "k string, v int, t string, o int").repartition(4)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("down", [False, True])
def test_run_by_run_equals_windows(table, keys, down):
    order = [("o", down), "v"]
    got = with_group_columns(table, keys, order, FUNCTIONS, hot_rows=300)
    want = with_group_columns(table, keys, order, FUNCTIONS, hot_rows=None)
    assert got.schema == want.schema or sorted(got.dtypes) == sorted(want.dtypes)
    assert rows_of(got) == rows_of(want)


def test_one_key_with_all_rows_is_shared_out(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 20_011).alias("o"), F.lit(1).alias("same"))
    rows = in_order(df, ["k"], [F.col("same").asc()])  # equal in the order, so dealt by their number
    sizes = [r["count"] for r in rows.groupBy(PART).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4
    table = runs(rows, ["k"])
    assert table.count() == 4 and sorted(r[BEFORE] + r[RUN_ROWS] for r in table.collect())[-1] == 20_000
    placed = with_place(df, ["k"], [F.col("o").asc()], "at", total="of").collect()
    assert [r["at"] for r in sorted(placed, key=lambda r: r["o"])] == list(range(20_000)) and {r["of"] for r in placed} == {20_000}


def test_extra_rows_of_a_hot_key(table):
    for keep in ("first", "last"):
        got = duplicates(table, ["k"], ["o"], keep=keep, dups_mode="extra", hot_rows=100)["dups"]
        want = duplicates(table, ["k"], ["o"], keep=keep, dups_mode="extra", hot_rows=None)["dups"]
        assert got.columns == table.columns and rows_of(got) == rows_of(want)


def test_medians_equal_the_built_in_one(spark):
    r = random.Random(9)
    values = {
        "few": [r.choice([None, 1.0, 2.0, float("nan")]) for _ in range(500)], "ties": [5.0] * 400 + [6.0] * 400, "odd": [r.gauss(0, 1e9) for _ in range(1001)],
        "one": [3.5], "none": [None, None], "ends": [float("-inf"), float("inf"), 1.0, 2.0], None: [r.random() for _ in range(900)],
    }
    df = spark.createDataFrame([(k, v, int(i)) for k, vs in values.items() for i, v in enumerate(vs)], "k string, v double, w long").repartition(5)
    got = {r["k"]: (str(r["a"]), str(r["b"])) for r in medians(df, ["k"], {"a": F.col("v"), "b": F.col("w")}).collect()}
    assert got == {r["k"]: (str(r["a"]), str(r["b"])) for r in df.groupBy("k").agg(F.median("v").alias("a"), F.median("w").alias("b")).collect()}
    assert got["odd"][0] == str(statistics.median(values["odd"])) and got["none"] == ("None", "0.5")
    assert [str(r["m"]) for r in medians(df, [], {"m": F.col("v")}).collect()] == [str(df.agg(F.median("v")).first()[0])]
    assert medians(df.where("false"), ["k"], {"m": F.col("v")}).count() == 0 and [r["m"] for r in medians(df.where("false"), [], {"m": F.col("v")}).collect()] == [None]


def test_a_median_looks_into_little(spark):
    """A hot key of all rows: only values near the middle are ordered, and no map of values is built."""
    df = spark.range(50_000).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 50_021).cast("double").alias("v"))
    out = aggregate(df, ["k"], [("MEDIAN", "v", "m"), ("COUNT", None, "n")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
    rows = out.collect()
    values = sorted(i * 7919 % 50_021 for i in range(50_000))
    assert [(r["k"], r["m"], r["n"]) for r in rows] == [(1, (values[24_999] + values[25_000]) / 2, 50_000)]


def test_having_on_a_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 10), ("b", None)], "k string, v int")
    assert [tuple(r) for r in aggregate(df, ["k"], [("COUNT", "v", "n")], having=[("AND", "MEDIAN", "v", ">", 5)]).collect()] == [("b", 1)]
    assert sorted(map(tuple, aggregate(df, ["k"], [("MEDIAN", "v", "m")]).collect())) == [("a", 2.0), ("b", 10.0)]


@pytest.mark.parametrize("order", [["o", "i"], [("o", True), ("i", True)], [("o", True), "i"], ["t", "i"], [("t", True), "i"]])
def test_deep_pages(spark, order):
    """Pages near the start, the middle and the end, with ties and nulls, found by narrowing."""
    r = random.Random(2)
    rows = [(i, r.choice([None, *range(30)]), r.choice([None, "a", "b", "c"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, o int, t string").repartition(3)
    columns = [c if isinstance(c, tuple) else (c, False) for c in order]
    want = list(rows)
    for name, down in reversed(columns):
        k = "iot".index(name)
        want.sort(key=lambda x: ((x[k] is not None) if not down else (x[k] is None), 0), reverse=not down)
        filled = sorted((x for x in want if x[k] is not None), key=lambda x: x[k], reverse=down)
        want = filled + [x for x in want if x[k] is None]
    for offset in (60, 1500, 2900, 2990, 5000):
        got = [tuple(x) for x in deep_page(df, order, 20, offset, deep=50, sample_rows=200).collect()]
        assert got == want[offset : offset + 20], (order, offset)


def test_sheets_are_filled(spark, tmp_path):
    from gristmill.sources.sinks import write_sheet_sized

    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("n"), F.lit("x").alias("same")).repartition(5)
    assert write_sheet_sized(df, str(tmp_path / "s"), rows=150, order_by=[("n", True)], sep=",", bom=False, eol="\n")
    files = sorted((tmp_path / "s").glob("part-*"))
    lines = [f.read_text().splitlines()[1:] for f in files]
    assert [len(x) for x in lines] == [150] * 6 + [100]
    assert [int(x.split(",")[0]) for part in lines for x in part] == list(range(999, -1, -1))
    assert not write_sheet_sized(df.where("false"), str(tmp_path / "none"), order_by=["n"]) and not (tmp_path / "none").exists()


def test_distinct_rows_with_clashing_hashes(spark):
    """Equal to the plain distinct whatever the hashes say, and unique rows pass no exchange."""
    from gristmill.operators.stacking import distinct_rows, row_hashes

    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, "a", "b", ""]), r.choice([0.0, -0.0, float("nan"), None])) for _ in range(300)] + [(i, "x" * 50, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, t string, d double").repartition(3)
    want = sorted(map(str, df.distinct().collect()))
    assert sorted(map(str, distinct_rows(df).collect())) == want and df.columns == distinct_rows(df).columns
    few = [F.pmod(h, F.lit(7)) for h in row_hashes(df)]
    assert sorted(map(str, distinct_rows(df, few).collect())) == want
    assert sorted(map(str, distinct_rows(df, most=0).collect())) == want
    assert distinct_rows(df.where("false")).count() == 0
    wide = spark.range(500).select("id", F.repeat(F.lit("long text "), 40).alias("text"))
    text = distinct_rows(wide)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 1 and text.count("LeftAnti") == 1  # at most that of the repeated rows


def test_merged_profiles(spark):
    """Parts profiled alone and merged, against one profile of all rows: empty parts, nulls and groups."""
    from gristmill.operators.profiling import merge_profiles, profile_sketches

    r = random.Random(8)
    rows = [(i % 7, r.choice([None, r.gauss(5, 2)]) if i % 7 != 3 else None, r.choice(["u", "v", None]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "part int, x double, t string, n long")
    merged = {c["column"]: c for c in merge_profiles(profile_sketches(df, ["part"])).collect()}
    whole = {c["column"]: c for c in merge_profiles(profile_sketches(df.drop("part"))).collect()}
    assert set(merged) == {"x", "t", "n"}
    for name, c in merged.items():
        w = whole[name]
        assert [c[k] for k in ("type", "rows", "nulls", "min_number", "max_number", "min_text", "max_text")] == [w[k] for k in ("type", "rows", "nulls", "min_number", "max_number", "min_text", "max_text")]
        assert abs(c["approx_distinct"] - w["approx_distinct"]) <= 0.05 * w["approx_distinct"]
    values = sorted(x for _, x, _, _ in rows if x is not None)
    assert abs(merged["x"]["avg"] - statistics.mean(values)) < 1e-9 and abs(merged["x"]["std"] - statistics.stdev(values)) < 1e-9
    for k, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(sum(v <= merged["x"][k] for v in values) / len(values) - q) < 0.01
    assert merged["t"]["q50"] is None and merged["t"]["avg"] is None
    per = {(c["part"], c["column"]): c for c in merge_profiles(profile_sketches(df, ["part"]), ["part"]).collect()}
    assert per[3, "x"]["q50"] is None and per[3, "x"]["nulls"] == per[3, "x"]["rows"] and len(per) == 21
    assert merge_profiles(profile_sketches(df.where("false"), ["part"])).count() == 0


def test_heavy_keys_leave_rare_ones_alone(spark):
    """Exact top keys, ties and null among them, while most rare keys are not counted; uniform keys are all counted."""
    from gristmill.operators.profiling import heavy_keys, key_groups, top_values

    r = random.Random(6)
    rows = [(r.choice([None, "a", "b", "c", "d"]) if r.random() < 0.5 else f"rare {r.randrange(3000)}",) for _ in range(6000)] + [("tie",), ("eit",)] * 40
    df = spark.createDataFrame(rows, "k string").repartition(3)
    full = df.groupBy("k").count()
    for n in (1, 3, 5, 6, 7):
        want = [tuple(x) for x in full.orderBy(F.desc("count"), F.asc_nulls_last("k")).limit(n).collect()]
        assert [tuple(x) for x in top_values(df, "k", n).collect()] == want
    assert heavy_keys(df, ["k"], 5).count() < full.count() / 4
    even = spark.range(500).select((F.col("id") % 50).alias("value"))
    assert heavy_keys(even, ["value"], 5).count() == 50 and [x["value"] for x in top_values(even, "value", 3).collect()] == [0, 1, 2]
    assert top_values(even, "value", 100).count() == 50 and top_values(even.where("false"), "value", 3).count() == 0
    assert {x["k"] for x in key_groups(df, ["k"], top=2, sample_rows=3, order_by=["k"]).collect()} == {x[0] for x in [tuple(y) for y in full.orderBy(F.desc("count"), "k").limit(2).collect()]}
