"""What the plans look like: what reaches the scan, and how often rows are exchanged."""

from pyspark.sql import functions as F

from gristmill.operators.checks import group_verdicts
from gristmill.operators.duplicates import duplicates
from gristmill.operators.filtering import membership_filter
from gristmill.operators.grouped import with_group_columns
from gristmill.operators.profiling import key_consistency

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_rows_are_cut_before_the_exchange(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source", "lang")
    kept = plan(duplicates(docs, ["source"], ["doc_id"])["kept"])
    assert kept.count("Exchange") == 1 and "WindowGroupLimit" in kept and "SortAggregate" not in kept
    every = plan(duplicates(docs, ["source"], ["doc_id"])["dups"])
    assert "rangepartitioning" not in every
    assert "rangepartitioning" in plan(duplicates(docs, ["source"], ["doc_id"], sort=True)["dups"])


def test_whole_number_keys_are_compared_as_they_are(spark):
    orders, customers = spark.read.parquet(f"{DIR}/orders.parquet"), spark.read.parquet(f"{DIR}/customer.parquet")
    rich = customers.where("c_acctbal > 5000")
    got = plan(membership_filter(orders, rich, [("o_custkey", "c_custkey")]))
    assert "cast(o_custkey" not in got
    mixed = membership_filter(orders, rich.select(F.col("c_custkey").cast("string").alias("c_custkey")), [("o_custkey", "c_custkey")])
    assert mixed.count() == orders.join(rich, orders["o_custkey"] == rich["c_custkey"], "left_semi").count()


def test_constant_needs_no_distinct_count(spark):
    orders = spark.read.parquet(f"{DIR}/orders.parquet").select("o_custkey", "o_orderstatus")
    checks = {"same": [{"check": "constant", "column": "o_orderstatus"}], "one": [{"check": "distinct_max", "column": "o_orderstatus", "n": 1}]}
    out = group_verdicts(orders, ["o_custkey"], checks)
    assert "Expand" not in plan(out) and out.where("same <> one").count() == 0


def test_many_distinct_counts_are_one_plan(spark):
    """Twenty distinct checks: no copy of the rows for each, and one pair of exchanges beside that of the other aggregates."""
    df = spark.createDataFrame([(g, v, w) for g in (None, "a", "b") for v, w in ((1, 1), (1, 2), (2, 2))], "g string, v int, w int")
    checks = {f"c{n}": [{"check": "distinct_eq", "column": "v" if n % 2 else "w", "n": n % 3 + 1}] for n in range(20)}
    out = group_verdicts(df, ["g"], checks)
    text = plan(out)
    assert "Expand" not in text and "SortAggregate" not in text and text.count("Exchange hashpartitioning(_g0") <= 4
    rows = out.collect()
    assert len(rows) == 9 and all(r[f"c{n}"] == (n % 3 == 1) for r in rows for n in range(20))
    whole = group_verdicts(df, [], checks).collect()
    assert len(whole) == 9 and all(r[f"c{n}"] == (n % 3 == 1) for r in whole for n in range(20))


def test_text_ends_are_hashed(spark):
    """Whether text is constant or varies needs numbers only, so nothing is sorted."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("source", "lang", "text")
    assert "SortAggregate" not in plan(group_verdicts(docs, ["source"], {"one": [{"check": "constant", "column": "lang"}]}))
    got = {r["column"]: r for r in key_consistency(docs, ["source"]).collect()}
    per = docs.groupBy("source").agg(F.count_distinct(F.coalesce("lang", F.lit("?"))).alias("n"))
    assert got["lang"]["varying_groups"] == per.where("n > 1").count()


def test_first_and_last_use_the_window_that_is_there(spark):
    orders = spark.read.parquet(f"{DIR}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    both = [{"fn": "occurrence", "name": "n"}, {"fn": "first", "column": "o_totalprice", "name": "a"}, {"fn": "prev", "column": "o_totalprice", "name": "p"}]
    text = plan(with_group_columns(orders, ["o_custkey"], ["o_orderkey"], both))
    assert text.count("Scan parquet") == 1 and "SortAggregate" not in text and "Join" not in text


def test_kept_rows_beside_a_map_column(spark):
    df = spark.createDataFrame([(1, 2, {"a": 1}), (1, 3, {"b": 2}), (2, 1, {"c": 3})], "k int, n int, m map<string,int>")
    for keep, want in (("first", [(1, 2), (2, 1)]), ("last", [(1, 3), (2, 1)])):
        kept = duplicates(df, ["k"], ["n"], keep=keep)["kept"]
        assert sorted((r["k"], r["n"]) for r in kept.collect()) == want
