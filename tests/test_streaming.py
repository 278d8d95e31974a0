"""Row-level operators on a stream of files."""

from gristmill.functions import xl
from gristmill.functions.rules import mask
from gristmill.operators.cleaning import clean
from gristmill.operators.filtering import membership_filter
from gristmill.operators.routing import route


def test_row_operators_on_a_stream(spark, tmp_path):
    rows = [("  ab-1 ", 5), ("cd-2", 50), ("zz", 7), (None, 1)]
    spark.createDataFrame(rows, "code string, n long").write.parquet(str(tmp_path / "in"))
    ref = spark.createDataFrame([("ab-1",), ("cd-2",)], "k string")
    stream = spark.readStream.schema("code string, n long").parquet(str(tmp_path / "in"))
    assert stream.isStreaming
    out = clean(stream, [{"op": "trim", "column": "code"}])
    out = membership_filter(out, ref, [("code", "k")])
    out = out.withColumn("tail", xl.textafter(out["code"], "-")).withColumn("ok", mask(out, "code", [{"type": "letter", "length": 2}, {"type": "literal", "value": "-"}, {"type": "digit"}]))
    out = route(out, [{"id": "big", "match": {"groups": [{"rules": [{"column": "n", "test": "num_gt", "value": 10}]}]}}])
    query = out.writeStream.format("memory").queryName("routed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.table("routed").collect())
    assert got == [("ab-1", 5, "1", True, "else"), ("cd-2", 50, "2", True, "big")]


def test_routed_stream_in_one_pass(spark, tmp_path):
    from gristmill.operators.routing import route, route_counts
    from gristmill.streaming.routing import route_counts_over_time, write_routed_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    outputs = [{"id": "bought", "match": {"groups": [{"rules": [{"column": "event_type", "test": "equals", "value": "purchase"}]}]}}]
    stream = lambda: route(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), outputs)
    for _ in range(2):  # the second start finds nothing new
        write_routed_stream(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = {r["route"]: r["rows"] for r in route_counts(route(events, outputs)).collect()}
    assert {r["route"]: r["rows"] for r in route_counts(spark.read.parquet(str(tmp_path / "out"))).collect()} == want
    counts = route_counts_over_time(stream(), "ts", "1 day", "0 seconds").writeStream.format("memory").queryName("route_counts").outputMode("append")
    counts.option("checkpointLocation", str(tmp_path / "counts")).trigger(availableNow=True).start().awaitTermination()
    closed = {(r["start"], r["route"]): r["rows"] for r in spark.table("route_counts").collect()}
    every = {(r["start"], r["route"]): r["rows"] for r in route_counts_over_time(route(events, outputs), "ts", "1 day").collect()}
    assert closed and all(every[k] == n for k, n in closed.items())
