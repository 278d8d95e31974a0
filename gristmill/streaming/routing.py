"""Routed streams: outputs in one pass, and counts of routes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_routed_stream(routed: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a routed stream to a folder per route; without an interval what is there is written and the query ends.

    Files are committed with the checkpoint, so a restart neither loses nor
    repeats rows.
    """
    writer = routed.writeStream.format("parquet").partitionBy("route").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def route_counts_over_time(routed: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, route, rows)`` for each window of event time; rows later than ``late`` behind the newest are left out.

    On a stream the state is one row for each open window and route, and a
    window is given out once it is closed.
    """
    rows = routed.withWatermark(time_col, late)
    per = rows.groupBy(F.window(F.col(time_col), window).alias("w"), "route").agg(F.count(F.lit(1)).alias("rows"))
    return per.select(F.col("w.start").alias("start"), "route", "rows")
