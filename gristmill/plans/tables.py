"""Reading the given tables, and the register that a module of queries fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``t.orders`` reads orders.parquet of a folder, columns pruned and filters pushed by Spark."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def register(queries: dict, oracle: dict) -> Callable:
    """Decorator: ``@query(sql)`` registers a function of Tables under its name."""

    def query(sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query
