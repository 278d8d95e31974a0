"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import importable, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null read as empty."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on long ``keys`` so that adaptive execution may split a hot key.

    A side that was just grouped by the keys keeps their partitioning, and then
    neither side of the join can be split.  Joining on a hash of the keys makes
    both sides exchange, and the keys themselves are compared after the match.
    """
    a = left.withColumn("_spread", F.xxhash64(*keys))
    b = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys], F.xxhash64(*keys).alias("_spread_r"))
    on = F.col("_spread") == F.col("_spread_r")
    for k in keys:
        on = on & (F.col(k).bitwiseXOR(F.col(f"_r_{k}")) == 0)
    return a.join(b, on, how).drop("_spread", "_spread_r", *[f"_r_{k}" for k in keys])


def checked_broadcast(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows it is small, else as it is.  ``df`` should be materialised."""
    return F.broadcast(df) if df.count() <= most_rows else df


def whole_items(batches: Iterator[pa.RecordBatch], keys: Sequence[str], report: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Hand ``report`` one table after another that holds all rows of its keys; rows come sorted by ``keys``.

    The last keys of a batch may go on in the next one, so their rows are held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        last = [batch.column(k)[n - 1] for k in keys]
        first_of_last = 0
        if any(batch.column(k)[0] != x for k, x in zip(keys, last)):
            same = pc.equal(batch.column(keys[0]), last[0])
            for k, x in zip(keys[1:], last[1:]):
                same = pc.and_kleene(same, pc.equal(batch.column(k), x))
            first_of_last = n - pc.sum(same).as_py()
        if first_of_last:
            yield from report(pa.Table.from_batches([*held, batch.slice(0, first_of_last)]))
            held = [batch.slice(first_of_last)]
        elif held and any(held[0].column(k)[0] != x for k, x in zip(keys, last)):
            yield from report(pa.Table.from_batches(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield from report(pa.Table.from_batches(held))


def item_bounds(table: pa.Table, keys: Sequence[str]) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change).tolist()
    return list(zip(starts, [*starts[1:], table.num_rows]))
