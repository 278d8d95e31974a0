"""Writing results: delimited text for spreadsheets, sheet-sized files, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators.places import with_place
from gristmill.values import column, total_order

SHEET_ROWS, SHEET_COLUMNS = 1_048_576, 16_384


def plain_number(c: Column, decimal: str) -> Column:
    """A double without exponent and trailing zeros, with the given decimal sign."""
    s = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    s = F.coalesce(s, c.cast("string"))  # beyond 28 digits before the point
    return F.replace(s, F.lit("."), F.lit(decimal)) if decimal != "." else s


def write_delimited(
    df: DataFrame, path: str, sep: str = ";", decimal: str = ",", bom: bool = True, eol: str = "\r\n", enabled: bool = True, force: bool = False, mode: str = "errorifexists",
    rows_per_file: int | None = None,
) -> bool:
    """Write delimited text the way a French spreadsheet reads it; every setting can be overridden.

    Every part file has the header, with a byte-order mark if asked.  A disabled
    export is skipped unless forced, and an empty result writes nothing.
    Returns whether files were written.
    """
    if not enabled and not force or df.isEmpty():
        return False
    out = []
    for k, f in enumerate(df.schema.fields):
        c = column(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = plain_number(c, decimal)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.replace(c.cast("string"), F.lit("."), F.lit(decimal))
        out.append(c.alias(("\ufeff" if bom and k == 0 else "") + f.name))
    options = {"header": "true", "sep": sep, "lineSep": eol, "encoding": "UTF-8", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    if rows_per_file:
        options["maxRecordsPerFile"] = str(rows_per_file)
    df.select(*out).write.mode(mode).options(**options).csv(path)
    return True


def write_sheet_sized(df: DataFrame, path: str, rows: int = SHEET_ROWS - 1, order_by: Sequence[str | tuple[str, bool]] | None = None, **how) -> bool:
    """As ``write_delimited``, in files that each fit a sheet; too many columns is an error.

    With ``order_by`` n rows make exactly ceil(n / rows) files, all but the last
    one full, in that order over the files' names and within each: every row gets its place
    from range partitions and sums of their counts, and goes to the task that
    writes its file.  Without it every task cuts its own rows.
    """
    if len(df.columns) > SHEET_COLUMNS:
        raise ValueError(f"{len(df.columns)} columns do not fit a sheet of {SHEET_COLUMNS}")
    if order_by is None:
        return write_delimited(df, path, rows_per_file=rows, **how)
    if not how.get("enabled", True) and not how.get("force") or df.isEmpty():
        return False
    placed = with_place(df, [], total_order(df, order_by), "_sheet_row", total="_sheet_rows")
    files = -(-placed.select("_sheet_rows").first()[0] // rows)
    sheet = F.floor(F.col("_sheet_row") / rows).cast("int")
    dealt = placed.repartitionById(files, sheet).sortWithinPartitions("_sheet_row").drop("_sheet_row", "_sheet_rows")
    return write_delimited(dealt, path, **how)


def write_routed(routed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All outputs of a routing in one pass, a folder per route."""
    routed.write.mode(mode).partitionBy("route").parquet(path)
