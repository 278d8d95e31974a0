"""Delimited text in: dialect detection over many files, typed reading, skipped lines."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.operators.cleaning import apply_casts
from gristmill.operators.places import written
from gristmill.operators.stacking import stack
from gristmill.session import importable

HEAD_BYTES, HEADER_BYTES = 16 * 1024, 1 << 20
SEPARATORS = (";", ",", "\t", "|")


# --- heads -------------------------------------------------------------------


def read_head(uri: str, n: int) -> bytes:
    """The first ``n`` bytes of a file."""
    filesystem, place = pafs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(place) as f:
        return f.read(n)


def file_heads(spark: SparkSession, path: str | list[str], n: int = HEAD_BYTES) -> DataFrame:
    """``(path, head)``: the first bytes of every file, read by range, so that no file is loaded whole."""
    importable(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "head": [read_head(p, n) for p in batch["path"]]})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "path string, head binary")


# --- dialects ----------------------------------------------------------------


def detect_encoding(head: bytes) -> str:
    """utf-8 (with or without mark), utf-16, else a single-byte western encoding."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for cut in range(4):  # the head may end inside a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    # bytes 0x80-0x9f are letters and signs in cp1252 and control characters in the ISO encodings
    if any(0x80 <= b <= 0x9F for b in head):
        return "cp1252"
    return "iso8859-15" if b"\xa4" in head else "cp1252"


def detect_separator(lines: Sequence[str], extension: str = ".csv") -> str:
    """The separator with the steadiest count per line; tab for .tsv and .txt."""
    if extension in (".tsv", ".txt"):
        return "\t"
    best, score = ",", 0.0
    for sep in SEPARATORS:
        counts = [line.count(sep) for line in lines if line.strip()]
        if not counts or not max(counts):
            continue
        usual = max(set(counts), key=lambda n: (counts.count(n), n))
        steady = counts.count(usual) / len(counts) if usual else 0.0
        got = 10 * steady + min(usual, 9) / 10
        if usual and got > score:
            best, score = sep, got
    return best


def detect_decimal(lines: Sequence[str], separator: str) -> str:
    """Comma or point, from how numbers look in the data lines: at least two, and more than twice the other."""
    commas = points = 0
    for row in csv.reader(io.StringIO("\n".join(lines[1:51])), delimiter=separator):
        for cell in row:
            commas += bool(re.fullmatch(r"\s*[+-]?[\d\s. ]*\d,\d+\s*", cell))
            points += bool(re.fullmatch(r"\s*[+-]?\d+\.\d+\s*", cell))
    return "," if commas >= 2 and commas > 2 * points else "."


def csv_dialects(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, encoding, sep, decimal, found from the first 16 KB of each.

    Spark hands each file to a task, which reads its head only.
    """
    files = file_heads(spark, path)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, head in zip(batch["path"], batch["head"]):
                encoding = detect_encoding(bytes(head))
                lines = bytes(head).decode(encoding, "ignore").splitlines()
                lines = lines[:-1] if len(head) == HEAD_BYTES and len(lines) > 1 else lines
                extension = "." + name.rsplit(".", 1)[-1].lower()
                sep = detect_separator(lines, extension)
                rows.append((name, encoding, sep, detect_decimal(lines, sep)))
            yield pd.DataFrame(rows, columns=["path", "encoding", "sep", "decimal"])

    return files.mapInPandas(look, "path string, encoding string, sep string, decimal string")


#: Python names of encodings and what the Spark reader calls them (fixed values).
JAVA_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf-16": "UTF-16", "cp1252": "windows-1252", "latin-1": "ISO-8859-1", "iso8859-15": "ISO-8859-15"}


# --- reading -----------------------------------------------------------------


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "utf-8", header_row: int = 0, casts: Sequence[dict[str, Any]] = (),
    decimal: str = ".", thousands: str | None = None, multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Read delimited files as text columns, then cast; returns the rows and the cast report.

    ``header_row`` lines before the header of each file are skipped.  With it or
    with ``multi_line`` quoted line breaks are kept, and files are read in
    splits all the same (see ``records``); this counts quotes in a job first.
    Encodings other than UTF and Latin-1 need ``spark.sql.legacy.javaCharsets``.
    """
    charset = JAVA_NAMES.get(encoding, encoding)
    if header_row or multi_line:
        df = _parsed_records(spark, path, header_row, sep, charset)
    else:
        options = {"sep": sep, "header": "true", "encoding": charset, "inferSchema": "false", "quote": '"', "escape": '"', "enforceSchema": "false"}
        df = spark.read.options(**options).csv(path)
    df = df.select(*[F.col(f"`{n}`").alias(n.removeprefix("\ufeff")) for n in df.columns])
    return apply_casts(df, casts, decimal, thousands)


def _headers(spark: SparkSession, path: str | list[str], lines: int, sep: str, charset: str) -> DataFrame:
    """``(path, header, taken, odd)`` of every file: the names in its header, the lines up to and with it, and how many of those have an odd number of quotes.

    The heads are the only part of the files that Python reads.
    """
    python = {v: k for k, v in JAVA_NAMES.items()}.get(charset, charset)
    python = "utf-8-sig" if python == "utf-8" else python

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, head in zip(batch["path"], batch["head"]):
                found = bytes(head).decode(python, "ignore").split("\n")
                if len(found) <= lines or not "".join(found[lines:]).strip():
                    rows.append((path, None, 0, 0))
                    continue
                reader = csv.reader((x + "\n" for x in found[lines:]), delimiter=sep)
                names = next(reader)
                taken = lines + reader.line_num  # a quoted name may have a line break too
                rows.append((path, [n.strip("\r\n") for n in names], taken, sum(x.count('"') % 2 for x in found[:taken])))
            yield pd.DataFrame(rows, columns=["path", "header", "taken", "odd"])

    return file_heads(spark, path, HEADER_BYTES).mapInPandas(run, "path string, header array<string>, taken long, odd long")


def quotes_before(lines: DataFrame) -> DataFrame:
    """``lines`` with ``seen``: how many lines with an odd number of quotes the task that reads them has read before.

    Rows are numbered once as lines and once with such a line standing for two
    rows; the difference of the numbers is the sum, found without moving a line.
    """
    twice = lines.withColumn("at", F.monotonically_increasing_id()).select("*", F.explode(F.sequence(F.lit(0), F.col("odd"))).alias("nth"))
    return twice.withColumn("seen", F.monotonically_increasing_id() - F.col("at")).where("nth = 0").drop("nth")


def records(lines: DataFrame) -> DataFrame:
    """``value``: the records that lines make up, a quoted line break not ending one.

    ``lines`` is ``(file, start, at, value, odd, before)``: the file's number, the
    block a line is read in, its number there, whether it has an odd number of quotes,
    and how many lines of its file before it have.  A line that begins outside quotes and has an
    even number is a record as it is.  The others are pieces of a record of
    several lines; those of one record, and no other ones, have the same half
    of ``before``, also over blocks, and only they are gathered.
    """
    piece = (F.col("before") % 2 == 1) | (F.col("odd") == 1)
    pieces = lines.where(piece).select("file", F.shiftright("before", 1).alias("record"), F.struct("start", "at", "value").alias("piece"))
    whole = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list("piece")).alias("of"))
    return lines.where(~piece).select("value").unionByName(whole.select(F.array_join(F.col("of.value"), "\n").alias("value")))


def _parsed_records(spark: SparkSession, path: str | list[str], header_row: int, sep: str, charset: str) -> DataFrame:
    """Drop the leading lines and the header of each file, then parse the rest; all files must have one header.

    Lines are read in splits by the text reader.  One job counts, for each
    split, its lines with an odd number of quotes and the number of its first line; sums over
    the splits of a file tell how many such lines come before each split.
    """
    heads = written(_headers(spark, path, header_row, sep, charset).withColumn("number", F.monotonically_increasing_id()))
    found = heads.groupBy("header").agg(F.min("path").alias("path")).limit(3).collect()
    if not found:
        raise ValueError("no file to read")
    short = [r["path"] for r in found if r["header"] is None]
    if short:
        raise ValueError(f"{short[0]} has no line after {header_row} skipped ones")
    if len(found) > 1:
        raise ValueError(f"the headers of {found[0]['path']} and {found[1]['path']} differ")
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in found[0]["header"])

    text = spark.read.options(encoding=charset, lineSep="\n").text(path)
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2))
    lines = quotes_before(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value", odd.alias("odd")))
    stats = lines.groupBy("path", "start").agg(F.min("at").alias("first"), F.min("seen").alias("seen_first"), F.sum("odd").alias("odds"))
    stats = stats.join(F.broadcast(heads.select(F.col("path").alias("head_of"), F.col("number").alias("file"), "taken", F.col("odd").alias("head_odds"))), F.col("path") == F.col("head_of"), "left")  # as many rows as files
    begins = F.col("start") == 0
    upto = F.coalesce(F.sum("odds").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # quotes of the leading lines and the header open nothing
    of_head = F.coalesce(F.max(F.when(begins, F.col("head_odds"))).over(W.partitionBy("path")), F.lit(0))
    blocks = written(stats.select("path", "start", "file", "first", F.when(begins, F.col("taken")).otherwise(0).alias("skip"), (upto - of_head - F.col("seen_first")).alias("base")))
    if not blocks.where("file is null").isEmpty():
        raise ValueError("a file of the input has no head")
    body = lines.join(F.broadcast(blocks), ["path", "start"]).where(F.col("at") - F.col("first") >= F.col("skip"))  # as many rows as input splits
    rows = records(body.select("file", "start", "at", "value", "odd", (F.col("seen") + F.col("base")).alias("before")))
    value = F.regexp_replace("value", "\r$", "")
    parsed = F.from_csv(value, schema, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return rows.where(F.trim(F.translate("value", "\r", "")) != "").select(parsed.alias("r")).select("r.*")


def read_mixed(spark: SparkSession, path: str, casts: Sequence[dict[str, Any]] = (), thousands: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Read files of different dialects: one reader per dialect, stacked by name.

    The list of files and dialects comes to the driver, as any Spark file
    listing does; the files themselves do not.
    """
    groups: dict[tuple[str, str, str], list[str]] = {}
    for r in csv_dialects(spark, path).collect():
        groups.setdefault((r["encoding"], r["sep"], r["decimal"]), []).append(r["path"])
    if not groups:
        raise ValueError("no file to read")
    parts = [read_delimited(spark, files, sep, encoding, casts=casts, decimal=decimal, thousands=thousands) for (encoding, sep, decimal), files in sorted(groups.items())]
    report = stack([p[1] for p in parts]).groupBy("column", "type").agg(F.sum("failed").alias("failed"))
    return stack([p[0] for p in parts]), report


def peek(df: DataFrame, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """A sample of rows, and ``(column, type)`` with coarse types."""
    coarse = {"string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "DOUBLE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    kinds = [(name, coarse.get(t, "BIGINT" if t in ("bigint", "int", "smallint", "tinyint") else "DOUBLE" if t.startswith("decimal") else "VARCHAR")) for name, t in df.dtypes]
    return df.limit(n), df.sparkSession.createDataFrame(kinds, "column string, type string")
