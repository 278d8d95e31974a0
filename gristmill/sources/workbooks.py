"""Folders of spreadsheet workbooks as one Spark job.

A workbook is read by one task at a time (it is a zip of XML files and has no
splits); many workbooks are read side by side.  A task finds a book's entries
from the zip's directory at its end and reads the sheet's entry as a stream, so
no book is loaded whole; what it keeps are the shared texts.  Cells come out as
long rows with their type, so that a column of mixed types can be reported and
kept as text; the grid of rows and columns is then laid out again by position.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.session import importable

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates (fixed values).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
CELLS = "file string, row int, col int, value string, cell_type string"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _elements(book: zipfile.ZipFile, entry: str, tag: str) -> Iterator[ET.Element]:
    """Elements of one kind of an entry, read as a stream; each is dropped from the tree when the next one is asked for."""
    with book.open(entry) as f:
        path: list[ET.Element] = []
        for event, e in ET.iterparse(f, events=("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if e.tag == f"{MAIN}{tag}":
                yield e
                path[-1].clear()


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in _elements(book, "xl/sharedStrings.xml", "si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""), re.I)}
    xfs = root.find(f"{MAIN}cellXfs")
    return {k for k, xf in enumerate(xfs if xfs is not None else ()) if int(xf.get("numFmtId") or 0) in DATE_FORMATS | own}


def _sheet_file(book: zipfile.ZipFile, sheet: str | None) -> str:
    sheets = list(ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"))
    chosen = next((s for s in sheets if s.get("name") == sheet), sheets[0])
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[chosen.get(LINK)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_cells(file: BinaryIO, sheet: str | None = None) -> Iterator[tuple[int, int, str, str]]:
    """``(row, col, value, type)`` of the filled cells of a sheet, by name or else the first; types texte, nombre, booléen, date."""
    with zipfile.ZipFile(file) as book:
        texts, dates = _texts(book), _date_styles(book)
        at = -1
        for row in _elements(book, _sheet_file(book, sheet), "row"):
            at = int(row.get("r")) - 1 if row.get("r") else at + 1
            col = -1
            for cell in row.findall(f"{MAIN}c"):
                col = _column(cell.get("r")) if cell.get("r") else col + 1
                kind, v = cell.get("t") or "n", cell.find(f"{MAIN}v")
                if kind == "inlineStr":
                    value, name = "".join(t.text or "" for t in cell.iter(f"{MAIN}t")), "texte"
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    value, name = texts[int(v.text)], "texte"
                elif kind == "b":
                    value, name = ("true" if v.text == "1" else "false"), "booléen"
                elif kind in ("str", "e", "d"):
                    value, name = v.text, "texte"
                elif int(cell.get("s") or 0) in dates:
                    value, name = str(pd.Timestamp("1899-12-30") + pd.Timedelta(days=float(v.text))), "date"
                else:
                    number = float(v.text)
                    value, name = (str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)), "nombre"
                if value != "":
                    yield at, col, value, name


def read_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Cells of every workbook under ``path`` as long rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                filesystem, place = pafs.FileSystem.from_uri(name)
                with filesystem.open_input_file(place) as f:
                    cells = ((name, *c) for c in sheet_cells(f, sheet))
                    while part := list(islice(cells, 20_000)):
                        yield pd.DataFrame(part, columns=["file", "row", "col", "value", "cell_type"])

    importable(spark)
    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, CELLS)


def cell_type_report(cells: DataFrame, header_row: int = 0) -> DataFrame:
    """Per file and column: cells of each type, and whether types are mixed (such a column stays text)."""
    body = cells.where(F.col("row") > header_row)
    kinds = ("texte", "nombre", "booléen", "date")
    out = body.groupBy("file", "col").agg(*[F.count_if(F.col("cell_type") == k).alias(k) for k in kinds])
    return out.withColumn("mixed", sum((F.col(k) > 0).cast("int") for k in kinds) > 1)


def _unused(name: str, used: set[str]) -> str:
    """``name``, or the first of ``name_2``, ``name_3``, … that is not taken in any case."""
    k, got = 1, name
    while got.lower() in used:
        k += 1
        got = f"{name}_{k}"
    used.add(got.lower())
    return got


#: How the text of a cell becomes a column of its type.
CASTS = {"nombre": lambda c: c.try_cast("double"), "booléen": lambda c: c == "true", "date": lambda c: c.try_cast("timestamp_ntz"), "texte": lambda c: c}


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 0) -> DataFrame:
    """One row per data row of every workbook, with ``file`` and ``row``, blank rows between filled ones included.

    Every header cell is a column, filled or not, and so is every column of
    cells without one, as ``col_i`` with i from 0.  Workbooks share columns by
    header, and by its number where one has the same header several times.  A
    name that is taken, in whatever case, by a column before, by ``file`` or by
    ``row`` gets the first free ``_2``, ``_3``, …; headers that come once are
    named before those that repeat.  A column whose cells have one type in all
    files is cast to it, any other stays text.
    """
    cells = read_cells(spark, path, sheet)
    body = cells.where(F.col("row") > header_row)
    heads = cells.where(F.col("row") == header_row).select("file", "col", F.trim("value").alias("name"))
    width = cells.where(F.col("row") >= header_row).groupBy("file").agg(F.max("col").alias("last"), F.max(F.when(F.col("row") > header_row, F.col("row"))).alias("bottom"))
    columns = width.select("file", F.explode(F.sequence(F.lit(0), "last")).alias("col")).join(heads, ["file", "col"], "left")
    columns = columns.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("col_"), F.col("col").cast("string"))))
    columns = columns.withColumn("nth", F.row_number().over(W.partitionBy("file", "name").orderBy("col")))
    columns = columns.withColumn("slot", F.hex(F.xxhash64("name", "nth")))  # what the column is called while names are not settled

    placed = body.join(columns, ["file", "col"]).select("file", "row", "slot", "value", "cell_type")
    kinds = placed.groupBy("slot").agg(F.count_distinct("cell_type").alias("n"), F.min("cell_type").alias("kind"))
    known = columns.groupBy("slot", "name", "nth").agg(F.min("col").alias("place")).join(kinds, "slot", "left")
    listed = sorted((r["place"], r["name"], r["nth"], r["slot"], r["kind"] if r["n"] == 1 else "texte") for r in known.collect())  # as many rows as columns
    used, names = {"file", "row"}, {}
    for once in (True, False):
        for _, name, nth, slot, _ in listed:
            if (nth == 1) == once:
                names[slot] = _unused(name, used)

    grid = width.where("bottom is not null").select("file", F.explode(F.sequence(F.lit(header_row + 1), "bottom")).alias("row"))
    rows = placed.drop("cell_type").unionByName(grid, allowMissingColumns=True)
    slots = [(slot, kind) for _, _, _, slot, kind in listed]
    wide = rows.groupBy("file", "row").pivot("slot", [slot for slot, _ in slots]).agg(F.first("value", ignorenulls=True))
    return wide.select("file", "row", *[CASTS[kind](F.col(f"`{slot}`")).alias(names[slot]) for slot, kind in slots])
