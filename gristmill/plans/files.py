"""Queries that go through files: tables written as delimited text or routed folders and read again."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.operators.routing import route
from gristmill.plans.tables import Tables, register
from gristmill.session import shared_folder
from gristmill.sources.delimited import csv_dialects, peek, read_delimited, read_mixed
from gristmill.sources.sinks import write_delimited, write_routed, write_sheet_sized
from gristmill.sources.workbooks import cell_type_report, read_cells, read_workbooks

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)


def scratch(t: Tables, name: str) -> str:
    """A new folder in the shared folder; whoever owns that folder clears it."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


_CASTS = [{"column": "o_orderkey", "type": "number"}, {"column": "price", "type": "number"}, {"column": "day", "type": "date", "format": "%Y-%m-%d %H:%M:%S"}]
_ORDERS = "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice AS price, o_orderdate AS day, o_orderstatus || ';\"' || o_orderpriority AS note FROM orders"


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"), F.concat("o_orderstatus", F.lit(';"'), "o_orderpriority").alias("note"))


@query(_ORDERS)
def csv_roundtrip_fr(t: Tables) -> DataFrame:
    folder = scratch(t, "csv-fr")
    write_delimited(_orders(t), folder)
    return read_delimited(t.spark, folder, sep=";", decimal=",", casts=_CASTS)[0]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders")
def sheet_split(t: Tables) -> DataFrame:
    folder = scratch(t, "sheets")
    write_sheet_sized(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), folder, rows=5000, sep=",", bom=False, eol="\n")
    return read_delimited(t.spark, folder)[0]


@query("""SELECT CAST((n - 1) // 4000 AS BIGINT) AS sheet, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last, bool_and(run) AS in_order FROM (
SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n, o_orderkey, true AS run FROM orders) GROUP BY 1""")
def sheets_filled(t: Tables) -> DataFrame:
    """Orders in files of 4,000 rows, newest first: what each file holds."""
    folder = scratch(t, "filled")
    rows = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
    write_sheet_sized(rows, folder, rows=4000, order_by=[("day", True), "o_orderkey"], sep=",", bom=False, eol="\n")
    name, number = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.col("o_orderkey").cast("long")
    back = t.spark.read.option("header", "true").csv(folder).select(name.alias("name"), number.alias("key"), "day", F.monotonically_increasing_id().alias("at"))
    before = W.partitionBy("name").orderBy("at")
    follows = (F.lag("day").over(before) > F.col("day")) | ((F.lag("day").over(before) == F.col("day")) & (F.lag("key").over(before) < F.col("key")))
    per = back.withColumn("run", F.coalesce(follows, F.lit(True))).groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first"), F.max("key").alias("last"), F.bool_and("run").alias("in_order"))
    return per.select((F.row_number().over(W.orderBy("name")) - 1).cast("long").alias("sheet"), "rows", "first", "last", "in_order")


@query("""SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier""")
def mixed_dialects(t: Tables) -> DataFrame:
    folder = scratch(t, "mixed")
    write_delimited(t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).coalesce(1), f"{folder}/fr")
    write_delimited(t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).coalesce(1), f"{folder}/en", sep=",", decimal=".", bom=False, eol="\n")
    return read_mixed(t.spark, f"{folder}/*/part-*", casts=[{"column": "balance", "type": "number"}])[0]


_DIALECTS = ((";", ",", True), (",", ".", False), ("|", ",", True))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("""WITH k AS (SELECT c_mktsegment AS folder, [0, 1, 2, 0, 1][list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment)] AS d FROM customer GROUP BY 1)
SELECT folder, CASE WHEN d = 1 THEN 'utf-8' ELSE 'utf-8-sig' END AS encoding, [';', ',', '|'][d + 1] AS sep, [',', '.', ','][d + 1] AS decimal FROM k""")
def dialect_scan(t: Tables) -> DataFrame:
    """A file of customers for each market segment, in three dialects; what is found of each file."""
    folder = scratch(t, "dialects")
    rows = t.customer.select("c_custkey", (F.abs("c_acctbal") + 0.25).alias("balance"), "c_name", "c_mktsegment")
    for k, segment in enumerate(_SEGMENTS):
        sep, decimal, bom = _DIALECTS[k % 3]
        write_delimited(rows.where(F.col("c_mktsegment") == segment).drop("c_mktsegment").coalesce(1), f"{folder}/{segment}", sep=sep, decimal=decimal, bom=bom, eol="\n")
    found = csv_dialects(t.spark, f"{folder}/*/part-*")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "encoding", "sep", "decimal")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def skipped_lines(t: Tables) -> DataFrame:
    """Files that begin with a title and a blank line before their header."""
    folder = scratch(t, "titles")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name")
    bodies = t.supplier.groupBy((F.col("s_suppkey") % 3).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(F.lit("suppliers "), F.col("part").cast("string"), F.lit("\n\ns_suppkey,s_name\n"), "body")
    bodies.repartition(3, "part").select(text.alias("value"), "part").write.partitionBy("part").text(folder)
    return read_delimited(t.spark, f"{folder}/part=*", header_row=2)[0]


@query("""SELECT 'o_orderkey' AS "column", 'BIGINT' AS type, count(*) AS rows, least(count(*), 100) AS sampled FROM orders UNION ALL SELECT 'o_orderstatus', 'VARCHAR', count(*), least(count(*), 100) FROM orders
UNION ALL SELECT 'o_totalprice', 'DOUBLE', count(*), least(count(*), 100) FROM orders UNION ALL SELECT 'o_orderdate', 'TIMESTAMP', count(*), least(count(*), 100) FROM orders""")
def peek_columns(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    sample, kinds = peek(orders)
    return kinds.crossJoin(orders.agg(F.count(F.lit(1)).alias("rows"))).crossJoin(sample.agg(F.count(F.lit(1)).alias("sampled")))


@query("SELECT 'empty' AS export, false AS written, count(*) AS rows FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'disabled', false, 0 UNION ALL SELECT 'forced', true, count(*) FROM orders")
def skipped_exports(t: Tables) -> DataFrame:
    """An empty result and a disabled export write nothing; a forced one does."""
    folder, rows = scratch(t, "exports"), t.orders.select("o_orderkey", "o_totalprice")
    done = {
        "empty": write_delimited(rows.where("o_totalprice < 0"), f"{folder}/empty"), "disabled": write_delimited(rows, f"{folder}/disabled", enabled=False),
        "forced": write_delimited(rows, f"{folder}/forced", enabled=False, force=True),
    }
    back = read_delimited(t.spark, f"{folder}/forced", sep=";", decimal=",")[0].agg(F.count(F.lit(1)).alias("n"))
    flags = t.spark.createDataFrame(list(done.items()), "export string, written boolean")
    return flags.crossJoin(back).select("export", "written", F.when(F.col("written"), F.col("n")).otherwise(0).alias("rows"))


_BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>',
    '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
)


def _write_workbooks(rows: DataFrame, folder: str, header: list[str | None], step: int = 1) -> None:
    """Test data: a workbook of plain cells for each value of the first column; texts inline, numbers as they are; with ``step`` 2 every other row is blank."""

    def save(key, table: pd.DataFrame) -> pd.DataFrame:
        def cell(k: int, at: int, v) -> str:
            if v is None:
                return ""
            place = f'r="{chr(65 + k)}{at}"'
            return f"<c {place}><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c {place} t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

        lines = [header, *table.sort_values(list(table.columns))[list(table.columns)[1:]].astype(object).values.tolist()]
        body = "".join(f'<row r="{k * step + 1}">{"".join(cell(c, k * step + 1, v) for c, v in enumerate(line))}</row>' for k, line in enumerate(lines))
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            z.writestr("xl/workbook.xml", _BOOK[0])
            z.writestr("xl/_rels/workbook.xml.rels", _BOOK[1])
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
        filesystem, root = pafs.FileSystem.from_uri(folder) if folder.startswith("file:") or "://" in folder else (pafs.LocalFileSystem(), folder)
        filesystem.create_dir(root, recursive=True)
        with filesystem.open_output_stream(f"{root}/{key[0]}.xlsx") as out:
            out.write(made.getvalue())
        return pd.DataFrame({"n": [len(table)]})

    rows.groupBy(rows.columns[0]).applyInPandas(save, "n long").agg(F.sum("n")).collect()


@query("""SELECT CAST(s_suppkey AS DOUBLE) AS code, s_name AS name, CAST(s_nationkey AS DOUBLE) AS name_4, s_acctbal AS name_2, CAST(s_suppkey % 7 AS DOUBLE) AS col_4, s_name AS "Name_3", CAST(NULL AS VARCHAR) AS empty FROM supplier
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(range(0, count(*))) FROM supplier GROUP BY s_nationkey)""")
def workbook_grid(t: Tables) -> DataFrame:
    """Suppliers through workbooks with clashing, empty and blank headers and a blank row after every row."""
    folder = scratch(t, "grid")
    cells = t.supplier.select("s_nationkey", "s_suppkey", "s_name", F.col("s_nationkey").alias("again"), "s_acctbal", (F.col("s_suppkey") % 7).alias("unnamed"), F.col("s_name").alias("other"))
    _write_workbooks(cells, folder, ["code", "name", "name", "name_2", None, "Name", "empty"], step=2)
    return read_workbooks(t.spark, f"{folder}/*.xlsx").drop("file", "row")


@query("""SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'two' || chr(10) || 'lines; "' || l_returnflag || '"' || chr(10) || l_linestatus ELSE l_returnflag END AS note FROM lineitem""")
def quoted_breaks(t: Tables) -> DataFrame:
    """Line items through large files with a title before their header and line breaks inside quotes, read in splits."""
    folder = scratch(t, "breaks")
    flag = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit('"two\nlines; ""'), "l_returnflag", F.lit('""\n'), "l_linestatus", F.lit('"'))).otherwise(F.col("l_returnflag"))
    filler = F.rpad(F.lit("x"), 120, "x")  # so that even the smallest table makes a file of several splits
    line = F.concat_ws(";", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), flag, filler)
    top = "line items, with a \" in the title\n\nl_orderkey;l_linenumber;note;filler"
    # every task writes a file of its own; the first row of each brings the lines above it, and one file has nothing else
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    body = t.lineitem.select(line.alias("value")).select(F.when(first, F.concat(F.lit(top + "\n"), "value")).otherwise(F.col("value")).alias("value"))
    t.spark.createDataFrame([(top,)], "value string").coalesce(1).union(body).write.text(folder)
    casts = [{"column": "l_orderkey", "type": "number"}, {"column": "l_linenumber", "type": "number"}]
    return read_delimited(t.spark, folder, sep=";", header_row=2, casts=casts)[0].drop("filler")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS code, s_name AS name, CAST(s_nationkey AS DOUBLE) AS name_2, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS mixed FROM supplier")
def workbook_rows(t: Tables) -> DataFrame:
    """Suppliers through workbooks, one for each nation, with two equal headers and a column of mixed cells."""
    folder = scratch(t, "books")
    mixed = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise(F.col("s_name"))
    _write_workbooks(t.supplier.select("s_nationkey", "s_suppkey", "s_name", F.col("s_nationkey").alias("again"), mixed.alias("mixed")), folder, ["code", "name", "name", "mixed"])
    return read_workbooks(t.spark, f"{folder}/*.xlsx").drop("file", "row")


@query("""SELECT CAST(col AS INTEGER) AS col, CAST(sum(texte) AS BIGINT) AS texte, CAST(sum(nombre) AS BIGINT) AS nombre, CAST(count(*) FILTER (WHERE texte > 0 AND nombre > 0) AS BIGINT) AS mixed FROM (
SELECT s_nationkey, 0 AS col, 0 AS texte, count(*) AS nombre FROM supplier GROUP BY 1 UNION ALL SELECT s_nationkey, 1, count(*), 0 FROM supplier GROUP BY 1) GROUP BY col""")
def workbook_types(t: Tables) -> DataFrame:
    folder = scratch(t, "types")
    _write_workbooks(t.supplier.select("s_nationkey", "s_suppkey", "s_name"), folder, ["code", "name"])
    types = cell_type_report(read_cells(t.spark, f"{folder}/*.xlsx"))
    return types.groupBy("col").agg(F.sum("texte").alias("texte"), F.sum("nombre").alias("nombre"), F.count_if("mixed").alias("mixed"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' ELSE 'else' END AS route FROM orders")
def routed_parquet(t: Tables) -> DataFrame:
    folder = scratch(t, "routed")
    big = {"groups": [{"rules": [{"column": "o_totalprice", "test": "num_gt", "value": 300000}]}]}
    write_routed(route(t.orders, [{"id": "big", "match": big}]), folder)
    return t.spark.read.parquet(folder).select("o_orderkey", "route")
