"""Delimited files in and out, dialects, sheets and workbooks, on files made in a temporary folder."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.operators.routing import route
from gristmill.sources.delimited import csv_dialects, detect_decimal, detect_encoding, detect_separator, peek, read_delimited, read_mixed
from gristmill.sources.sinks import write_delimited, write_routed, write_sheet_sized
from gristmill.sources.workbooks import cell_type_report, read_cells, read_workbooks


def test_french_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Article;Prix;Date;Actif\nA;12,5;05/03/2024;oui\nB;7,3;12/01/2024;non\nC;abc;01/12/2023;peut-être\n", "utf-8")
    casts = [{"column": "Prix", "type": "number"}, {"column": "Date", "type": "date", "format": "%d/%m/%Y"}, {"column": "Actif", "type": "boolean"}]
    df, report = read_delimited(spark, str(tmp_path / "a.csv"), sep=";", decimal=",", casts=casts)
    assert df.agg(F.sum("Prix")).first()[0] == pytest.approx(19.8)
    assert {r["column"]: r["failed"] for r in report.collect()} == {"Prix": 1, "Date": 0, "Actif": 1}
    assert [r["Article"] for r in df.orderBy("Date").collect()] == ["C", "B", "A"]


def test_western_encoding_and_skipped_lines(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("Référence;Pays\nABC;Bénin\nXYZ;Côte d’Ivoire\n".encode("cp1252"))
    df, _ = read_delimited(spark, str(tmp_path / "w.csv"), sep=";", encoding="cp1252")
    assert df.columns == ["Référence", "Pays"] and [r["Pays"] for r in df.collect()] == ["Bénin", "Côte d’Ivoire"]
    d = tmp_path / "skip"
    d.mkdir()
    for k in range(3):
        (d / f"{k}.csv").write_text(f"title {k}\n\nid,name\n{k}1,a\n{k}2,\"b,c\"\n")
    df, _ = read_delimited(spark, str(d), header_row=2)
    assert df.columns == ["id", "name"] and sorted((r["id"], r["name"]) for r in df.collect()) == sorted((f"{k}{i}", n) for k in range(3) for i, n in ((1, "a"), (2, "b,c")))


def test_dialects(spark, tmp_path):
    (tmp_path / "fr.csv").write_bytes("réf;prix\na;1,5\nb;2,5\nc;3,5\n".encode("cp1252"))
    (tmp_path / "en.csv").write_text("réf,prix\nd,1.5\ne,2.5\n", "utf-8")
    (tmp_path / "bom.csv").write_text("réf|prix\nf|7\n", "utf-8-sig")
    (tmp_path / "tab.tsv").write_text("réf\tprix\ng\t8\n", "utf-8")
    got = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["sep"], r["decimal"]) for r in csv_dialects(spark, str(tmp_path)).collect()}
    assert got == {"fr.csv": ("cp1252", ";", ","), "en.csv": ("utf-8", ",", "."), "bom.csv": ("utf-8-sig", "|", "."), "tab.tsv": ("utf-8", "\t", ".")}
    df, report = read_mixed(spark, str(tmp_path), casts=[{"column": "prix", "type": "number"}])
    assert df.count() == 7 and df.agg(F.sum("prix")).first()[0] == pytest.approx(26.5)
    assert report.first()["failed"] == 0


def test_detection():
    assert detect_encoding("é".encode()[:1]) == "utf-8" and detect_encoding(b"\xff\xfea\x00") == "utf-16" and detect_encoding(b"caf\xe9 12 \x80") == "cp1252"
    assert detect_separator(["a;b,c", "d;e", "f;g"]) == ";" and detect_separator(["x"], ".txt") == "\t" and detect_separator(["only"]) == ","
    assert detect_decimal(["h", "1,5;2,5", "x;a"], ";") == "," and detect_decimal(["h", "1,5"], ";") == "."


def test_write_french(spark, tmp_path):
    df = spark.createDataFrame([("Côte", 12.5, 1.2e7), ("x;y", None, -0.25)], "`Référence` string, Prix double, Gros double").coalesce(1)
    assert write_delimited(df, str(tmp_path / "fr"))
    raw = next((tmp_path / "fr").glob("part-*")).read_bytes()
    assert raw == '﻿Référence;Prix;Gros\r\nCôte;12,5;12000000\r\n"x;y";;-0,25\r\n'.encode()
    assert write_delimited(df, str(tmp_path / "en"), sep=",", decimal=".", bom=False, eol="\n")
    assert next((tmp_path / "en").glob("part-*")).read_text("utf-8").startswith("Référence,Prix,Gros\nCôte,12.5,12000000\n")
    assert not write_delimited(df.where("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert not write_delimited(df, str(tmp_path / "off"), enabled=False) and write_delimited(df, str(tmp_path / "off"), enabled=False, force=True)
    back, _ = read_delimited(spark, str(tmp_path / "fr"), sep=";", decimal=",", casts=[{"column": "Prix", "type": "number"}])
    assert back.columns == ["Référence", "Prix", "Gros"] and back.agg(F.sum("Prix")).first()[0] == 12.5


def test_sheet_sized(spark, tmp_path):
    df = spark.range(25).coalesce(1)
    assert write_sheet_sized(df, str(tmp_path / "s"), rows=10)
    assert len(list((tmp_path / "s").glob("part-*"))) == 3
    wide = spark.range(1).select(*[F.lit(0).alias(f"c{k}") for k in range(20)])
    import gristmill.sources.sinks as sinks

    sinks_columns, sinks.SHEET_COLUMNS = sinks.SHEET_COLUMNS, 10
    try:
        with pytest.raises(ValueError):
            write_sheet_sized(wide, str(tmp_path / "w"))
    finally:
        sinks.SHEET_COLUMNS = sinks_columns


def test_routed_folders_and_peek(spark, tmp_path):
    df = spark.range(10)
    tagged = route(df, [{"id": "low", "match": {"groups": [{"rules": [{"column": "id", "test": "num_lt", "value": 3}]}]}}])
    write_routed(tagged, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/route=low")).count() == 3
    rows, kinds = peek(df, 4)
    assert rows.count() == 4 and [tuple(r) for r in kinds.collect()] == [("id", "BIGINT")]


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows, name="Feuil1"):
    """A minimal workbook: texts shared, numbers, booleans and dates (style 1)."""
    texts, body = [], ""
    for i, row in enumerate(rows, 1):
        cells = ""
        for k, v in enumerate(row):
            ref = f"{chr(65 + k)}{i}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
            elif isinstance(v, (int, float)):
                cells += f'<c r="{ref}"><v>{v}</v></c>'
            elif v.startswith("@"):
                cells += f'<c r="{ref}" s="1"><v>{v[1:]}</v></c>'
            else:
                texts.append(v)
                cells += f'<c r="{ref}" t="s"><v>{len(texts) - 1}</v></c>'
        body += f'<row r="{i}">{cells}</row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["code", "libelle", "n", None, "jour", "ok"], ["x", "t", 1.5, "blank", "@45356", True], [7, "u", 2, None, "@45357", False], ["y", None, 3, None, None, None], [12, None, None, None, None, None]])
    workbook(tmp_path / "b.xlsx", [["code", "libelle", "n"], ["z", "w", 4]])
    df = read_workbooks(spark, str(tmp_path / "*.xlsx"))
    a = df.where("file like '%a.xlsx'").orderBy("row").collect()
    assert [r["code"] for r in a] == ["x", "7", "y", "12"] and [r["n"] for r in a] == [1.5, 2.0, 3.0, None]
    assert str(a[0]["jour"]) == "2024-03-05 00:00:00" and a[0]["ok"] is True
    assert df.count() == 5 and "col_3" in df.columns
    types = {r["col"]: r for r in cell_type_report(read_cells(spark, str(tmp_path / "a.xlsx"))).collect()}
    assert (types[0]["texte"], types[0]["nombre"], types[0]["mixed"]) == (2, 2, True) and not types[1]["mixed"]


def test_equal_headers_stay_apart(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["prix", "prix", None], ["one", "two", 3]])
    workbook(tmp_path / "b.xlsx", [["nom", "prix"], ["x", "four"]])
    rows = [r.asDict() for r in read_workbooks(spark, str(tmp_path / "*.xlsx")).orderBy("file").drop("file", "row").collect()]
    assert rows == [{"prix": "one", "prix_2": "two", "col_2": 3.0, "nom": None}, {"prix": "four", "prix_2": None, "col_2": None, "nom": "x"}]


def test_headers_that_differ_are_an_error(spark, tmp_path):
    (tmp_path / "1.csv").write_text("title\nid,name\n1,a\n")
    (tmp_path / "2.csv").write_text("title\nname,id\nb,2\n")
    with pytest.raises(ValueError, match="differ"):
        read_delimited(spark, str(tmp_path), header_row=1)
    (tmp_path / "2.csv").write_text("title\n")
    with pytest.raises(ValueError, match="no line"):
        read_delimited(spark, str(tmp_path), header_row=1)


def test_quoted_line_breaks_over_splits(spark, tmp_path):
    """Records of several lines, some over whole splits, read in many tasks and equal to the csv module's reading."""
    import csv
    import random

    r = random.Random(5)
    for k in range(2):
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            f.write('a "title, with one quote\n\n')
            out = csv.writer(f, lineterminator="\r\n" if k else "\n")
            out.writerow(["id", "no\nte", "x"])
            for i in range(400):
                parts = ["é", "plain", 'say ""hi""', "a\nb", "c\r\nd", ",", "\n", "long " * (400 if i % 97 == 5 else 1), "x\n" * (900 if i % 131 == 7 else 0)]
                out.writerow([f"{k}-{i}", "".join(r.sample(parts, 5)), r.choice(["", "z", "q,\"w"])])
    want = []
    for k in range(2):
        with open(tmp_path / f"{k}.csv", newline="", encoding="utf-8") as f:
            f.readline(), f.readline()
            want += list(csv.reader(f))[1:]
    keep = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df, _ = read_delimited(spark, str(tmp_path), header_row=2)
        assert df.columns == ["id", "no\nte", "x"]
        got = sorted((a, b, c or "") for a, b, c in map(tuple, df.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert got == sorted(map(tuple, want)) and "MapInPandas" not in plan and "Python" not in plan


def test_only_pieces_of_long_records_are_exchanged(spark, tmp_path):
    """Lines that are records as they are stay in the task that reads them; only pieces of records of several lines are gathered."""
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f'{i},"a\n""b\n"\n' if i % 100 == 7 else f'{i},"plain, {i}"\n' for i in range(5000)))
    df, _ = read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {int(r["id"]): r["v"] for r in df.collect()}
    assert got == {i: 'a\n"b\n' if i % 100 == 7 else f"plain, {i}" for i in range(5000)}

    def moved(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return moved(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return moved(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(moved(plan.children().apply(k)) for k in range(plan.children().size()))

    assert 50 <= moved(df._jdf.queryExecution().executedPlan()) <= 150


def test_files_of_one_task_keep_their_quotes_apart(spark, tmp_path):
    """Small files read by one task, some with an odd quote above the header or one that is never closed."""
    for k in range(6):
        (tmp_path / f"{k}.csv").write_text(f'a "title\nid,v\n{k}1,"x\ny"\n{k}2,"p\n\nq",\n{k}3,z\n' + (f'{k}4,"open\nto the\nend\n' if k % 2 else f"{k}4,last\n"))
    df, _ = read_delimited(spark, str(tmp_path), header_row=1)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() < 6
    got = {r["id"]: r["v"] for r in df.collect()}
    want = {f"{k}{i}": v for k in range(6) for i, v in ((1, "x\ny"), (2, "p\n\nq"), (3, "z"), (4, "last"))}
    assert {k: v for k, v in got.items() if k not in ("14", "34", "54")} == {k: v for k, v in want.items() if k not in ("14", "34", "54")}
    assert all(got[k].startswith('"open\nto the\nend') or got[k].startswith("open\nto the\nend") for k in ("14", "34", "54"))


def test_odd_lines_before(spark):
    from gristmill.sources.delimited import quotes_before

    lines = spark.range(1000, numPartitions=3).selectExpr("id", "cast(id % 7 in (1, 2, 5) as int) as odd", "spark_partition_id() as part")
    rows = sorted(quotes_before(lines).collect())
    assert len(rows) == 1000 and all(r["seen"] == sum(x["odd"] for x in rows[: r["id"]] if x["part"] == r["part"]) for r in rows)


def test_plain_files_with_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t\nid,v\n" + "".join(f"{i},x\n" for i in range(100)) + "\n")
    df, _ = read_delimited(spark, str(tmp_path / "a.csv"), header_row=1)
    assert df.count() == 100
    df, _ = read_delimited(spark, str(tmp_path / "a.csv"), header_row=1, multi_line=True)
    assert df.where("v = 'x'").count() == 100


def test_workbook_grid(spark, tmp_path):
    """Headers that clash, are empty, blank or hard to name keep their columns; blank rows stay but for the last ones; a book of a header alone has columns."""
    workbook(tmp_path / "a.xlsx", [["prix", "prix", "prix_2", "file", "row", "Prix", "q`t", None, "vide"], ["one", "two", "three", "f", "r", "four", "back", "blank", None], [], ["x", None, "z"], []])
    df = read_workbooks(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["file", "row", "prix", "prix_4", "prix_2", "file_2", "row_2", "Prix_3", "q`t", "col_7", "vide"]
    assert [tuple(r)[1:] for r in df.orderBy("row").collect()] == [(1, "one", "two", "three", "f", "r", "four", "back", "blank", None), (2, *[None] * 9), (3, "x", None, "z", *[None] * 6)]
    workbook(tmp_path / "h.xlsx", [["only", "a", "header"]])
    alone = read_workbooks(spark, str(tmp_path / "h.xlsx"))
    assert alone.columns == ["file", "row", "only", "a", "header"] and alone.count() == 0
    workbook(tmp_path / "late.xlsx", [["title"], [], ["id", None, "v"], [1, 2, 3.5], [None], [4]])
    late = read_workbooks(spark, str(tmp_path / "late.xlsx"), header_row=2)
    assert [tuple(r)[1:] for r in late.orderBy("row").collect()] == [(3, 1.0, 2.0, 3.5), (4, None, None, None), (5, 4.0, None, None)] and late.columns[2:] == ["id", "col_1", "v"]


def test_a_book_is_read_by_range(spark, tmp_path, monkeypatch):
    """Cells come as a stream from the sheet's entry, however large other entries are."""
    from gristmill.sources import workbooks

    workbook(tmp_path / "big.xlsx", [["n"], *[[i] for i in range(3000)]])
    with zipfile.ZipFile(tmp_path / "big.xlsx", "a", zipfile.ZIP_STORED) as z:
        z.writestr("xl/media/picture.bin", b"\0" * 8_000_000)
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            got = self.f.read(n)
            read.append(len(got))
            return got

        def __getattr__(self, name):
            return getattr(self.f, name)

    with open(tmp_path / "big.xlsx", "rb") as f:
        cells = workbooks.sheet_cells(Counted(f))
        assert next(cells) == (0, 0, "n", "texte") and sum(1 for _ in cells) == 3000
    assert sum(read) < 500_000
