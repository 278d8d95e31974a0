"""Line dedup over overlapping three-line windows.

Every run of three consecutive lines is hashed (two independent 64-bit hashes).
Windows that occur more than once anywhere keep their first occurrence, by
document id and then position; later occurrences mark their three lines, the
marks of a document are merged, and the marked lines go.

The windows travel as hashes only.  A window that a third of all documents
share is counted map-side, and its rows are joined by a key that adaptive
execution may split.

Edge cases: null text stays null and has 0 lines; texts of fewer than three
lines are left alone; windows of white space only are never removed; rows with
a null id are left alone and remove nothing; rows equal in id and text are one
document, so the same position in them is one occurrence, and rows that share an
id but not the text are documents of their own, ordered by a hash of the text; a
document that only repeats others is left with an empty text; an empty table gives
no rows; extra columns pass through (``n_lines`` and ``n_removed`` are replaced;
``_dedup_`` is a reserved beginning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, need, spread_join


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``(doc, body, pos, h, g)``: the two hashes of every window that has a visible character; ``body`` is a hash of the whole text."""
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("body"),
        F.transform(_lines(text_col), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("second"), x).alias("g"), (F.trim(F.translate(x, "\t\r ", "   ")) != "").alias("v"))).alias("l"),
    )
    at = lambda i, k, f: F.get(F.col("l"), i + k)[f]

    def one(i: Column) -> Column:
        shown = at(i, 0, "v")
        for k in range(1, window):
            shown = shown | at(i, k, "v")
        return F.struct(i.alias("pos"), F.xxhash64(*[at(i, k, "h") for k in range(window)]).alias("h"), F.xxhash64(*[at(i, k, "g") for k in range(window)]).alias("g"), shown.alias("v"))

    rows = lines.where(F.size("l") >= window).select("doc", "body", F.inline(F.transform(F.sequence(F.lit(0), F.size("l") - window), one)))
    return rows.where("v").select("doc", "body", "pos", "h", "g")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with repeated windows removed from the text, plus ``n_lines`` and ``n_removed``."""
    need(docs, id_col, text_col)
    windows = cut(line_windows(docs, id_col, text_col, window))  # read twice, hashed once
    place = F.struct("doc", "body", "pos")
    repeated = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = repeated.where("first <> last").select("h", "g", "first")
    later = spread_join(windows, repeated, ["h", "g"]).where(place != F.col("first"))
    marks = later.groupBy(F.col("doc").alias("_dedup_doc"), F.col("body").alias("_dedup_body")).agg(F.collect_set("pos").alias("_dedup_starts"))
    covered = F.array_distinct(F.flatten(F.transform("_dedup_starts", lambda s: F.sequence(s, s + (window - 1)))))
    lines = _lines(text_col)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    clean = F.array_join(F.transform(kept, lambda i: F.get(F.col("_dedup_lines"), i)), "\n")
    removed = F.size("_dedup_lines") - F.size(kept)
    same = (F.col(id_col).cast("long") == F.col("_dedup_doc")) & (F.xxhash64(text_col) == F.col("_dedup_body"))
    out = docs.join(marks, same, "left").withColumn("_dedup_lines", lines)
    return (
        out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_dedup_lines")).cast("long"))
        .withColumn("n_removed", F.when(F.col("_dedup_starts").isNull(), 0).otherwise(removed).cast("long"))
        .withColumn(text_col, F.when(F.col("_dedup_starts").isNull(), F.col(text_col)).otherwise(clean))
        .drop("_dedup_doc", "_dedup_body", "_dedup_starts", "_dedup_lines")
    )
