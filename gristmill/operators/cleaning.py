"""Typed casts with failure counts, and cleaning steps with a change report.

Casts and cleaning steps are row expressions and work on streaming rows; the
reports aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.xl import java_replacement
from gristmill.values import FALSE_WORDS, TRUE_WORDS, as_text, column, is_numeric, is_text, total_order, try_number

#: strptime directives and their Java letters (fixed values).
DATE_LETTERS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}
#: Forms tried in turn where no format is given; the day comes first.
DATE_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd")


def java_format(fmt: str) -> str:
    """A strptime format as a Java pattern; other letters are quoted."""
    out, k = "", 0
    while k < len(fmt):
        two = fmt[k : k + 2]
        if two in DATE_LETTERS:
            out, k = out + DATE_LETTERS[two], k + 2
        elif two == "%%":
            out, k = out + "%", k + 2
        elif fmt[k] == "%":
            raise ValueError(f"date directive {two} is not supported")
        else:
            out, k = out + (f"'{fmt[k]}'" if fmt[k].isalpha() else fmt[k]), k + 1
    return out


def parse_date(c: Column, fmt: str | None = None) -> Column:
    """A timestamp without zone, or null."""
    s = F.trim(c.cast("string"))
    forms = [java_format(fmt) if "%" in fmt else fmt] if fmt else DATE_FORMS
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms]).cast("timestamp_ntz")


def parse_boolean(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def _cast(df: DataFrame, spec: dict[str, Any], decimal: str, thousands: str | None) -> Column:
    name, kind, c = spec["column"], spec["type"], column(spec["column"])
    if kind == "number":
        return c.cast("double") if is_numeric(df, name) else try_number(c, comma=decimal == ",", thousands=thousands)
    if kind == "date":
        return c.cast("timestamp_ntz") if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else parse_date(c, spec.get("format"))
    if kind == "text":
        return as_text(df, name)
    if kind == "boolean":
        return c if isinstance(df.schema[name].dataType, T.BooleanType) else parse_boolean(c)
    raise ValueError(f"unknown type {kind}")


def apply_casts(df: DataFrame, casts: Sequence[dict[str, Any]], decimal: str = ".", thousands: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cast columns ``{column, type, format}`` and report ``{column, type, failed}``, failed being new nulls.

    Types: number, date, text, boolean.  Unknown columns are ignored.
    """
    casts = [c for c in casts if c["column"] in df.columns]
    made = {c["column"]: _cast(df, c, decimal, thousands) for c in casts}
    out = df.withColumns(made) if made else df
    if not casts:
        return out, df.sparkSession.createDataFrame([], "column string, type string, failed long")
    lost = [F.count_if(made[c["column"]].isNull() & column(c["column"]).isNotNull()).alias(f"_{k}") for k, c in enumerate(casts)]
    rows = F.array(*[F.struct(F.lit(c["column"]).alias("column"), F.lit(c["type"]).alias("type"), F.col(f"_{k}").alias("failed")) for k, c in enumerate(casts)])
    return out, df.agg(*lost).select(F.inline(rows))


# --- cleaning ----------------------------------------------------------------


def _text_step(df: DataFrame, name: str, c: Column, change) -> Column:
    return change(c) if is_text(df, name) else c


def _step(df: DataFrame, op: dict[str, Any]) -> Column:
    name, kind = op["column"], op["op"]
    c = column(name)
    if kind == "trim":
        return _text_step(df, name, c, lambda s: F.regexp_replace(s, r"(?U)^\s+|(?U)\s+$", ""))
    if kind == "upper":
        return _text_step(df, name, c, F.upper)
    if kind == "lower":
        return _text_step(df, name, c, F.lower)
    if kind == "capitalize":
        return _text_step(df, name, c, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1))))
    if kind == "replace":
        find, new = op.get("find") or "", op.get("replace") or ""
        if find == "":
            return c
        if op.get("regex"):
            return _text_step(df, name, c, lambda s: F.regexp_replace(s, find, java_replacement(new)))
        return _text_step(df, name, c, lambda s: F.replace(s, F.lit(find), F.lit(new)))
    if kind == "fillna":
        value = op.get("value")
        if op.get("value_type") == "number":
            try:
                number = float(value)
            except (TypeError, ValueError):
                number = 0.0
            value = int(number) if number.is_integer() and not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else number
            return F.coalesce(c, F.lit(value).cast(df.schema[name].dataType) if is_numeric(df, name) else F.lit(str(value)))
        return F.coalesce(c if is_text(df, name) else as_text(df, name), F.lit("" if value is None else str(value)))
    number = c.cast("double") if is_numeric(df, name) else try_number(c, comma=kind in ("to_number", "to_integer"))
    if kind == "to_number":
        return number
    if kind == "to_integer":
        return F.rint(number).cast("long")
    if kind == "round":
        scale = F.lit(10.0 ** int(op.get("digits") or 0))
        return F.rint(number * scale) / scale
    if kind == "abs":
        return F.abs(c if is_numeric(df, name) else number)
    if kind == "to_date":
        return parse_date(c, op.get("format"))
    raise ValueError(f"unknown cleaning step {kind}")


def _steps(df: DataFrame, operations: Sequence[dict[str, Any]]) -> tuple[DataFrame, list[tuple[int, dict[str, Any], str, str]]]:
    """Apply the steps, keeping each one's input and output as helper columns."""
    kept = []
    for k, op in enumerate(operations):
        if not op.get("enabled", True) or op.get("column") not in df.columns:
            continue
        name = op["column"]
        df = df.withColumn(f"_old_{k}", column(name)).withColumn(name, _step(df, op))
        df = df.withColumn(f"_new_{k}", column(name))
        kept.append((k, op, f"_old_{k}", f"_new_{k}"))
    return df, kept


def clean(df: DataFrame, operations: Sequence[dict[str, Any]]) -> DataFrame:
    """Apply cleaning steps in order: ``{op, column, enabled, find, replace, regex, value, value_type, format, digits}``.

    op: trim, upper, lower, capitalize, replace, fillna, to_number, to_integer,
    to_date, round, abs.  Text steps leave other types alone; steps on missing
    columns and disabled steps are skipped.
    """
    for op in operations:
        if op.get("enabled", True) and op.get("column") in df.columns:
            df = df.withColumn(op["column"], _step(df, op))
    return df


def clean_report(df: DataFrame, operations: Sequence[dict[str, Any]], order_by: Sequence[str | tuple[str, bool]] | None = None, samples: int = 5) -> DataFrame:
    """One row per step: changed, failed (new nulls), was_null and, given an order, up to ``samples`` old and new values.

    All counts come from one aggregate.
    """
    wide, kept = _steps(df, operations)
    if not kept:
        return df.sparkSession.createDataFrame([], "step int, op string, column string, changed long, failed long, was_null long, samples array<struct<old:string,new:string>>")
    aggs, kind = [], "array<struct<old:string,new:string>>"
    for k, _, old, new in kept:
        a, b = F.col(old), F.col(new)
        changed = ~a.cast("string").eqNullSafe(b.cast("string"))
        aggs += [F.count_if(changed).alias(f"_c{k}"), F.count_if(b.isNull() & a.isNotNull()).alias(f"_f{k}"), F.count_if(a.isNull()).alias(f"_w{k}")]
    out = wide.agg(*aggs)
    for k, _, old, new in kept:
        if order_by:
            changed = ~F.col(old).cast("string").eqNullSafe(F.col(new).cast("string"))
            keys = total_order(df, order_by)
            first = wide.where(changed).orderBy(*keys).limit(samples).select(F.col(old).cast("string").alias("old"), F.col(new).cast("string").alias("new"))
            out = out.crossJoin(first.agg(F.collect_list(F.struct("old", "new")).cast(kind).alias(f"_s{k}")))  # one row of at most ``samples``
        else:
            out = out.withColumn(f"_s{k}", F.array().cast(kind))
    rows = [
        F.struct(
            F.lit(k).alias("step"), F.lit(op["op"]).alias("op"), F.lit(op["column"]).alias("column"), F.col(f"_c{k}").alias("changed"),
            F.col(f"_f{k}").alias("failed"), F.col(f"_w{k}").alias("was_null"), F.col(f"_s{k}").alias("samples"),
        )
        for k, op, _, _ in kept
    ]
    return out.select(F.inline(F.array(*rows)))
