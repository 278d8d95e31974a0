"""Reading values as numbers or text, and ordering them, alike in every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number: an optional sign, digits with one decimal point, an optional exponent.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TRUE_WORDS = ("true", "1", "yes", "y", "oui", "o", "vrai", "t")
FALSE_WORDS = ("false", "0", "no", "n", "non", "faux", "f")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def require(df: DataFrame, names: Iterable[str]) -> None:
    """Raise at plan time if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def number_text(c: Column, comma: bool = False, thousands: str | None = None) -> Column:
    s = c.cast("string")
    if thousands:
        s = F.replace(s, F.lit(thousands), F.lit(""))
        if thousands.isspace():
            s = F.translate(s, "   ", "")
    s = F.trim(s)
    return F.replace(s, F.lit(","), F.lit(".")) if comma else s


def try_number(c: Column, comma: bool = False, thousands: str | None = None) -> Column:
    """A double, or null where the text is no plain number."""
    s = number_text(c, comma, thousands)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def numeric(df: DataFrame, name: str, comma: bool = False) -> Column:
    """The column as double: a cast if it is numeric, else read from its text."""
    c = F.col(f"`{name}`")
    return c.cast("double") if is_numeric(df, name) else try_number(c, comma)


def as_text(df: DataFrame, name: str) -> Column:
    """Text form of a column; doubles print without an exponent up to 1e15."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1")
        plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
        big = (F.abs(c) >= 1e7) & (F.abs(c) < 1e15)
        return F.when(big, plain).otherwise(c.cast("string"))
    return c.cast("string")


def text_or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_text(df, name), F.lit(""))


def fold(c: Column, case_sensitive: bool) -> Column:
    return c if case_sensitive else F.lower(c)


def sure(c: Column, *operands: Column) -> Column:
    """A comparison that is false where an operand is null; unlike a fallback for null, it still reaches the scan."""
    return reduce(lambda a, b: a & b.isNotNull(), operands, c)


def ordering(order_by: Sequence[str | tuple[str, bool]]) -> list[Column]:
    """Sort keys with nulls last both ways; ``(name, True)`` is descending."""
    out = []
    for item in order_by:
        name, down = item if isinstance(item, tuple) else (item, False)
        c = F.col(f"`{name}`")
        out.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    return out


def total_order(df: DataFrame, order_by: Sequence[str | tuple[str, bool]] | None, ties: str | None = "all_columns") -> list[Column]:
    """``order_by`` with the remaining columns appended, so that equal keys are ordered alike on every run."""
    if not order_by:
        raise ValueError("this operator depends on row order: give order_by")
    named = {i[0] if isinstance(i, tuple) else i for i in order_by}
    require(df, named)
    rest = [n for n in df.columns if n not in named and not isinstance(df.schema[n].dataType, T.MapType)] if ties == "all_columns" else []
    return ordering([*order_by, *rest])


def place_key(df: DataFrame, order_by: Sequence[str | tuple[str, bool]], ties: str | None = "all_columns") -> tuple[Column, bool]:
    """The place of a row in an order as one comparable value, and whether the order falls.

    With it the first or last row of a group is a mergeable minimum or maximum,
    so a large group is combined map-side instead of being sorted in one task.
    Nulls are last: in a rising order the smallest value is the first row, in a
    falling one the largest.
    """
    if not order_by:
        raise ValueError("this operator depends on row order: give order_by")
    named = [i if isinstance(i, tuple) else (i, False) for i in order_by]
    require(df, [n for n, _ in named])
    downs = {d for _, d in named}
    if len(downs) > 1:
        raise ValueError("give one direction for all order columns here")
    down = downs.pop()
    rest = [n for n in df.columns if n not in {p for p, _ in named} and not isinstance(df.schema[n].dataType, T.MapType)] if ties == "all_columns" else []
    parts = []
    for k, n in enumerate([*[p for p, _ in named], *rest]):
        c = F.col(f"`{n}`")
        parts += [(c.isNotNull() if down else c.isNull()).alias(f"n{k}"), c.alias(f"v{k}")]
    return F.struct(*parts), down


def one_direction(order_by: Sequence[str | tuple[str, bool]] | None) -> bool:
    return len({i[1] if isinstance(i, tuple) else False for i in order_by or ()}) <= 1


def join_back(df: DataFrame, per: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Give every row the values of its key; nulls in keys are equal.

    Null-safe equality makes both sides exchange, so adaptive execution can
    split a hot key; a small ``per`` is broadcast by it.
    """
    if not keys:
        return df.crossJoin(F.broadcast(per.select(*values)))  # one row
    per = per.select(*[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)], *values)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & df[f"`{k}`"].eqNullSafe(F.col(f"_key_{i}"))
    return df.join(per, on, "left").drop(*[f"_key_{i}" for i in range(len(keys))])


def join_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same names, nulls equal; the right side's are dropped."""
    right = right.withColumnsRenamed({k: f"_right{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(F.col(f"`_right{k}`")) for k in keys])
    return left.join(right, on, how).drop(*[f"_right{k}" for k in keys])


def column(name: str) -> Column:
    return F.col(f"`{name}`")
