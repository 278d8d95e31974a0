"""Spreadsheet-style scalar functions on Columns.

All are native expressions and work on streaming rows.  Names end in an
underscore where Python has the word already.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.values import try_number


def _c(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- arithmetic, comparison, logic ------------------------------------------


def divide(a, b) -> Column:
    """True division; null when dividing by zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def mod(a, b) -> Column:
    """Remainder with the sign of the dividend; null for a divisor of zero."""
    return F.try_mod(_c(a), _c(b))


def concat_values(*xs) -> Column:
    """The ``&`` operator: null if any part is null."""
    return F.concat(*[_c(x).cast("string") for x in xs])


def if_(condition: Column, then, otherwise=None) -> Column:
    got = F.when(condition, _c(then))
    return got if otherwise is None else got.otherwise(_c(otherwise))


def and_(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, xs)


def or_(*xs: Column) -> Column:
    return reduce(lambda a, b: a | b, xs)


def not_(x: Column) -> Column:
    return ~x


# --- text --------------------------------------------------------------------


def concat(*xs) -> Column:
    """CONCAT: nulls are skipped."""
    return F.concat_ws("", *[_c(x).cast("string") for x in xs])


def upper(s) -> Column:
    return F.upper(_c(s))


def lower(s) -> Column:
    return F.lower(_c(s))


def trim(s) -> Column:
    """Spaces at both ends, no other white space."""
    return F.trim(_c(s))


def left(s, n) -> Column:
    """First n characters; a negative n drops that many from the end."""
    s, n = _c(s), _c(n)
    return F.when(n < 0, F.substr(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))).otherwise(F.left(s, n))


def right(s, n) -> Column:
    """Last n characters; a negative n drops that many from the start."""
    s, n = _c(s), _c(n)
    return F.when(n < 0, F.substr(s, F.lit(1) - n, F.length(s))).otherwise(F.right(s, n))


def mid(s, start, length) -> Column:
    """``length`` characters from a 1-based start; place 0 is the one before the first."""
    s, start, length = _c(s), _c(start), _c(length)
    return F.when(start == 0, F.substr(s, F.lit(1), F.greatest(length - 1, F.lit(0)))).otherwise(F.substr(s, start, length))


def len_(s) -> Column:
    return F.length(_c(s).cast("string"))


def rept(s, n: int) -> Column:
    return F.repeat(_c(s), n)


def find(what, within, start=1) -> Column:
    """1-based place of a text, null if it is not there."""
    within, start = _c(within), _c(start)
    return F.nullif(F.when(start > 1, F.nullif(F.instr(F.substr(within, start), _c(what)), F.lit(0)) + start - 1).otherwise(F.instr(within, _c(what))), F.lit(0))


def search(what, within, start=1) -> Column:
    """``find`` without regard to case."""
    return find(F.lower(_c(what)), F.lower(_c(within)), start)


def substitute(s, old, new) -> Column:
    return F.replace(_c(s), _c(old), _c(new))


def replace(s, start, n, new) -> Column:
    """Put ``new`` in place of n characters from a 1-based start."""
    return F.overlay(_c(s), _c(new), _c(start), _c(n))


def _pieces(s: Column, sep: str) -> Column:
    return F.split(s, quoted(sep), -1)


def quoted(sep: str) -> str:
    return "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def textbefore(s, sep: str, n: int = 1) -> Column:
    """Text before the n-th separator, from the end if n is negative."""
    parts = _pieces(_c(s), sep)
    upto = F.lit(n) if n > 0 else F.greatest(F.size(parts) + n, F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), upto), sep)


def textafter(s, sep: str, n: int = 1) -> Column:
    """Text after the n-th separator, from the end if n is negative."""
    parts = _pieces(_c(s), sep)
    size = F.size(parts)
    first = F.lit(n + 1) if n > 0 else F.greatest(size + n + 1, F.lit(1))
    return F.array_join(F.slice(parts, first, F.greatest(size - first + 1, F.lit(0))), sep)


def regexextract(s, pattern: str, group: int = 0) -> Column:
    """The whole match unless a group is named; empty if there is none."""
    return F.regexp_extract(_c(s), pattern, group)


def regexreplace(s, pattern: str, new: str) -> Column:
    return F.regexp_replace(_c(s), pattern, java_replacement(new))


def java_replacement(new: str) -> str:
    r"""Group references ``\1`` become ``$1``; a dollar sign stays a dollar sign."""
    out, k = "", 0
    while k < len(new):
        if new[k] == "\\" and k + 1 < len(new) and new[k + 1].isdigit():
            out, k = f"{out}${new[k + 1]}", k + 2
        else:
            out, k = out + ("\\$" if new[k] == "$" else new[k]), k + 1
    return out


# --- numbers -----------------------------------------------------------------


def round_(x, digits: int = 0) -> Column:
    """Half away from zero after scaling in binary."""
    x, scale = _c(x).cast("double"), float(10**digits) if digits >= 0 else 1 / 10**-digits
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + 0.5) / F.lit(scale)


def abs_(x) -> Column:
    return F.abs(_c(x))


def power(x, y) -> Column:
    return F.pow(_c(x), _c(y))


def min_(*xs) -> Column:
    """Least argument, nulls skipped; one argument is itself."""
    return F.least(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def max_(*xs) -> Column:
    return F.greatest(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def coalesce(*xs) -> Column:
    return F.coalesce(*map(_c, xs))


def isblank(x) -> Column:
    """Null or empty text."""
    return _c(x).isNull() | (_c(x).cast("string") == "")


def year(d) -> Column:
    return F.year(_c(d))


def month(d) -> Column:
    return F.month(_c(d))


def day(d) -> Column:
    return F.dayofmonth(_c(d))


def today() -> Column:
    return F.current_date()


def text(x, fmt: str | None = None) -> Column:
    """Cast to text; the format is taken and ignored."""
    return _c(x).cast("string")


def value(s) -> Column:
    """A number, or null."""
    return try_number(_c(s))


# --- guided forms ------------------------------------------------------------


def extract(s, how: str, sep: str = "", n: int = 1, start: int = 1) -> Column:
    """after, before (a separator, n-th), first, last (n characters) or mid (n characters from start)."""
    forms = {
        "after": lambda: textafter(s, sep, n), "before": lambda: textbefore(s, sep, n), "first": lambda: left(s, n), "last": lambda: right(s, n),
        "mid": lambda: mid(s, start, n),
    }
    return forms[how]()


def transform(s, how: str, old: str = "", new: str = "") -> Column:
    forms = {"upper": lambda: upper(s), "lower": lambda: lower(s), "trim": lambda: trim(s), "length": lambda: len_(s), "replace": lambda: substitute(s, old, new)}
    return forms[how]()


def combine(parts: Sequence[Any], sep: str = "") -> Column:
    return F.concat_ws(sep, *[_c(p).cast("string") for p in parts])


def condition(s: Column, op: str, against, then, otherwise=None) -> Column:
    tests = {
        "=": lambda: s == against, "<>": lambda: s != against, ">": lambda: s > against, ">=": lambda: s >= against, "<": lambda: s < against,
        "<=": lambda: s <= against, "contains": lambda: s.contains(against), "blank": lambda: isblank(s),
    }
    return if_(tests[op](), then, otherwise)


def math(a, op: str, b, digits: int | None = None) -> Column:
    a, b = _c(a), _c(b)
    got = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "%": lambda: mod(a, b)}[op]()
    return got if digits is None else round_(got, digits)


def with_columns_in_order(df: DataFrame, columns: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add or replace columns one after the other; each sees those before it."""
    for name, c in columns:
        df = df.withColumn(name, c)
    return df
