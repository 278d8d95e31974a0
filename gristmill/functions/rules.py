"""Row rules: predicates for classifying rows, as native boolean Columns.

A rule is ``{column, test, value | values, via: "column" + column2, negate}``
with ``position``, ``start``, ``length`` and ``charclass`` for positional
tests.  A condition is an OR of groups of ANDed rules, a positional mask, or a
check over groups of rows.  Row rules also work on streaming rows.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.xl import quoted
from gristmill.values import NUMBER, column, fold, is_numeric, numeric, sure, text_or_empty

#: Character classes of positional tests (Unicode) and of masks (ASCII); fixed values.
UNICODE = {"letter": r"\p{L}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "digit": r"\p{Nd}", "alnum": r"[\p{L}\p{Nd}]", "any": "."}
ASCII = {"letter": "[A-Za-z]", "upper": "[A-Z]", "lower": "[a-z]", "digit": "[0-9]", "alnum": "[A-Za-z0-9]", "any": "."}


def _pattern(text: str, case_sensitive: bool, full: bool) -> str | None:
    """A Java pattern, or None if the text is no valid one."""
    if "(?P" in text:
        raise ValueError("named groups of the form (?P<name>…) are not supported; use (?<name>…)")
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", re.sub(r"\\[pP]\{\w+\}", r"\\w", text)))
    except re.error:
        return None
    body = rf"\A(?:{text})\z" if full else text
    return body if case_sensitive else f"(?iu){body}"


# --- one rule ------------------------------------------------------------------

#: Tests that are another test turned round.
TURNED = {"not_equals": "equals", "not_contains": "contains", "not_empty": "is_empty"}
NUMERIC_TESTS = {"num_eq": operator.eq, "num_ne": operator.ne, "num_gt": operator.gt, "num_ge": operator.ge, "num_lt": operator.lt, "num_le": operator.le}
LENGTH_TESTS = {"length_eq": operator.eq, "length_min": operator.ge, "length_max": operator.le}

@dataclass(frozen=True)
class Side:
    """One side of a test: a column of the table, or a constant."""

    df: DataFrame
    exact: bool
    name: str | None = None
    constant: Any = None

    def text(self) -> Column:
        return text_or_empty(self.df, self.name) if self.name else F.lit("" if self.constant is None else str(self.constant))

    def folded(self) -> Column:
        if self.name:
            return fold(self.text(), self.exact)
        plain = "" if self.constant is None else str(self.constant)
        return F.lit(plain if self.exact else plain.lower())

    def given(self) -> Column:
        """What must not be null for the number to be one."""
        return column(self.name) if self.name and is_numeric(self.df, self.name) else self.number()

    def number(self) -> Column | None:
        """A double, or None for a constant that is no number."""
        if self.name:
            return numeric(self.df, self.name)
        try:
            return F.lit(float(self.constant))
        except (TypeError, ValueError):
            return None


def _whole(x: Any) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def _numbers(compare, left: Side, right: Side) -> Column:
    a, b = left.number(), right.number()
    return F.lit(False) if a is None or b is None else sure(compare(a, b), *(side.given() for side in (left, right) if side.name))


def _lengths(compare, left: Side, right: Side) -> Column:
    n = _whole(right.constant)
    return F.lit(False) if n is None else compare(F.length(left.text()), F.lit(n))


def _listed(left: Side, right: Side, spec: dict[str, Any]) -> Column:
    items = [part.strip() for part in str(right.constant or "").split(",")]
    items = [part if left.exact else part.lower() for part in items if part]
    return left.folded().isin(*items) if items else F.lit(False)


def _matching(full: bool):
    def test(left: Side, right: Side, spec: dict[str, Any]) -> Column:
        pattern = _pattern(str(right.constant or ""), left.exact, full)
        return F.lit(False) if pattern is None else left.text().rlike(pattern)

    return test


def _class(name: str | None, exact: bool) -> str:
    """Unicode class of a character; upper and lower mean any letter when case is folded."""
    if not exact and name in ("upper", "lower"):
        name = "letter"
    return UNICODE.get(name or "any", ".")


def _part(left: Side, spec: dict[str, Any], one: bool) -> tuple[Column, str]:
    """The piece of the text that a positional test looks at, and how often a class must repeat to fill it."""
    if one:
        return F.substring(left.text(), _whole(spec.get("position")) or 1, 1), ""
    n = _whole(spec.get("length"))
    start = max(1, _whole(spec.get("start")) or 1)
    return F.substring(left.text(), start, 2**31 - 1 if n is None else n), "+" if n is None else f"{{{n}}}"


def _piece_equals(one: bool):
    return lambda left, right, spec: fold(_part(left, spec, one)[0], left.exact) == right.folded()


def _piece_class(one: bool):
    def test(left: Side, right: Side, spec: dict[str, Any]) -> Column:
        piece, times = _part(left, spec, one)
        return piece.rlike(rf"\A{_class(spec.get('charclass'), left.exact)}{times}\z")

    return test


#: What each test says of a value (left) and what it is held against (right).
TESTS: dict[str, Callable[[Side, Side, dict[str, Any]], Column]] = {
    "equals": lambda left, right, spec: left.folded() == right.folded(),
    "starts_with": lambda left, right, spec: left.folded().startswith(right.folded()),
    "ends_with": lambda left, right, spec: left.folded().endswith(right.folded()),
    "contains": lambda left, right, spec: left.folded().contains(right.folded()),
    "is_empty": lambda left, right, spec: left.text() == "",
    "is_in": _listed,
    "regex": _matching(False),
    "regex_full": _matching(True),
    "is_numeric": lambda left, right, spec: F.replace(F.trim(left.text()), F.lit(","), F.lit(".")).rlike(NUMBER),
    "char_equals": _piece_equals(True),
    "char_class": _piece_class(True),
    "substr_equals": _piece_equals(False),
    "substr_class": _piece_class(False),
    **{name: (lambda left, right, spec, c=compare: _numbers(c, left, right)) for name, compare in NUMERIC_TESTS.items()},
    **{name: (lambda left, right, spec, c=compare: _lengths(c, left, right)) for name, compare in LENGTH_TESTS.items()},
}


def _held_against(df: DataFrame, spec: dict[str, Any], exact: bool) -> list[Side]:
    """The other column, or one constant per entry of ``values`` that is not blank, or the single ``value``."""
    if spec.get("via") == "column":
        return [Side(df, exact, name=spec["column2"])]
    listed = spec.get("values")
    entries = [v for v in listed if v is not None and str(v).strip()] if isinstance(listed, (list, tuple)) else []
    return [Side(df, exact, constant=v) for v in entries or [spec.get("value")]]


def rule(df: DataFrame, spec: dict[str, Any], case_sensitive: bool = False, default_column: str | None = None) -> Column:
    """One rule over the columns of ``df``; a rule on an unknown column matches nothing, negated or not.

    Several ``values`` are any of them; for a turned test, none of them.
    """
    name, kind = spec.get("column") or default_column, spec.get("test")
    reads = [name, spec.get("column2")] if spec.get("via") == "column" else [name]
    if any(r not in df.columns for r in reads):
        return F.lit(False)
    test = TESTS.get(TURNED.get(kind, kind))
    if test is None:
        raise ValueError(f"unknown test {kind}")
    left = Side(df, case_sensitive, name=name)
    holds = reduce(operator.or_, [test(left, right, spec) for right in _held_against(df, spec, case_sensitive)])
    return ~holds if (kind in TURNED) != bool(spec.get("negate")) else holds


def dnf(df: DataFrame, condition: dict[str, Any] | None, case_sensitive: bool = False, default_column: str | None = None) -> Column:
    """OR of ``groups``, AND of the ``rules`` inside; empty groups are skipped and no group matches nothing."""
    groups = [g.get("rules") or [] for g in (condition or {}).get("groups") or []]
    ands = [reduce(lambda a, b: a & b, [rule(df, r, case_sensitive, default_column) for r in g]) for g in groups if g]
    return reduce(lambda a, b: a | b, ands) if ands else F.lit(False)


# --- masks -----------------------------------------------------------------------


def _one_of(value: str) -> str:
    """A class of the listed characters; none listed matches no character."""
    return "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in value) + "]" if value else "(?!)"


#: Kinds of segments: a character class, from the segment's own value where it has one.
SEGMENTS: dict[str, Callable[[str], str]] = {"set": _one_of, **{kind: (lambda _, c=cls: c) for kind, cls in ASCII.items()}}


def _repeat(segment: dict[str, Any]) -> str:
    """Exactly ``length`` times, or ``min`` to ``max`` times, or once."""
    given = {k: int(segment[k]) for k in ("length", "min", "max") if segment.get(k) not in (None, "")}
    if "length" in given:
        return f"{{{given['length']}}}"
    return f"{{{given.get('min', 0)},{given.get('max', '')}}}" if given else ""


def _segment_pattern(segment: dict[str, Any]) -> str:
    kind, value = segment.get("type") or "any", segment.get("value") or ""
    return quoted(value) if kind == "literal" else SEGMENTS.get(kind, SEGMENTS["any"])(value) + _repeat(segment)


def mask_pattern(segments: Sequence[dict[str, Any]]) -> str:
    """Segments (literal, set, letter, upper, lower, digit, alnum, any; length, or min and max) as one pattern."""
    return "".join(map(_segment_pattern, segments))


def mask(df: DataFrame, name: str, segments: Sequence[dict[str, Any]], case_sensitive: bool = False) -> Column:
    """Does the whole text follow the mask?  No segments: it must be empty."""
    if name not in df.columns:
        return F.lit(False)
    text = text_or_empty(df, name)
    if not segments:
        return text == ""
    return text.rlike(rf"{'' if case_sensitive else '(?i)'}\A(?:{mask_pattern(segments)})\z")


def condition(df: DataFrame, spec: dict[str, Any], case_sensitive: bool = False, default_column: str | None = None) -> Column:
    """A named row condition: kind ``rules`` or ``mask``, on its own column or the default.

    Conditions over groups of rows need an aggregate; ``operators.checks`` adds
    their verdict as a column.
    """
    own = spec.get("column") or default_column
    kind = spec.get("kind") or "rules"
    if kind == "mask":
        return mask(df, own or "", spec.get("segments") or [], case_sensitive) if own else F.lit(False)
    if kind == "rules":
        return dnf(df, spec.get("condition") or spec, case_sensitive, own)
    raise ValueError(f"a condition of kind {kind} is not a row condition")


# --- why a row fails ---------------------------------------------------------


def _label(r: dict[str, Any], default_column: str | None) -> str:
    if r.get("label"):
        return str(r["label"])
    against = r.get("column2") if r.get("via") == "column" else ", ".join(map(str, r["values"])) if r.get("values") else r.get("value")
    words = ["not" if r.get("negate") else "", r.get("column") or default_column or "", r.get("test") or "", "" if against is None else str(against)]
    return " ".join(w for w in words if w)


def _failures(df: DataFrame, spec: dict[str, Any], case_sensitive: bool, default_column: str | None) -> list[tuple[str, Column]]:
    """Labels of rules, or of mask segments, with the Column that is true where they fail."""
    own = spec.get("column") or default_column
    if (spec.get("kind") or "rules") == "mask":
        segments = spec.get("segments") or []
        text, flag = text_or_empty(df, own), "" if case_sensitive else "(?i)"
        reach = [text.rlike(rf"{flag}\A(?:{mask_pattern(segments[: k + 1])})") for k in range(len(segments))]
        out = [
            (f"segment {k + 1}: {s.get('type') or 'any'}{' ' + str(s['value']) if s.get('value') else ''}", ~ok & (reach[k - 1] if k else F.lit(True)))
            for k, (s, ok) in enumerate(zip(segments, reach))
        ]
        full = mask(df, own, segments, case_sensitive)
        return [*out, ("extra characters", (reach[-1] if reach else F.lit(True)) & ~full)]
    groups = (spec.get("condition") or spec).get("groups") or []
    return [(_label(r, own), ~rule(df, r, case_sensitive, own)) for g in groups for r in g.get("rules") or []]


def with_failure_reason(df: DataFrame, spec: dict[str, Any], case_sensitive: bool = False, default_column: str | None = None) -> DataFrame:
    """Add ``motif`` (first failing label, null where the condition holds) and ``failed_rules``."""
    holds = condition(df, spec, case_sensitive, default_column)
    marks = [F.when(c, F.lit(name)) for name, c in _failures(df, spec, case_sensitive, default_column)]
    failed = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    out = df.withColumn("failed_rules", F.when(holds, F.array().cast("array<string>")).otherwise(failed))
    return out.withColumn("motif", F.when(F.size("failed_rules") > 0, F.get("failed_rules", F.lit(0))))


def rule_failure_counts(df: DataFrame, spec: dict[str, Any], case_sensitive: bool = False, default_column: str | None = None) -> DataFrame:
    """``(label, failed)`` for every rule, from one aggregate."""
    marks = _failures(df, spec, case_sensitive, default_column)
    one = df.agg(*[F.count_if(c).alias(f"_{k}") for k, (_, c) in enumerate(marks)])
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("label"), F.col(f"_{k}").alias("failed")) for k, (name, _) in enumerate(marks)])
    return one.select(F.inline(rows))
