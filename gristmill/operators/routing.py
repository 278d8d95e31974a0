"""Routing rows to outputs by condition or by an extracted key.

Routing tags rows with one column; the outputs are filters on it, and a sink
can be written with ``partitionBy("route")`` in one pass.  Routing by row rules
also works on streaming rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.rules import condition, dnf
from gristmill.functions.xl import quoted
from gristmill.operators.checks import group_verdicts
from gristmill.values import as_text, column, fold, require, text_or_empty


def with_conditions(df: DataFrame, conditions: Sequence[dict[str, Any]], case_sensitive: bool = False, default_column: str | None = None) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """Each named condition once, as a Column; group conditions with the same keys share one aggregate."""
    masks: dict[str, Column] = {}
    by_keys: dict[tuple[str, ...], dict[str, Any]] = {}
    for k, c in enumerate(conditions):
        ident = str(c.get("id") or k)
        if c.get("kind") == "group":
            by_keys.setdefault(tuple(c.get("group_by") or ()), {})[f"_cond_{k}"] = c.get("checks") or []
            masks[ident] = F.col(f"_cond_{k}")
        else:
            masks[ident] = condition(df, c, case_sensitive, default_column)
    out, helpers = df, []
    for keys, lists in by_keys.items():
        out = group_verdicts(out, keys, lists, case_sensitive)
        helpers += lists
    return out, masks, helpers


def _matches(df: DataFrame, outputs: Sequence[dict[str, Any]], masks: dict[str, Column], case_sensitive: bool, default_column: str | None) -> list[tuple[str, Column]]:
    got = []
    for k, o in enumerate(outputs):
        match = o.get("match") or {}
        ident = match.get("condition")
        if ident is not None:
            if str(ident) not in masks:
                raise ValueError(f"output {o.get('id', k)}: unknown condition {ident}")
            m = masks[str(ident)]
        else:
            m = dnf(df, match, case_sensitive, default_column)
        got.append((str(o.get("id") or k), ~m if match.get("negate") else m))
    return got


def route(
    df: DataFrame, outputs: Sequence[dict[str, Any]], conditions: Sequence[dict[str, Any]] = (), mode: str = "first",
    target_column: str | None = None, case_sensitive: bool = False, else_output: bool = True,
) -> DataFrame:
    """Add ``route``: the first output that matches, or in mode ``all`` one row per matching output.

    Rows that match none go to ``else``, or have a null route without an else
    output.  An output is ``{id, match: {condition, negate}}`` with the id of a
    condition, or ``{id, match: {groups, negate}}`` with its rules inline.
    """
    rows, masks, helpers = with_conditions(df, conditions, case_sensitive, target_column)
    found = _matches(df, outputs, masks, case_sensitive, target_column)
    rest = F.lit("else" if else_output else None).cast("string")
    if mode == "first":
        tag = rest
        for ident, m in reversed(found):
            tag = F.when(m, F.lit(ident)).otherwise(tag)
        return rows.withColumn("route", tag).drop(*helpers)
    if mode != "all":
        raise ValueError("mode is first or all")
    tags = F.array_compact(F.array(*[F.when(m, F.lit(ident)) for ident, m in found])) if found else F.array().cast("array<string>")
    return rows.withColumn("route", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(rest)))).drop(*helpers)


def outputs_of(routed: DataFrame, ids: Sequence[str]) -> dict[str, DataFrame]:
    """The routed rows of each output, without the tag."""
    return {i: routed.where(F.col("route") == i).drop("route") for i in ids}


def route_counts(routed: DataFrame) -> DataFrame:
    """Rows per route; a null route counts rows that went nowhere."""
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("rows"))


def with_flag(df: DataFrame, spec: dict[str, Any], name: str = "valide", case_sensitive: bool = False, default_column: str | None = None) -> DataFrame:
    """Add oui or non for a condition; a control keeps ``oui`` rows as valid and the others as invalid."""
    rows, masks, helpers = with_conditions(df, [spec | {"id": "flag"}], case_sensitive, default_column)
    return rows.withColumn(name, F.when(masks["flag"], "oui").otherwise("non")).drop(*helpers)


def control(df: DataFrame, spec: dict[str, Any], case_sensitive: bool = False, default_column: str | None = None) -> dict[str, DataFrame]:
    """``valid`` and ``invalid`` rows of a conformity control."""
    flagged = with_flag(df, spec, "_flag", case_sensitive, default_column)
    return {"valid": flagged.where("_flag = 'oui'").drop("_flag"), "invalid": flagged.where("_flag = 'non'").drop("_flag")}


def legacy_condition(config: dict[str, Any]) -> dict[str, Any]:
    """The older control form, ``mode`` rules (combine all or any) or mask on one column, as a condition."""
    if config.get("mode") == "mask":
        return {"kind": "mask", "column": config.get("column"), "segments": config.get("segments") or []}
    rules = [{**r, "column": r.get("column") or config.get("column")} for r in config.get("rules") or []]
    any_of = config.get("combine") == "any"
    return {"kind": "rules", "groups": [{"rules": [r]} for r in rules] if any_of else [{"rules": rules}]}


# --- routing by an extracted key ----------------------------------------------


def _whole_number(spec: dict[str, Any], name: str, default: int | None, least: int | None = None) -> int | None:
    """A setting as a whole number; blank is the default, anything unusable is an error."""
    given = spec.get(name)
    if given in (None, ""):
        return default
    try:
        n = int(given)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name} of an extractor is a whole number, not {given!r}") from e
    if n == 0 or (least is not None and n < least):
        raise ValueError(f"{name} of an extractor cannot be {n}")
    return n


def _after_last(s: Column, sep: str) -> Column:
    return F.when(s.contains(sep), F.substring_index(s, sep, -1)).otherwise("") if sep else s


def _segment(s: Column, spec: dict[str, Any]) -> Column:
    parts = F.split(s, quoted(spec.get("sep") or "\\"), -1)
    return F.coalesce(F.try_element_at(parts, F.lit(_whole_number(spec, "index", 1))), F.lit(""))


def _substring(s: Column, spec: dict[str, Any]) -> Column:
    rest = F.substr(s, F.lit(_whole_number(spec, "start", 1, least=1)))
    size = _whole_number(spec, "length", None, least=1)
    return rest if size is None else F.left(rest, F.lit(size))


def _first_group(s: Column, spec: dict[str, Any]) -> Column:
    try:
        groups = re.compile(spec.get("pattern") or "").groups
    except re.error:
        return F.lit("")  # a pattern that cannot match
    return F.regexp_extract(s, spec.get("pattern") or "", min(groups, 1))


#: Extractors by name: the text and the settings in, the key out.
EXTRACTORS = {
    "whole": lambda s, spec: s,
    "after_last": lambda s, spec: _after_last(s, spec.get("sep", ".")),
    "before_first": lambda s, spec: F.substring_index(s, spec.get("sep", "_"), 1) if spec.get("sep", "_") else s,
    "segment": _segment,
    "substring": _substring,
    "regex": _first_group,
}


def extract_key(df: DataFrame, name: str, extractor: dict[str, Any], case_sensitive: bool = False) -> Column:
    """The part of a value to route by; empty where there is none."""
    require(df, [name])
    kind = extractor.get("type", "after_last")
    if kind not in EXTRACTORS:
        raise ValueError(f"unknown extractor {kind}")
    return fold(EXTRACTORS[kind](text_or_empty(df, name), extractor), case_sensitive)


def split_by(
    df: DataFrame, name: str, extractor: dict[str, Any], values: dict[str, str] | Sequence[str], case_sensitive: bool = False, else_output: bool = True
) -> DataFrame:
    """Add ``route`` by the extracted key: an output per listed value, the rest to ``else``."""
    listed = values if isinstance(values, dict) else {str(v): str(v) for v in values}
    key = extract_key(df, name, extractor, case_sensitive)
    tag = F.lit("else" if else_output else None).cast("string")
    for v, ident in reversed(list(listed.items())):
        tag = F.when(key == (v if case_sensitive else v.lower()), F.lit(ident)).otherwise(tag)
    return df.withColumn("route", tag)


def key_scan(df: DataFrame, name: str, extractor: dict[str, Any], case_sensitive: bool = False, cap: int = 200) -> DataFrame:
    """Distinct keys by falling count: key, rows, an example value, the number of keys, and whether the cap cut the list."""
    rows = df.select(extract_key(df, name, extractor, case_sensitive).alias("key"), as_text(df, name).alias("raw"))
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("raw").alias("example"))
    total = per.agg(F.count(F.lit(1)).alias("n_keys"))
    top = per.orderBy(F.desc("rows"), "key").limit(cap)
    return top.crossJoin(total).withColumn("truncated", F.col("n_keys") > cap)


def key_samples(df: DataFrame, name: str, extractor: dict[str, Any], case_sensitive: bool = False, n: int = 5) -> DataFrame:
    """Up to ``n`` raw values, smallest first, with the key each one gives."""
    rows = df.where(column(name).isNotNull()).select(as_text(df, name).alias("raw"), extract_key(df, name, extractor, case_sensitive).alias("key"))
    return rows.distinct().orderBy("raw").limit(n)
