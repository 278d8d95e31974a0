r"""Secret scans: fixed patterns, and Markov models of random strings against identifiers.

The fixed patterns give the base spans (kinds assign, access and hex).  The
method adds spans of kind markov: runs of 16 or more key characters that do not
touch a base span and whose character pairs are likelier under a model of
random strings than under one of ordinary identifiers.  Both models are counted
over all documents: what the base patterns found is random, other long runs
that do not mix letters and digits are ordinary words, names or numbers (a random
string of that length nearly always mixes them).

Everything is a native expression.  Positions come from splitting the text at
the matches and adding up lengths; positions are code points, ends exclusive.

Edge cases: null and empty texts have no spans and the hash of the empty
string; a corpus without labelled samples adds no spans; duplicated rows each
get a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, need, or_empty

#: Fixed patterns of the base kinds; the hex and access forms hold their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BLOCK = 128


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it; sums of blocks keep long arrays from costing their square."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n = F.size(lengths)
    places = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    blocks = F.transform(places, lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    starts = _let(blocks, lambda sums: F.transform(places, lambda b: total(F.slice(sums, F.lit(1), b))))
    within = lambda i: total(F.slice(lengths, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK).cast("int")))
    return _let(starts, lambda at: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(at, F.floor(i / BLOCK).cast("int")) + within(i)))


SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def with_spans(rows: DataFrame, name: str, text: str, pattern: str, kind: int, least: int = 0, group: int = 0) -> DataFrame:
    """Add the spans of the leftmost matches that do not overlap; ``least`` is on the length of ``group``.

    Each step is a column of its own, so that no pattern runs twice on a text.
    """
    p = F.lit(pattern)
    length = lambda a: F.transform(a, lambda x: F.length(x))
    none = F.array().cast("array<int>")
    some = F.size("_found") > 0
    rows = rows.withColumn("_found", F.when(F.col(text).rlike(pattern), F.regexp_extract_all(F.col(text), p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_value", F.when(some, F.regexp_extract_all(F.col(text), p, F.lit(group))).otherwise(F.col("_found")) if group else F.col("_found"))
    rows = rows.withColumn("_gap", F.when(some, length(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size("_found")))).otherwise(none))
    rows = rows.withColumn("_sum", F.zip_with("_gap", length(F.col("_found")), lambda a, b: a + b))
    rows = rows.withColumn("_start", F.when(some, F.zip_with(_before(F.col("_sum")), F.col("_gap"), lambda a, b: a + b)).otherwise(none))
    spans = F.transform(
        F.arrays_zip(F.col("_start").alias("s"), F.col("_found").alias("f"), F.col("_value").alias("v")),
        lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["f"])).alias("end"), x["v"].alias("text")),
    )
    if least:
        spans = F.filter(spans, lambda x: F.length(x["text"]) >= least)
    return rows.withColumn(name, spans.cast(SPAN)).drop("_found", "_value", "_gap", "_sum", "_start")


def with_base_spans(rows: DataFrame, name: str, text: str) -> DataFrame:
    rows = with_spans(rows, "_assign", text, ASSIGN, 0, least=6, group=2)
    rows = with_spans(with_spans(rows, "_access", text, ACCESS, 1), "_hex", text, HEX, 2)
    return rows.withColumn(name, F.concat("_assign", "_access", "_hex")).drop("_assign", "_access", "_hex")


def _below(places: Column, limit: Column) -> Column:
    """How many of the sorted ``places`` are below the limit, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step.cast("long") <= F.size(places)) & (F.get(places, at + step - 1) < limit), at + step).otherwise(at))


def _clear(runs: Column, base: Column, good) -> Column:
    """The runs that are ``good`` and touch no base span: as many spans start before the run's end as end before its start."""
    ends = F.struct(F.array_sort(F.transform(base, lambda b: b["start"])).alias("starts"), F.array_sort(F.transform(base, lambda b: b["end"])).alias("ends"))
    return _let(ends, lambda e: F.filter(runs, lambda x: good(x) & (_below(e["starts"], x["end"]) == _below(e["ends"], x["start"] + 1))))


def pair_scores(docs: DataFrame, text_col: str) -> dict[str, float] | None:
    """Log-likelihood ratio of each character pair of a table, random over ordinary."""
    return _scores_of(_spans_found(docs.select(or_empty(text_col).alias("text"))))


def _spans_found(rows: DataFrame) -> DataFrame:
    """The base spans and the runs of ``text``, which itself is not needed any more; every pattern runs once on a text."""
    return with_spans(with_base_spans(rows, "base", "text"), "run", "text", RUN, 3).drop("text")


def _scores_of(picked: DataFrame) -> dict[str, float] | None:
    """Scores from the spans of all documents; pairs are combined before the shuffle, and the counts that come back are bounded by the square of the alphabet."""
    sample = lambda c, r: F.transform(c, lambda x: F.struct(F.lit(r).alias("random"), x["text"].alias("s")))
    ordinary = _clear(F.col("run"), F.col("base"), lambda x: ~(x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]")))
    both = picked.select(F.explode(F.concat(sample(F.col("base"), 1), sample(ordinary, 0))).alias("x")).select("x.*")
    cs = both.where("length(s) > 1").select("random", F.split("s", "").alias("c"))
    pairs = cs.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = pairs.groupBy("random", "pair").count().collect()
    per: dict[int, dict[str, int]] = {0: defaultdict(int), 1: defaultdict(int)}
    for r in counts:
        if all(c in ALPHABET for c in r["pair"]):
            per[r["random"]][r["pair"]] += r["count"]
    if not per[0] or not per[1]:
        return None

    def model(c: dict[str, int]) -> dict[str, float]:
        first, second, n = defaultdict(int), defaultdict(int), sum(c.values())
        for k, v in c.items():
            first[k[0]] += v
            second[k[1]] += v
        one = {b: (second[b] + 1) / (n + len(ALPHABET)) for b in ALPHABET}
        return {a + b: math.log((c.get(a + b, 0) + 20 * one[b]) / (first[a] + 20)) for a in ALPHABET for b in ALPHABET}

    random, ordinary = model(per[1]), model(per[0])
    return {k: random[k] - ordinary[k] for k in random}


def markov_spans(runs: Column, base: Column, scores: dict[str, float], least_total: float, least_mean: float) -> Column:
    """Runs away from base spans whose score reaches both limits."""
    width = 128
    flat = ["0"] * (width * width)
    for k, v in scores.items():
        flat[ord(k[0]) * width + ord(k[1])] = f"{v:.4f}"
    lookup = F.split(F.lit(",".join(flat)), ",").cast("array<double>")
    pair = lambda before, ch: F.coalesce(F.get(lookup, before * width + F.ascii(ch)), F.lit(0.0))
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))  # no pair is looked up under a place below zero
    step = lambda a, ch: F.struct(F.ascii(ch).alias("before"), (a["sum"] + pair(a["before"], ch)).alias("sum"))

    def likely(x: Column) -> Column:
        score = F.aggregate(F.split(x["text"], ""), start, step, lambda a: a["sum"])
        return _let(score, lambda v: (v >= least_total) & (v / (F.length(x["text"]) - 1) >= least_mean))

    return _clear(runs, base, likely)


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_total: float = 12.0, least_mean: float = 0.6
) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_markov, base, spans)`` of every whole text.

    ``base`` and ``spans`` list ``kind:start:end`` by start, then kind.
    """
    need(docs, id_col, text_col)
    rows = cut(_spans_found(docs.select(F.col(id_col).cast("long").alias("doc_id"), or_empty(text_col).alias("text")))).withColumnsRenamed({"base": "b", "run": "r"})
    scores = _scores_of(rows.select(F.col("b").alias("base"), F.col("r").alias("run")))
    if scores:
        rows = rows.withColumn("m", markov_spans(F.col("r"), F.col("b"), scores, least_total, least_mean))
    else:
        rows = rows.withColumn("m", F.array().cast(SPAN))
    n = lambda c, k: F.size(F.filter(F.col(c), lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *[n("b", k).alias(f"n_{KINDS[k]}") for k in range(3)], n("m", 3).alias("n_markov"), _listed(F.col("b")).alias("base"), _listed(F.concat("b", "m")).alias("spans")
    )
