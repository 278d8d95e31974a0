"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 and 1 and
normalised again.  The exponent is bisected: the largest one that reaches the
target entropy, raised where a source would repeat more often than allowed.
The weights become token quotas of a budget.  A source is then dealt in blocks,
each block one permutation of all its documents; the last block stops where
the quota is used up.

The last block's end is found with token sums of hash buckets, finer and finer
until a bucket holds few rows, and one window over the bucket in which the quota
ends, in which equal rows are one with a count, so a source or a document with a third
of all rows never meets in one task.  Where the quota ends among equal rows, so many
of them are dealt as fit.  Only scalars come to the driver.

Tokens are runs of characters other than ASCII white space, or what a column of
counts says (``tokens_col``, for instance the counts of a tokenizer).

Edge cases: null source is a source of its own; texts without a visible character
and null counts count one token; a table with one source has weight 1; rows that repeat an id are
separate documents, also if they are equal; a row with a null id is ordered by a hash of its text; an empty table gives no rows; extra columns pass through (``epoch``,
``order_key`` and ``n_tokens`` are replaced; ``_mix_`` is a reserved beginning).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.llm.common import checked_broadcast, cut, need
from gristmill.operators.places import with_place

DEPTH = 32  # halvings of the exponent


#: Rows of a bucket in which the end of a block is looked for row by row, and hash digits of one step towards it.
BUCKET_ROWS, STEP_DIGITS = 1000, 3


def token_size(text_col: str = "text", tokens_col: str | None = None) -> Column:
    """Words of a text between white space, or the given count; at least one."""
    n = F.col(tokens_col).cast("long") if tokens_col else F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.coalesce(n, F.lit(1).cast("long")))


def order_key(epoch: Column, ident: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))))


def choose_exponent(sources: DataFrame, entropy_share: float | None, repetition_limit: float | None, cover: bool) -> float:
    """Bisect the exponent over ``sources`` (``_mix_source, tokens``); one scalar comes back for each halving step.

    ``entropy_share`` places the target between the entropy of the plain shares
    (0) and that of equal weights (1).
    """
    shares = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    t, n = shares["t"], shares["n"]
    if not n or n == 1 or (entropy_share is None and repetition_limit is None):
        return 1.0
    p = F.col("tokens") / F.lit(float(t))
    grid = 16

    def measure(low: int, step: int) -> list[tuple[float, float]]:
        """Entropy and largest repetition at the inner points of a grid of 16."""
        a = (F.lit(float(low)) + F.col("k") * F.lit(float(step))) / F.lit(float(1 << DEPTH))
        rows = sources.select(F.log(p).alias("lp"), F.explode(F.sequence(F.lit(1), F.lit(grid - 1))).alias("k")).withColumn("a", a)
        rows = rows.groupBy("k").agg(
            F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"),
            F.sum(F.exp(F.col("a") * F.col("lp")) * F.col("a") * F.col("lp")).alias("s"),
            F.min(F.exp((F.col("a") - 1) * F.col("lp"))).alias("least"),
            F.max(F.exp((F.col("a") - 1) * F.col("lp"))).alias("most"),
        )
        rows = rows.select("k", (F.log("z") - F.col("s") / F.col("z")).alias("h"), (F.col("most") / (F.col("least") if cover else F.col("z"))).alias("r"))
        return [(r["h"], r["r"]) for r in sorted(rows.collect(), key=lambda r: r["k"])]

    def bisect(holds) -> int:
        """The largest grid point at which ``holds``, which is true at 0 and false from some point on."""
        low, step = 0, 1 << DEPTH
        while step > 1:
            step //= grid
            got = measure(low, step)
            low += step * sum(1 for x in got if holds(x))
        return low

    exponent = 0
    if entropy_share is not None:
        plain = sources.agg(F.sum(-p * F.log(p)).alias("h")).first()["h"]
        target = plain + entropy_share * (math.log(n) - plain)
        exponent = bisect(lambda x: x[0] >= target)
    if repetition_limit is not None:
        low = bisect(lambda x: x[1] > repetition_limit)
        exponent = max(exponent, low + 1 if low else 0)
    return exponent / (1 << DEPTH)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget_tokens: int | None = None,
    entropy_share: float | None = 0.5,
    repetition_limit: float | None = 4.0,
    cover: bool = False,
    seed: int = 7,
    tokens_col: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` dealt to the mixed weights, plus ``epoch``, ``order_key`` and ``n_tokens``.

    A document comes once for each block it is in; ``epoch`` counts the blocks
    of its source and ``order_key`` orders a block.  The budget is the tokens of
    the whole input unless given.  ``cover`` sets the budget so that the source
    repeated least is dealt exactly once, so that no document is left out.
    """
    need(docs, id_col, source_col, text_col, *([tokens_col] if tokens_col else []))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_mix_source")
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("?"), F.xxhash64(text_col).cast("string")))
    slim = cut(docs.select(ident.alias("id"), source, token_size(text_col, tokens_col).alias("tokens")))
    sources = cut(slim.groupBy("_mix_source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    exponent = choose_exponent(sources, entropy_share, repetition_limit, cover)
    t = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(t))))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    if cover:
        ratio = sources.agg(F.max(F.col("tokens") / weight)).first()[0] or 1.0
        quota = F.greatest(F.col("tokens"), F.round(weight * F.lit(ratio)))
    else:
        quota = F.round(weight * F.lit(float(budget_tokens if budget_tokens is not None else t)))
    plan = sources.select("_mix_source", "tokens", weight.alias("weight"), quota.cast("long").alias("quota"))
    plan = plan.withColumn("blocks", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens"))
    plan = cut(plan)
    small = checked_broadcast(plan.select("_mix_source", "blocks", "rest"))

    # where the last block of each source ends: the bucket of hash digits in which the quota is used up, refined step by step
    last = slim.join(small, "_mix_source").where("rest > 0").select("_mix_source", "id", "tokens", order_key(F.col("blocks"), F.col("id"), seed).alias("key"))
    largest = sources.agg(F.max("rows")).first()[0] or 0
    steps = max(1, math.ceil(math.log(max(2, largest) / bucket_rows, 16**STEP_DIGITS)))
    ends = plan.where("rest > 0").select("_mix_source", "rest", F.lit("").alias("end"), F.lit(0).cast("long").alias("before"))
    for step in range(1, steps + 1):
        inside = last.join(checked_broadcast(ends), "_mix_source").where(F.col("key").startswith(F.col("end")))
        sums = inside.groupBy("_mix_source", F.substring("key", 1, step * STEP_DIGITS).alias("bucket")).agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        upto = F.col("before") + F.sum("n").over(W.partitionBy("_mix_source").orderBy("bucket"))
        ends = cut(sums.withColumn("upto", upto).where("upto > rest and upto - n <= rest").select("_mix_source", "rest", F.col("bucket").alias("end"), (F.col("upto") - F.col("n")).alias("before")))
    digits = steps * STEP_DIGITS
    within = last.join(checked_broadcast(ends), "_mix_source").where(F.col("key").startswith(F.col("end")))
    equal = within.groupBy("_mix_source", "key", "id", "tokens").agg(F.count("*").alias("n"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    upto = F.sum(F.col("n") * F.col("tokens")).over(W.partitionBy("_mix_source").orderBy("key", "id", "tokens").rowsBetween(W.unboundedPreceding, 0))
    equal = equal.withColumn("upto", F.col("before") + upto).withColumn("fit", F.expr("least(n, (rest - (upto - n * tokens)) div tokens)")).where("fit > 0")
    cuts = equal.groupBy("_mix_source").agg(F.max(F.struct("key", "id", "tokens", "fit", "n")).alias("cut"))
    ends = ends.select("_mix_source", "end").join(cuts, "_mix_source", "left")
    dealt = cut(plan.select("_mix_source", "blocks", "rest").join(ends, "_mix_source", "left"))

    names = {c: f"_mix_{c}" for c in ("blocks", "rest", "end", "cut")}
    rows = docs.withColumn("_mix_source", source).join(checked_broadcast(dealt.withColumnsRenamed(names)), "_mix_source")
    rows = rows.withColumn("n_tokens", token_size(text_col, tokens_col)).withColumn("_mix_id", ident)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_blocks"))))
    rows = rows.withColumn("order_key", order_key(F.col("epoch"), F.col("_mix_id"), seed))
    bucket = F.substring("order_key", 1, digits)
    own, end = F.struct(F.col("order_key").alias("key"), F.col("_mix_id").alias("id"), F.col("n_tokens").alias("tokens")), F.struct("_mix_cut.key", "_mix_cut.id", "_mix_cut.tokens")
    last_one = (F.col("epoch") == F.col("_mix_blocks")) & (F.col("_mix_rest") > 0) & (own == end)
    inside = (bucket < F.col("_mix_end")) | ((bucket == F.col("_mix_end")) & F.col("_mix_cut").isNotNull() & ((own < end) | ((own == end) & F.col("_mix_cut.fit").eqNullSafe(F.col("_mix_cut.n")))))
    kept = rows.where((F.col("epoch") < F.col("_mix_blocks")) | ((F.col("_mix_rest") > 0) & F.coalesce(inside, F.lit(False))))
    if not dealt.where("cut.fit < cut.n").isEmpty():
        # the quota of some source ends among equal rows: so many of them as fit, by their place
        split = rows.where(F.coalesce(last_one & (F.col("_mix_cut.fit") < F.col("_mix_cut.n")), F.lit(False)))
        split = with_place(split, ["_mix_source"], [F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith("map")]).asc()], "_mix_place")
        kept = kept.unionByName(split.where("_mix_place < _mix_cut.fit").drop("_mix_place"))
    return kept.drop("_mix_source", "_mix_id", *names.values())
