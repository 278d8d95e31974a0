"""The Merkle manifest against a plain tree, over several records deep and wide, and its SQL against the edge cases."""

import hashlib
import zlib

import pytest


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(digests):
    """All levels, and the siblings of every bottom digest as (before, after) from the bottom up."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for at in range(len(digests)):
        path = []
        for level in levels[:-1]:
            s = at // 3 * 3
            path.append((level[s:at], level[at + 1 : s + 3]))
            at //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    sources = {}
    for i, text, lang, source, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        fields = [i, source, lang, n]
        other = leaf([*fields, text.replace("\n", "") if hit and text is not None else text])
        sources.setdefault(source, []).append((i is not None, i or 0, leaf([*fields, text]), other, i))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[2] for x in sorted(sources[s])]) for s in names}
    root, above = tree([built[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (_, _, own, other, i), path in zip(sorted(sources[s]), built[s][1]):
            steps = path + up
            folded = other
            for before, after in steps:
                folded = h(*before, folded, *after)
            out.append((i, own, built[s][0], root, h(*[x for b, a in steps for x in b + a]), folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def proofs(df):
    from gristmill.llm.merkle import merkle_proofs, without_line_breaks

    return sorted((tuple(r) for r in merkle_proofs(df, tampered=without_line_breaks(df)).select(*COLUMNS).collect()), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_several_records_deep(spark):
    rows = [(i * 7 % 2003, f"text {i}\n" * (i % 4), "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 5}", i) for i in range(2003)]
    got = proofs(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert got == plain(rows) and not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_more_sources_than_a_record_holds(spark):
    rows = [(i, f"a\n{i}", "en", f"source {i % 300}", 3) for i in range(700)]
    assert proofs(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_three_records_deep(spark):
    """One source holds all rows, more than two records reach: the root of its last stretch has runs of one."""
    rows = [(i, "a\nb", "en", "s", i) for i in range(3**10 + 1)]
    from pyspark.sql import functions as F

    df = spark.range(len(rows)).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    assert proofs(df) == plain(rows)


@pytest.mark.parametrize("rows", [
    [(1, "only\nrow", "en", "s", 8)],
    [(2, "a\nb", "en", None, 3), (None, "x\n", "en", None, 2), (None, "y", None, None, None), (2, "other", "en", None, 5)],
    [(5, "copy\n", "en", "s", 5)] * 30 + [(6, "", "en", "", 0), (7, None, "en", "é", None), (8, "long " * 40_000 + "\n", None, "Z", 9)],
])
def test_edges(spark, rows):
    assert proofs(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb", "en", "s", 3), (2, "b", "en", "t", 1)], SCHEMA)
    assert proofs(df.where("false")) == []
    from pyspark.sql import functions as F

    more = df.select("*", *[F.lit("x").alias(n) for n in ("tree", "rank", "size", "leaf", "id", "tampered", "digest", "path", "_place_mid")])
    assert proofs(more) == proofs(df) == plain([(1, "a\nb", "en", "s", 3), (2, "b", "en", "t", 1)])
