"""Merkle manifest of a dataset, with an inclusion proof for every row.

A row is a leaf: the SHA-256 of its fields.  The leaves of a source, by id, are
hashed in runs of three until one digest is left, the subroot; the subroots, by
source, give the root in the same way.

The digests form a content-addressed graph: a record is stored under a digest
and holds its children, and theirs, down ``STRIDE`` levels, so a record has at
most 3 ** ``STRIDE`` digests at its bottom.  A leaf asks for its proof by
descending from the root: the digits of its rank in base three choose a child at
each level, the children not chosen are collected, and the segments of the path
are turned round at the end.  Leaves whose ranks begin with the same digits
descend together, as one row of the frontier, and part at the last record.

Ranks come from range partitions and a carry between them, so a source with a
third of all rows is never ordered in one task.

Edge cases: a null field is hashed as ``-`` and an empty text as ``0:``; a null
source is a source of its own and comes first; null ids come first within their
source and are never tampered with; rows that share an id are ordered by their
leaf, and repeated rows are equal leaves beside each other; a source of one row
has its leaf as subroot, a table of one source its subroot as root; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, need
from gristmill.operators.places import with_place

FANOUT, STRIDE = 3, 5
WIDTH = FANOUT**STRIDE
RECORD = "tree string, rank long, size long, top string, levels array<array<string>>"
FRONTIER = "tree string, rank long, subroot string, root string, digest string, path array<string>"


def digest(inputs: list[str]) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


# --- records -------------------------------------------------------------------


def climb(below: list[str], whole: bool) -> list[list[str]]:
    """The levels over a stretch of digests: up to a single one if the stretch is a whole tree, else exactly ``STRIDE`` levels."""
    levels = [below]
    while len(levels[-1]) > 1 if whole else len(levels) <= STRIDE:
        last = levels[-1]
        levels.append([digest(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return levels


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
        size, below = batch.column("size").to_pylist(), batch.column("below").to_pylist()
        levels = [climb(b, n <= WIDTH) for n, b in zip(size, below)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("rank"), pa.array([-(-n // WIDTH) for n in size], pa.int64()), pa.array([x[-1][0] for x in levels], pa.string()),
             pa.array(levels, pa.list_(pa.list_(pa.string())))], ["tree", "rank", "size", "top", "levels"],
        )


def build(stretches: DataFrame, largest: int) -> list[DataFrame]:
    """Records from the bottom up, a table for each ``STRIDE`` levels; ``stretches`` is ``(tree, rank, size, below)``.

    ``size`` is the number of digests of the tree at this level, ``largest`` the
    size of the largest tree.
    """
    tables = []
    while True:
        tables.append(cut(stretches.mapInArrow(_store, RECORD)))
        largest = -(-largest // WIDTH)
        if largest <= 1:
            return tables
        up = tables[-1].where("size > 1").groupBy("tree", F.floor(F.col("rank") / WIDTH).alias("rank"))
        stretches = up.agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), "top"))).alias("b")).select("tree", "rank", "size", F.col("b.top").alias("below"))


# --- descent -------------------------------------------------------------------


def segment(levels: list[list[str]], at: int) -> list[str]:
    """From the top of a record down to its bottom digest ``at``: at each level the digit chosen and the children not chosen."""
    out = []
    for depth in range(len(levels) - 2, -1, -1):
        child = at // FANOUT**depth
        first = child // FANOUT * FANOUT
        run = levels[depth][first : first + FANOUT]
        out.append(str(child - first) + "".join(run[: child - first] + run[child - first + 1 :]))
    return out


def fold(leaf: str, steps: list[str]) -> str:
    """The root that follows from a leaf and its steps, the lowest first."""
    for step in steps:
        cut_at = 1 + 64 * int(step[0])
        leaf = sha256((step[1:cut_at] + leaf + step[cut_at:]).encode()).hexdigest()
    return leaf


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as Python values, a few at a time: a row holds a whole record."""
    for at in range(0, batch.num_rows, 8):
        yield from batch.slice(at, 8).to_pylist()


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frontier one record further down."""
    names = ["tree", "rank", "subroot", "root", "digest", "path"]
    for batch in batches:
        for row in _rows(batch):
            bottom = row["levels"][0]
            yield pa.RecordBatch.from_pylist(
                [{"tree": row["tree"], "rank": row["rank"] * WIDTH + i, "subroot": row["subroot"], "root": row["root"], "digest": d, "path": row["path"] + segment(row["levels"], i)}
                 for i, d in enumerate(bottom)], pa.schema([(n, pa.int64() if n == "rank" else pa.list_(pa.string()) if n == "path" else pa.string()) for n in names]),
            )


def _same_tree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on tree and rank; the null source is a tree too."""
    b = b.withColumnsRenamed({"tree": "_tree", "rank": "_rank"})
    return a.join(b, (F.col("rank") == F.col("_rank")) & F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree", "_rank")


def _looked_up(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Each frontier row with the record of its digest."""
    stored = records.select(F.col("top").alias("digest"), "levels").dropDuplicates(["digest"])
    return frontier.join(stored, "digest")


def descend(tables: list[DataFrame], starts: DataFrame) -> DataFrame:
    """The frontier at the lowest records; ``starts`` are the roots of the trees with the path that leads to them and ``size``, the digests of the tree."""
    frontier, columns = None, ["tree", "rank", "subroot", "root", "digest", "path"]
    for k in range(len(tables) - 1, -1, -1):
        begins = (F.col("size") > WIDTH**k) if k else F.lit(True)
        here = starts.where(begins & (F.col("size") <= WIDTH ** (k + 1))).select(columns)
        frontier = here if frontier is None else here.unionByName(frontier)
        if k:
            frontier = _looked_up(frontier, tables[k]).mapInArrow(_descend, FRONTIER)
    return frontier


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last record of the descent: every leaf of a stretch gets its proof, turned round, and its folded root."""
    for batch in batches:
        for row in _rows(batch):
            rows = []
            above = row["path"][::-1]
            for at, leaf in enumerate(row["leaves"]):
                steps = segment(row["levels"], at)[::-1] + above
                folded = fold(leaf["tampered"] or leaf["leaf"], steps)
                rows.append({
                    "id": leaf["id"], "leaf": leaf["leaf"], "subroot": row["subroot"], "root": row["root"],
                    "proof_sha256": digest([s[1:] for s in steps]), "folded_root": folded, "verified": folded == row["root"],
                })
            yield pa.RecordBatch.from_pylist(rows, PROOF)


PROOF = pa.schema([("id", pa.int64()), *[(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def merkle_proofs(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", tampered: Column | None = None) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row.

    ``tampered`` is the leaf digest of a changed row, null where the row is
    unchanged; ``folded_root`` follows from it, the leaf's place and its siblings.
    """
    need(docs, *fields, id_col, source_col)
    none = F.lit(None).cast("string")
    slim = docs.select(F.col(source_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("id"), leaf_digest(*map(F.col, fields)).alias("leaf"), (tampered if tampered is not None else none).alias("tampered"))
    placed = with_place(cut(slim), ["tree"], [F.col("id").asc_nulls_first(), F.col("leaf").asc()], "rank", total="size")
    leaves = placed.groupBy("tree", F.floor(F.col("rank") / WIDTH).alias("stretch")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "leaf", "id", "tampered"))).alias("leaves")
    )
    leaves = cut(leaves.withColumnRenamed("stretch", "rank"))
    sizes = leaves.agg(F.max("size").alias("largest")).first()["largest"]
    if sizes is None:
        return docs.sparkSession.createDataFrame([], "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    records = build(leaves.select("tree", "rank", "size", F.col("leaves.leaf").alias("below")), sizes)
    totals = leaves.where("rank = 0").select("tree", "rank", F.col("size").alias("total"))
    tops = reduce(DataFrame.union, [t.where("size = 1").select("tree", "rank", "top") for t in records])

    # the subroots are the leaves of one more tree
    sources = with_place(cut(_same_tree(tops, totals)).withColumnRenamed("rank", "zero"), [], [F.col("tree").asc_nulls_first()], "rank", total="size")
    sources = cut(sources.select("tree", "rank", "size", "top", "total"))
    count = sources.count()
    stretch = sources.groupBy(F.floor(F.col("rank") / WIDTH).alias("stretch")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "top"))).alias("b"))
    upper = build(stretch.select(F.lit("").alias("tree"), F.col("stretch").alias("rank"), "size", F.col("b.top").alias("below")), count)
    root = upper[-1].where("size = 1").select("tree", "rank", F.lit("").alias("subroot"), F.col("top").alias("root"), F.col("top").alias("digest"), F.array().cast("array<string>").alias("path"), F.lit(count).cast("long").alias("size"))
    reached = _looked_up(descend(upper, root), upper[0]).mapInArrow(_descend, FRONTIER)
    starts = reached.select("rank", "root", "path").join(sources.select("rank", "tree", "top", "total"), "rank")
    starts = cut(starts.select("tree", F.lit(0).cast("long").alias("rank"), F.col("top").alias("subroot"), "root", F.col("top").alias("digest"), "path", F.col("total").alias("size")))

    frontier = _looked_up(descend(records, starts), records[0])
    asked = _same_tree(frontier, leaves.select("tree", "rank", "leaves"))
    return asked.select("subroot", "root", "path", "levels", "leaves").mapInArrow(_prove, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def without_line_breaks(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text lost its line breaks, for every row with an even CRC-32 of the decimal id."""
    hit = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 2 == 0
    changed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in fields]
    return F.when(hit & F.contains(F.col(text_col), F.lit("\n")), leaf_digest(*changed))
