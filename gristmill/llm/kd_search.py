"""Exact top-k search by integer inner product with KD-trees.

A few median splits, fitted on a bounded sample, deal all vectors to cells; a
cell with many rows is dealt into slots, and each (cell, slot) is a shard of
bounded size with a KD-tree of its own: median splits along the widest
dimension down to small leaves with tight bounding boxes.  The largest inner
product that a query can have with a point of a box follows from the box alone.

A query searches the shard it lies in first.  Its k-th score there goes with it
to the other shards, of which only those are visited whose box can reach it, and
in a tree the descent drops the nodes that cannot, takes the leaves best first
and raises the k-th score as it goes.  The sample decides where vectors lie,
never what is found: no shard, node or leaf is dropped whose bound reaches the
k-th score.

Queries travel in blocks, trees as one row; a task holds one tree and one block.
Sums are whole numbers: in single or double precision where those are exact for
the lengths at hand, else in integers of any size.

Edge cases: vectors that are null or hold null or non-finite components take no
part, nor do those whose scaled components overflow a double; vectors are
compared with vectors of their own length; zero and empty vectors score 0; rows
with a null id are candidates, last among equal scores, and never queries; rows
that share an id are separate queries and candidates for each other; scores
beyond a long are set to the nearest long; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.llm.common import checked_broadcast, cut, item_bounds, need, partitions, whole_items
from gristmill.llm.vectors import by_length, finite

#: Vectors, and their components, of the sample that the cells are fitted on; sample vectors for each cell at least; components of a shard; rows of a leaf; queries of a block.
SAMPLE, SAMPLE_VALUES, CELL_SAMPLE, SHARD_VALUES, LEAF_ROWS, BLOCK = 16_384, 1 << 20, 32, 1 << 19, 64, 512
SHARD = ("dim", "cell", "slot")
NONE = -(2**63)  # no k-th score yet


# --- vectors as bytes ------------------------------------------------------------


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as 16-bit integers where they fit, else as doubles."""
    small = np.abs(x).max(axis=1, initial=0) < 2**15
    return [(r.astype("<i2") if s else r.astype("<f8")).tobytes() for r, s in zip(x, small.tolist())]


def unpack(raw: list[bytes], dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(raw), 0))
    if all(len(r) == 2 * dim for r in raw):
        return np.frombuffer(b"".join(raw), "<i2").reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<f8").astype(np.float64) for r in raw]).reshape(-1, dim)


def longest(x: np.ndarray) -> float:
    """The largest Euclidean norm of the rows."""
    return float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0)) if x.size else 0.0


def exact_products(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """``a @ b.T`` of whole numbers, exactly; ``reach`` is the product of the largest norms, which no partial sum of a pair exceeds."""
    if reach < 2**23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if reach < 2**52:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    got = [[min(max(sum(p * q for p, q in zip(u, v)), -(2**63) + 1), 2**63 - 1) for v in whole(b)] for u in whole(a)]
    return np.array(got, np.int64).reshape(len(a), len(b))


# --- trees -----------------------------------------------------------------------


@dataclass
class Tree:
    """Rows in leaf order, where each leaf starts, and the boxes of every level from the leaves up to the root."""

    x: np.ndarray
    ids: np.ndarray
    null: np.ndarray
    starts: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    norm: float


def split_order(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of 2 ** levels leaves, each node cut at the median of its widest dimension, and where leaves start."""
    order, bounds = np.arange(len(x)), [0, len(x)]
    for _ in range(levels):
        new = [0]
        for s, e in zip(bounds, bounds[1:]):
            part = order[s:e]
            mid = len(part) // 2
            if len(part) > 1 and x.shape[1]:
                rows = x[part]
                d = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
                order[s:e] = part[np.argpartition(rows[:, d], mid)]
            new += [s + mid, e]
        bounds = new
    return order, np.array(bounds[:-1], np.int64)


def boxes(x: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Tight boxes, leaves first; an empty node has a box that nothing reaches."""
    ends = np.append(starts[1:], len(x))
    low, high = np.full((len(starts), x.shape[1]), np.inf), np.full((len(starts), x.shape[1]), -np.inf)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if e > s:
            low[i], high[i] = x[s:e].min(axis=0), x[s:e].max(axis=0)
    lows, highs = [low], [high]
    while len(lows[-1]) > 1:
        lows.append(np.minimum(lows[-1][::2], lows[-1][1::2]))
        highs.append(np.maximum(highs[-1][::2], highs[-1][1::2]))
    return lows, highs


def grow(x: np.ndarray, ids: np.ndarray, null: np.ndarray, starts: np.ndarray | None = None) -> Tree:
    """The tree over rows; with ``starts`` the rows are in leaf order already."""
    if starts is None:
        order, starts = split_order(x, max(0, math.ceil(math.log2(max(1, len(x)) / LEAF_ROWS))))
        x, ids, null = x[order], ids[order], null[order]
    low, high = boxes(x, starts)
    return Tree(x, ids, null, starts, low, high, longest(x))


def reach_bound(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that each query's inner product can be in each box, never less than it is."""
    empty = ~np.isfinite(low).all(axis=1)
    low, high = np.where(np.isfinite(low), low, 0.0), np.where(np.isfinite(high), high, 0.0)
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        size = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
        slack = np.where(size < 2**51, 0.0, size * 1e-12)
        most = np.where(np.isfinite(most + slack), most + slack, np.inf)
    most[:, empty] = -np.inf
    return most


def best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: by score, then id, null ids last."""
    order = np.lexsort((ids, null, -score, who))
    w = who[order]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
    place = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    return order[place < k]


def search(tree: Tree, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(query, score, id, null)`` of the k best rows of the tree for each query that reach its ``floor``."""
    floor, reach = floor.copy(), longest(q) * tree.norm
    alive = np.ones((len(q), 1), bool)
    for low, high in zip(tree.low[::-1], tree.high[::-1]):  # from the root down, nodes whose parent is alive
        if len(low) > 1:
            alive = np.repeat(alive, 2, axis=1)
        bound = reach_bound(q, low, high)
        alive &= (bound >= floor[:, None]) & (bound > -np.inf)
    bound[~alive] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable")
    ends = np.append(tree.starts[1:], len(tree.x))
    got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    at, step = 0, 1
    while at < order.shape[1]:
        who, col = np.nonzero(np.take_along_axis(bound, order[:, at : at + step], axis=1) >= np.where(floor == NONE, -np.finfo(float).max, floor)[:, None])
        if not len(who):
            break
        leaf = order[who, at + col]
        turn = np.argsort(leaf, kind="stable")
        who, leaf = who[turn], leaf[turn]
        cuts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])).tolist()
        found = [got]
        for s, e in zip(cuts, [*cuts[1:], len(leaf)]):
            rows = slice(tree.starts[leaf[s]], ends[leaf[s]])
            scores = exact_products(q[who[s:e]], tree.x[rows], reach)
            i, j = np.nonzero(scores >= floor[who[s:e]][:, None])
            found.append([who[s:e][i], scores[i, j], tree.ids[rows][j], tree.null[rows][j]])
        got = [np.concatenate(c) for c in zip(*found)]
        keep = best(*got, k)
        got = [c[keep] for c in got]
        # the k-th score of every query that has k rows by now
        n = np.bincount(got[0], minlength=len(q))
        last = np.cumsum(n)[n == k] - 1
        floor[n == k] = np.maximum(floor[n == k], got[1][last])
        at, step = at + step, step * 2
    return got[0], got[1], got[2], got[3]


# --- cells -----------------------------------------------------------------------


@dataclass
class Cells:
    """Median splits of a sample: dimension and value of each inner node, in heap order."""

    dims: np.ndarray
    values: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(self.dims) + 1))):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dims[node]] > self.values[node])
        return node - len(self.dims)


def fit_cells(x: np.ndarray, rows: int, shard_rows: int) -> Cells:
    """So many cells that a shard holds ``shard_rows`` of ``rows``, if the sample can tell them apart."""
    depth = max(0, min(math.ceil(math.log2(max(1, rows / shard_rows))), int(math.log2(max(1, len(x) // CELL_SAMPLE))))) if x.shape[1] else 0
    dims, values, parts = [], [], [np.arange(len(x))]
    for _ in range(depth):
        new = []
        for part in parts:
            p = x[part]
            d = int((p.max(axis=0) - p.min(axis=0)).argmax()) if len(p) else 0
            v = float(np.median(p[:, d])) if len(p) else 0.0
            dims.append(d)
            values.append(v)
            right = p[:, d] > v if len(p) else np.zeros(0, bool)
            new += [part[~right], part[right]]
        parts = new
    return Cells(np.array(dims, np.int64), np.array(values))


def shard_rows_of(dim: int) -> int:
    return max(256, SHARD_VALUES // max(1, dim))


# --- the job -----------------------------------------------------------------------


def _grown(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its box and its rows in leaf order."""
    for start, end in item_bounds(table, SHARD):
        part = table.slice(start, end - start)
        dim, cell, slot = (part.column(c)[0].as_py() for c in SHARD)
        ids = part.column("vec_id")
        t = grow(unpack(part.column("x").to_pylist(), dim), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy())
        wide = "<i2" if np.abs(t.x).max(initial=0) < 2**15 else "<f8"
        yield pa.RecordBatch.from_pylist([{
            "dim": dim, "cell": cell, "slot": slot, "low": t.low[-1].tobytes(), "high": t.high[-1].tobytes(), "wide": wide,
            "rows": t.x.astype(wide).tobytes(), "ids": t.ids.tobytes(), "null": np.packbits(t.null).tobytes(), "starts": t.starts.tobytes(),
        }], _INDEX)


_INDEX = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("slot", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("wide", pa.string()), *[(c, pa.binary()) for c in ("rows", "ids", "null", "starts")]])
INDEX = "dim int, cell long, slot int, low binary, high binary, wide string, rows binary, ids binary, null binary, starts binary"


def _tree(row: dict) -> Tree:
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["rows"], row["wide"]).reshape(len(ids), row["dim"]).astype(np.float64)
    null = np.unpackbits(np.frombuffer(row["null"], np.uint8), count=len(ids)).astype(bool)
    return grow(x, ids, null, np.frombuffer(row["starts"], np.int64))


def _visit(index: DataFrame, asks: DataFrame, k: int, tasks: int) -> DataFrame:
    """The k best of each asked shard: ``asks`` is ``(shard, block, qid, x, floor)``; each (shard, block) is a work item."""
    pairs = asks.select(*SHARD, "block").distinct()
    trees = index.drop("low", "high").join(pairs, list(SHARD))
    both = trees.unionByName(asks, allowMissingColumns=True).withColumn("later", F.col("qid").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, dim, held = None, 0, []

        def answer():
            who, score, ids, null = search(tree, unpack([h["x"] for h in held], dim), np.array([h["floor"] for h in held], np.int64), k)
            qid = np.array([h["qid"] for h in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(qid[who]), pa.array(score), pa.array(ids, mask=null)], ["qid", "score", "vec_id"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for row in batch.slice(at, BLOCK).to_pylist():
                    if row["later"]:
                        held.append(row)
                    if held and (not row["later"] or len(held) == BLOCK):
                        yield answer()
                        held = []
                    if not row["later"]:
                        tree, dim = _tree(row), row["dim"]
        if held:
            yield answer()

    dealt = both.repartition(tasks, *SHARD, "block").sortWithinPartitions(*SHARD, "block", "later")
    return dealt.mapInArrow(run, "qid long, score long, vec_id long")


def _others(queries: DataFrame, index: DataFrame, many: int) -> DataFrame:
    """The shards, other than its own, whose box reaches a query's floor: blocks of queries against stretches of boxes."""
    stretches = max(1, math.ceil(index.count() / BLOCK))
    box = index.select("dim", F.pmod(F.xxhash64("cell", "slot"), F.lit(stretches)).cast("int").alias("stretch"), F.struct("cell", "slot", "low", "high").alias("b"))
    box = box.groupBy("dim", "stretch").agg(F.collect_list("b").alias("boxes"))
    ask = queries.groupBy("dim", "block").agg(F.collect_list(F.struct("qid", "cell", "slot", "x", "floor")).alias("asks"))
    ask = ask.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                dim, asks, of = row["dim"], row["asks"], row["boxes"]
                q = unpack([a["x"] for a in asks], dim)
                low, high = (np.array([np.frombuffer(b[c]) for b in of]).reshape(len(of), dim) for c in ("low", "high"))
                floor = np.array([a["floor"] for a in asks], np.int64)
                i, j = np.nonzero(reach_bound(q, low, high) >= np.where(floor == NONE, -np.inf, floor)[:, None])
                rows = [
                    {"dim": dim, "cell": of[b]["cell"], "slot": of[b]["slot"], "block": row["block"], "qid": asks[a]["qid"], "x": asks[a]["x"], "floor": asks[a]["floor"]}
                    for a, b in zip(i.tolist(), j.tolist()) if (of[b]["cell"], of[b]["slot"]) != (asks[a]["cell"], asks[a]["slot"])
                ]
                yield pa.RecordBatch.from_pylist(rows, _ASKS)

    dealt = ask.join(box, ["dim", "stretch"]).repartition(many, "dim", "stretch", "block")
    return dealt.mapInArrow(run, "dim int, cell long, slot int, block int, qid long, x binary, floor long")


_ASKS = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("slot", pa.int32()), ("block", pa.int32()), ("qid", pa.int64()), ("x", pa.binary()), ("floor", pa.int64())])


def nearest_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0, is_query: Column | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k other rows with the highest inner product of the scaled, floored components.

    ``is_query`` says which rows are queries; by default those whose id is
    divisible by 100.  ``vectors`` should be read from files, so that a task that
    runs again sees the same rows.
    """
    need(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    tasks = 2 * partitions(spark)
    ident, v = F.col(id_col).cast("long"), F.col(vector_col)
    asks = F.coalesce(is_query if is_query is not None else ident % 100 == 0, F.lit(False)) & ident.isNotNull()
    rows = vectors.where(finite(v, scale, float("inf"))).select(ident.alias("vec_id"), v.alias("v"), asks.alias("ask"), F.monotonically_increasing_id().alias("at"))

    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("ask").alias("q")).collect()}  # a row for each length
    total = sum(n for n, _ in sizes.values())
    wanted = min(SAMPLE, SAMPLE_VALUES // max(1, *sizes, 1))
    sample = rows.select("v").sample(fraction=min(1.0, wanted / max(1, total)), seed=5).collect()
    cells = {}
    for dim, (n, _) in sizes.items():
        own = [r["v"] for r in sample if len(r["v"]) == dim]
        cells[dim] = fit_cells(np.floor(np.array(own, np.float64).reshape(len(own), dim) * scale), n, shard_rows_of(dim))

    def place(batches: Iterator[pa.RecordBatch], light: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in by_length(batch, "v"):
                x = np.floor(x * scale)
                cell = pa.array(cells[dim].of(x))
                dims, take = pa.array(np.full(len(at), dim, np.int32)), pa.array(at)
                if light:
                    yield pa.RecordBatch.from_arrays([dims, cell], ["dim", "cell"])
                else:
                    yield pa.RecordBatch.from_arrays([dims, cell, batch.column("at").take(take), batch.column("vec_id").take(take), batch.column("ask").take(take), pa.array(pack(x), pa.binary())], ["dim", "cell", "at", "vec_id", "ask", "x"])

    crowded = cut(rows.select("v").mapInArrow(lambda it: place(it, True), "dim int, cell long").groupBy("dim", "cell").count())
    limit = F.greatest(F.lit(256), F.floor(F.lit(SHARD_VALUES) / F.greatest(F.lit(1), F.col("dim"))))
    crowded = crowded.select("dim", "cell", F.ceil(F.col("count") / limit).cast("int").alias("slots"))
    placed = rows.mapInArrow(lambda it: place(it, False), "dim int, cell long, at long, vec_id long, ask boolean, x binary").join(checked_broadcast(crowded), ["dim", "cell"])
    placed = placed.select("dim", "cell", F.pmod("at", F.col("slots")).cast("int").alias("slot"), "at", "vec_id", "ask", "x")

    dealt = placed.select(*SHARD, "vec_id", "x").repartition(tasks, *SHARD).sortWithinPartitions(*SHARD)
    index = cut(dealt.mapInArrow(lambda it: whole_items(it, SHARD, _grown), INDEX))
    blocks = max(1, math.ceil(max((q for _, q in sizes.values()), default=0) / BLOCK))
    queries = cut(placed.where("ask").select("at", "vec_id", *SHARD, "x", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int").alias("block")).withColumnRenamed("at", "qid"))

    near = cut(_visit(index, queries.select(*SHARD, "block", "qid", "x", F.lit(NONE).cast("long").alias("floor")), k + 1, tasks))
    floors = near.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k + 1).select("qid", F.col("low").alias("floor"))
    known = queries.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
    far = _visit(index, cut(_others(known, index, tasks)), k + 1, tasks)

    # the k + 1 best of all shards, without the query's own row
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("x").to_pylist()):
                x = unpack([raw], dim)
                scores.append(int(exact_products(x, x, longest(x) ** 2)[0, 0]))
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("vec_id"), pa.array(scores, pa.int64())], ["qid", "query_id", "own"])

    by = [F.desc("score"), F.asc_nulls_last("vec_id")]
    top = near.unionByName(far).withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(*by))).where(F.col("place") <= k + 1)
    top = top.join(queries.select("qid", "vec_id", "dim", "x").mapInArrow(own, "qid long, query_id long, own long"), "qid")
    same = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.lit(False))
    top = top.withColumn("self", same).withColumn("self", F.col("self") & (F.row_number().over(W.partitionBy("qid", "self").orderBy("place")) == 1)).where("not self")
    return top.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("place"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
