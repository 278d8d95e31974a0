"""Embedding near-duplicates by lattice hashing.

A table projects a vector onto eight random directions and decodes the result
to the nearest point of the E8 lattice; the point is the vector's cell.  Two
vectors meet in a table if the cell of one is the cell or a probed neighbouring
cell of the other.  Several tables make it unlikely that a close pair meets in
none.  Every meeting is verified by its cosine in double precision.

Equal vectors are one node with a weight.  First only cells, nodes and 56 signs
of each vector travel; rows of a cell whose signs differ from all others too
often drop out there, and vectors travel to what is left.  Crowded cells are
dealt into slots, and each pair of slots is a work item of its own.  A pair that
meets more than once is counted only at its first meeting, which follows from
the two vectors alone, so no list of pairs is kept: an item reports how many
links each node has and a spanning forest.

Edge cases: null, empty, zero and non-finite vectors have no links and are kept
as their own component; vectors of each length are compared within themselves,
whatever their magnitude; rows with a null id count as links and get the smallest
id they reach, or null; an empty table gives no rows; extra columns are ignored.
A node is known by a 64-bit hash of its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checked_broadcast, cut, item_bounds, need, partitions, spread_join, whole_items
from gristmill.llm.components import connected_components
from gristmill.llm.simhash import Forest


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    if len(odd):
        gap = y[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        at = np.arange(len(odd))
        r[odd, worst] += np.where(gap[at, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the integer and the half-integer coset."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def neighbours(gap: np.ndarray, n: int) -> np.ndarray:
    """Up to four shortest lattice vectors that lead nearest to each point, given its gap to its own cell.

    In turn the best vector with two entries of one, the best of halves, and
    the second best of each.
    """
    size, sign = np.abs(gap), np.where(gap >= 0, 1.0, -1.0)
    order = np.argsort(-size, axis=1, kind="stable")
    at = np.arange(len(gap))
    out = []
    for second, flip in ((1, 7), (2, 6)):
        whole = np.zeros_like(gap)
        for k in (0, second):
            whole[at, order[:, k]] = sign[at, order[:, k]]
        half = sign / 2
        odd = (half < 0).sum(axis=1) % 2 == 1
        half[at[odd], order[odd, flip]] *= -1
        if flip == 6:  # the runner-up among halves: two signs turned where the parity was right
            half[at[~odd], order[~odd, 7]] *= -1
            half[at[~odd], order[~odd, 6]] *= -1
        out += [whole, half]
    return np.stack(out[:n], axis=1)


class LatticeTables:
    """Cells and probed neighbouring cells of unit vectors in several tables.

    Sums run in one fixed order for every row, so a vector has the same cells
    in whatever batch it is.  Every length of vector has tables of its own.
    """

    def __init__(self, dim: int, tables: int = 6, probes: int = 2, width: float = 1.6, seed: int = 11):
        rng = np.random.default_rng((seed, dim))
        self.dim, self.tables, self.probes = dim, tables, probes
        self.directions = rng.standard_normal((tables, dim, 8)) / width
        self.shift = rng.random((tables, 8))
        self.mix = rng.integers(-(2**62), 2**62, (tables, 8))
        self.planes = rng.standard_normal((dim, SIGNS))

    def _key(self, points: np.ndarray, table: int) -> np.ndarray:
        return (np.rint(points * 2).astype(np.int64) * self.mix[table]).sum(axis=-1)

    def _project(self, unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
        y = np.zeros((len(unit), directions.shape[1]))
        for d in range(self.dim):
            y += unit[:, d, None] * directions[d]
        return y

    def cells(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Own cell, and ``probes`` neighbouring cells."""
        y = self._project(unit, self.directions[table]) + self.shift[table]
        own = nearest_e8(y)
        return self._key(own, table), self._key(own[:, None, :] + neighbours(y - own, self.probes), table)

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """On which side of each of 56 planes a vector lies."""
        side = np.packbits(self._project(unit, self.planes) > 0, axis=1)
        return np.pad(side, ((0, 0), (8 - side.shape[1], 0))).view(">u8").ravel().astype(np.int64)


@lru_cache(maxsize=64)
def _tables(dim: int, how: tuple) -> LatticeTables:
    return LatticeTables(dim, **dict(how))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component is scaled to one first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def meets(own_a, probe_a, own_b, probe_b) -> np.ndarray:
    return (own_a == own_b) | (probe_a == own_b[:, None]).any(axis=1) | (probe_b == own_a[:, None]).any(axis=1)


class Meetings:
    """In which table two vectors meet first; cells are found only for vectors that are asked about."""

    def __init__(self, tables: LatticeTables, unit: np.ndarray):
        self.tables, self.unit, self.done = tables, unit, np.zeros(len(unit), bool)
        self.own = np.zeros((tables.tables, len(unit)), np.int64)
        self.probe = np.zeros((tables.tables, len(unit), tables.probes), np.int64)

    def first(self, i: np.ndarray, j: np.ndarray, table: np.ndarray, at_smaller: np.ndarray) -> np.ndarray:
        """Whether pairs that meet in a ``table`` meet in none before it; where each probes the other there, the meeting ``at_smaller`` counts."""
        asked = np.zeros(len(self.unit), bool)
        asked[i] = asked[j] = True
        new = np.flatnonzero(asked & ~self.done)
        if len(new):
            self.done[new] = True
            for t in range(self.tables.tables):
                self.own[t, new], self.probe[t, new] = self.tables.cells(self.unit[new], t)
        alive = np.arange(len(i))
        for t in range(self.tables.tables):
            p, q, own, probe, here = i[alive], j[alive], self.own[t], self.probe[t], t == table[alive]
            late = (t < table[alive]) & meets(own[p], probe[p], own[q], probe[q])
            both = here & (own[p] != own[q]) & (probe[p] == own[q][:, None]).any(axis=1) & (probe[q] == own[p][:, None]).any(axis=1)
            alive = alive[~(late | (both & ~at_smaller[alive]))]
        out = np.zeros(len(i), bool)
        out[alive] = True
        return out


#: Signs that travel with a cell.  At cosine 0.9 two vectors differ in 8 of them with a deviation of 2.6; unrelated ones in 28.
SIGNS, SIGNS_APART = 56, 16
ROLE_HOME, ROLE_PROBE = 0, 1
ITEM = ("cell", "a", "b")


def item_pairs(bounds: list[tuple[int, int]], slot: np.ndarray, a: np.ndarray, b: np.ndarray, home: np.ndarray, small: int = 48, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in their item, in blocks: one of them is at home there, and in an item of two slots each is of one."""
    by_size: dict[int, list[int]] = {}
    for s, e in bounds:
        m = e - s
        if m < 2:
            continue
        if m <= small and a[s] == b[s]:
            by_size.setdefault(m, []).append(s)
            continue
        at = np.arange(s, e)
        left, right = at[slot[s:e] == a[s]], at[slot[s:e] == b[s]]
        step = max(1, most // max(1, len(right)))
        for k in range(0, len(left), step):
            i = left[k : k + step]
            p, q = np.nonzero(home[i][:, None] | home[right][None, :])
            p, q = i[p], right[q]
            yield (p[p < q], q[p < q]) if a[s] == b[s] else (p, q)
    for m, starts in by_size.items():
        i, j = np.triu_indices(m, 1)
        step = max(1, most // len(i))
        for k in range(0, len(starts), step):
            at = np.array(starts[k : k + step], np.int64)[:, None]
            p, q = (at + i).ravel(), (at + j).ravel()
            met = home[p] | home[q]
            yield p[met], q[met]


def _plausible(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of whole items that have a partner whose signs are near enough."""
    slot, a, b, packed, node = (table.column(c).to_numpy() for c in ("slot", "a", "b", "packed", "node"))
    signs, home = packed & ((1 << SIGNS) - 1), (packed >> SIGNS) & 1 == ROLE_HOME
    wanted = np.zeros(len(node), bool)
    for p, q in item_pairs(item_bounds(table, ITEM), slot, a, b, home):
        near = (np.bitwise_count(signs[p] ^ signs[q]) <= SIGNS_APART) & (node[p] != node[q])
        wanted[p[near]] = True
        wanted[q[near]] = True
    if wanted.any():
        yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()


def _links(table: pa.Table, single: bool, how: tuple, least: float) -> Iterator[pa.RecordBatch]:
    """Link counts and forest edges of whole items, each pair counted at its first meeting."""
    slot, a, b, packed, node, weight, cell = (table.column(c).to_numpy() for c in ("slot", "a", "b", "packed", "node", "weight", "cell"))
    home, t_of, signs = (packed >> SIGNS) & 1 == ROLE_HOME, packed >> (SIGNS + 1), packed & ((1 << SIGNS) - 1)
    raw = table.column("vec").to_pylist()
    dims = np.array([len(r) for r in raw], np.int64) // (4 if single else 8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    bounds = item_bounds(table, ITEM)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        used, first, inverse = np.unique(node[rows], return_index=True, return_inverse=True)
        x = np.frombuffer(b"".join(raw[k] for k in rows[first].tolist()), np.float32 if single else np.float64).reshape(-1, dim).astype(np.float64)
        unit = unit_vectors(x)
        at = np.zeros(len(node), np.int64)
        at[rows] = inverse
        met = Meetings(_tables(dim, how), unit)

        def counts_here(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return met.first(at[p], at[q], t_of[p], np.where(home[p], node[p], node[q]) == np.minimum(node[p], node[q]))  # noqa: B023

        def close(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            parts = [np.einsum("ij,ij->i", unit[at[p[k : k + 8192]]], unit[at[q[k : k + 8192]]]) for k in range(0, len(p), 8192)]  # noqa: B023
            return np.concatenate(parts) >= least if parts else np.zeros(0, bool)

        for p, q in item_pairs([x for x in bounds if dims[x[0]] == dim], slot, a, b, home):
            other = (node[p] != node[q]) & (dims[p] == dim) & (dims[q] == dim) & (np.bitwise_count(signs[p] ^ signs[q]) <= SIGNS_APART)
            p, q = p[other], q[other]
            # in a crowd most pairs are close and have met before; elsewhere few are close
            for test in (counts_here, close) if len(p) > 4 * len(used) else (close, counts_here):
                ok = test(p, q)
                p, q = p[ok], q[ok]
            if len(p):
                found.append((p, q))
    if not found:
        return
    p, q = (np.concatenate(x) for x in zip(*found))
    every, place = np.unique(node, return_inverse=True)
    n = np.zeros(len(every), np.int64)
    np.add.at(n, place[p], weight[q])
    np.add.at(n, place[q], weight[p])
    forest = Forest(len(every))
    forest.add(place[p], place[q])
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(every[some]), pa.array(n[some]), pa.array(every[forest.parent[some]])], ["node", "links", "to"])


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, slot_rows: int = 512, **how) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector.

    ``how`` sets the lattice tables (tables, probes, width, seed).  The width is
    in units of the lattice; a wider cell finds more of the borderline pairs and
    has more candidates.
    """
    need(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    tables_of = tuple(sorted(how.items()))
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    all_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    zero = F.lit(0.0).cast("float" if single else "double")
    rows = all_rows.where(usable).select("vec_id", F.transform("v", lambda x: x + zero).alias("v")).withColumn("node", F.xxhash64("v"))
    per_node = cut(rows.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))

    # one row for each node: rows of vectors that occur once as they are, the others grouped
    many = per_node.where("weight > 1").select("node", "weight")
    many = checked_broadcast(cut(many))
    grouped = cut(rows.join(many, "node").groupBy("node").agg(F.first("v").alias("v"), F.max("weight").alias("weight")))
    nodes = rows.join(many, "node", "left_anti").select("node", "v", F.lit(1).cast("long").alias("weight")).union(grouped)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                node = part.column("node").to_numpy()
                lists = part.column("v")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                starts = np.concatenate(([0], np.cumsum(size)[:-1]))
                for dim in np.unique(size).tolist():
                    own_rows = np.flatnonzero(size == dim)
                    unit = unit_vectors(flat[starts[own_rows][:, None] + np.arange(dim)])
                    tables = _tables(dim, tables_of)
                    signs = tables.signs(unit)
                    for t in range(tables.tables):
                        own, probe = tables.cells(unit, t)
                        for role, cell in ((ROLE_HOME, own), *((ROLE_PROBE, probe[:, k]) for k in range(tables.probes))):
                            packed = signs | (role << SIGNS) | (t << (SIGNS + 1))
                            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(packed), pa.array(node[own_rows])], ["cell", "packed", "node"])

    placed = nodes.select("node", "v").mapInArrow(place, "cell long, packed long, node long")
    crowded = cut(placed.groupBy("cell").count().where(F.col("count") > slot_rows).select("cell", F.ceil(F.col("count") / slot_rows).cast("int").alias("slots")))
    work = placed.join(checked_broadcast(crowded), "cell", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    work = work.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    work = work.select("cell", F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b"), "slot", "packed", "node")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(2 * partitions(spark), *ITEM).sortWithinPartitions(*ITEM, "node")

    schema = "cell long, a int, b int, slot int, packed long, node long"
    likely = cut(dealt(work).mapInArrow(lambda it: whole_items(it, ITEM, _plausible), schema))
    wanted = checked_broadcast(cut(likely.select("node").distinct()))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            raw = [flat[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), pa.array(raw, pa.binary())], ["node", "weight", "vec"])

    vecs = nodes.join(wanted, "node", "left_semi").select("node", "weight", "v").mapInArrow(as_bytes, "node long, weight long, vec binary")
    full = dealt(spread_join(likely, vecs, ["node"]))
    links = cut(full.mapInArrow(lambda it: whole_items(it, ITEM, lambda t: _links(t, single, tables_of, least)), "node long, links long, to long"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    members = cut(connected_components(links.select("node", "to"), "node", "to"))
    first = members.join(per_node, "node").groupBy("component").agg(F.min("rep").alias("low"))
    known = per_node.join(counts, "node", "left").join(spread_join(members, first, ["component"]).select("node", "low"), "node", "left")
    known = known.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    with_node = spread_join(rows.select("vec_id", "node"), known, ["node"]).select("vec_id", "n_links", "component_id")
    without = all_rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_node.union(without).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
