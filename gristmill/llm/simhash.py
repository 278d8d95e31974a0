"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in tiles of one population count each.  Two
fingerprints within the radius differ in population count by at most the
radius, so only tiles of classes that close are paired; a pair of tiles is
compared in full with numpy exclusive-or and bit counts.  A tile pair reports a
spanning forest of its links instead of all of them, which keeps every
component and stays linear in the tile size.

``near_duplicates`` takes a similarity instead of a radius: wide fingerprints of
256 bits, compared in tiles of like set sizes, give the candidates, and every
link is verified on the full shingle sets.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other (in ``near_duplicates`` they are one node); equal fingerprints are one node; rows with a null id get the component
of their fingerprint's other rows, or null; rows that repeat a doc_id are one
document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checked_broadcast, cut, item_bounds, need, partitions, spread_join, texts, whole_items
from gristmill.llm.components import connected_components


def shingle_hashes(text: str, size: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of the word shingles of one text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def bit_votes(words: np.ndarray) -> np.ndarray:
    """How many rows of ``words`` have each bit set, highest bit first; many rows are counted by byte values."""
    n, k = words.shape
    data = words.astype(">u8").view(np.uint8).reshape(n, 8 * k)
    if n < 300:
        return np.unpackbits(data, axis=1).sum(axis=0, dtype=np.int64)
    seen = np.bincount((data + np.arange(8 * k, dtype=np.int32) * 256).ravel(), minlength=2048 * k)
    return (seen.reshape(8 * k, 256) @ _BITS).ravel()


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits; a bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(bit_votes(hashes[:, None]) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint's bits as a signed long."""
    need(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in texts(batch, "text")], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Spanning forest over 0..n-1, grown from arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]


def _by_half(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the population count of the upper half, and those counts in order."""
    half = np.bitwise_count(a >> np.uint64(32)).astype(np.int64)
    order = np.argsort(half, kind="stable")
    return order, half[order]


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Forest links between two tiles (or within one); indices into a, then b after it.

    Inside the tiles the same bound is used once more: a block of rows meets
    only the columns whose upper-half population count can be in reach.
    """
    other = a if b is None else b
    shift = 0 if b is None else len(a)
    forest = Forest(len(a) + (0 if b is None else len(b)))
    if not len(a) or not len(other):
        return forest.edges()
    gaps = np.bitwise_count(other).astype(np.int64)[:, None] - np.unique(np.bitwise_count(a).astype(np.int64))[None, :]
    low, high = int(-((radius - gaps.min()) // 2)), int((gaps.max() + radius) // 2)
    rows, half_a = _by_half(a)
    columns, half_b = _by_half(other)
    sorted_a, sorted_b = a[rows], other[columns]
    room = np.empty(max(cells, len(other)), np.uint64)
    at = 0
    while at < len(a):
        left = int(np.searchsorted(half_b, half_a[at] + low, "left"))
        left = max(left, at) if b is None else left  # each pair within a tile once
        upto = at + max(1, cells // max(1, len(other) - left))
        right = int(np.searchsorted(half_b, half_a[min(upto, len(a)) - 1] + high, "right"))
        upto, width = min(upto, len(a)), max(0, right - left)
        cross = np.bitwise_xor(sorted_a[at:upto, None], sorted_b[None, left:right], out=room[: (upto - at) * width].reshape(upto - at, width))
        near = np.flatnonzero(np.bitwise_count(cross) <= radius)
        if len(near):
            i, j = np.divmod(near, width)
            forest.add(rows[i + at], columns[j + left] + shift)
        at = upto
    return forest.edges()


def fingerprint_links(nodes: DataFrame, radius: int = 4, tile_rows: int = 32768) -> DataFrame:
    """Links ``(a, b)`` between node ids whose fingerprints differ in at most ``radius`` bits.

    ``nodes`` is ``(fp, rep)`` with distinct fp.  The links are a spanning set:
    they join exactly the components of all links.  The only thing that comes
    to the driver is a count for each of the 65 population counts.
    """
    spark = nodes.sparkSession
    nodes = nodes.withColumn("pop", F.bit_count("fp").cast("int"))
    sizes = {r["pop"]: r["count"] for r in nodes.groupBy("pop").count().collect()}
    slots = [max(1, -(-sizes.get(p, 0) // tile_rows)) for p in range(65)]
    slots_of = F.element_at(F.array(*map(F.lit, slots)), F.col("pop") + 1)
    tiles = nodes.withColumn("slot", F.pmod(F.xxhash64("fp"), slots_of).cast("int"))
    tiles = cut(tiles.groupBy("pop", "slot").agg(F.collect_list(F.struct("fp", "rep")).alias("rows")))
    a = tiles.select(F.col("pop").alias("pop_a"), F.col("slot").alias("slot_a"), F.explode(F.sequence("pop", F.col("pop") + radius)).alias("pop_b"))
    b = tiles.select(F.col("pop").alias("pop_b"), F.col("slot").alias("slot_b"))
    pairs = a.join(b, "pop_b").where("pop_b > pop_a or slot_b >= slot_a")
    left = tiles.select(F.col("pop").alias("pop_a"), F.col("slot").alias("slot_a"), F.col("rows").alias("rows_a"))
    right = tiles.select(F.col("pop").alias("pop_b"), F.col("slot").alias("slot_b"), F.col("rows").alias("rows_b"))
    work = pairs.join(left, ["pop_a", "slot_a"]).join(right, ["pop_b", "slot_b"])
    work = work.repartition(max(2 * partitions(spark), sum(slots)), "pop_a", "slot_a", "pop_b", "slot_b")

    def column(batch: pa.RecordBatch, name: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = batch.column(name).slice(k, 1).flatten()
        return tuple(rows.field(f).to_numpy(zero_copy_only=False) for f in ("fp", "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (fa, ra), (fb, rb) = column(batch, "rows_a", k), column(batch, "rows_b", k)
                same = all(batch.column(f"{n}_a")[k] == batch.column(f"{n}_b")[k] for n in ("pop", "slot"))
                i, j = compare_tiles(fa.view(np.uint64), None if same else fb.view(np.uint64), radius)
                reps = ra if same else np.concatenate((ra, rb))
                yield pa.RecordBatch.from_arrays([pa.array(reps[i], pa.int64()), pa.array(reps[j], pa.int64())], ["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, tile_rows: int = 32768) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: the smallest doc_id reachable over links within the radius."""
    fps = cut(fingerprints(docs, id_col, text_col, size))
    nodes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    members = connected_components(fingerprint_links(nodes, radius, tile_rows), "a", "b")
    known = nodes.join(members, nodes["rep"] == members["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(known, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by similarity ----------------------------------------------

#: Bits of the wide fingerprint are four words of 64; the first is also compared alone.
WORDS = 4
#: Two sets of similarity 0.8 differ in about 39 of 256 bits with a deviation of 6, and in about 10 of the first 64 with a deviation of 3.
RADIUS, FIRST = 60, 23
#: Sets of few shingles spread further.
FEW, RADIUS_FEW, FIRST_FEW = 8, 72, 27
#: Links this close are nearly always over the similarity.
TIGHT = 36
ITEM = ("family", "a", "b")


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingle_hashes(text, size))


def signature(shingles: np.ndarray) -> int:
    """Identity of a set: equal sets are one node."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """256 bits of majority over the shingles, as four unsigned words."""
    if not len(shingles):
        return np.zeros(WORDS, np.uint64)
    words = np.empty((len(shingles), WORDS), np.uint64)
    words[:, 0] = shingles
    for k in range(1, WORDS):
        h = shingles ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
        words[:, k] = h ^ (h >> np.uint64(33))
    return np.packbits(bit_votes(words) * 2 > len(shingles)).view(">u8").astype(np.uint64)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def sketches(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(doc_id, sig, n, grade, f0 .. f3)``: set identity and size, its size grade, and the wide fingerprint.

    Sets of similarity s differ in size by a factor of 1/s at most, so their
    grades, powers of 1/s, differ by one at most.
    """
    step = float(np.log(1 / similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in texts(batch, "text")]
            n = np.array([len(s) for s in sets], np.int64)
            f = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, WORDS)
            grade = np.floor(np.log(np.maximum(n, 1)) / step + 1e-9).astype(np.int32)
            sig = np.array([signature(s) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _longs(sig), pa.array(n), pa.array(grade), *(_longs(f[:, k]) for k in range(WORDS))], ["doc_id", "sig", "n", "grade", *(f"f{k}" for k in range(WORDS))]
            )

    return docs.mapInArrow(run, "doc_id long, sig long, n long, grade int, " + ", ".join(f"f{k} long" for k in range(WORDS)))


def wide_matches(fa: np.ndarray, na: np.ndarray, fb: np.ndarray | None, nb: np.ndarray | None, similarity: float, cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ``(i, j, distance)`` within the radius between two tiles (or within one): rows of a, rows of b.

    Rows are laid out by the population count of the first word; a block of rows
    meets only the columns whose count can be in reach.
    """
    same = fb is None
    fb, nb = (fa, na) if same else (fb, nb)
    if not len(fa) or not len(fb):
        return
    few = min(na.min(), nb.min()) < FEW
    radius, first = (RADIUS_FEW, FIRST_FEW) if few else (RADIUS, FIRST)
    pa_, pb_ = np.bitwise_count(fa[:, 0]).astype(np.int64), np.bitwise_count(fb[:, 0]).astype(np.int64)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb_, kind="stable")
    a, b, pa_, pb_ = fa[oa, 0].copy(), fb[ob, 0].copy(), pa_[oa], pb_[ob]
    at = 0
    while at < len(a):
        left = int(np.searchsorted(pb_, pa_[at] - first, "left"))
        left = max(left, at) if same else left
        upto = min(len(a), at + max(1, cells // max(1, len(b) - left)))
        right = int(np.searchsorted(pb_, pa_[upto - 1] + first, "right"))
        if right > left:
            near = np.flatnonzero(np.bitwise_count(a[at:upto, None] ^ b[None, left:right]) <= first)
            i, j = np.divmod(near, right - left)
            i, j = i + at, j + left
            if same:
                i, j = i[j > i], j[j > i]
            i, j = oa[i], ob[j]
            low, high = np.minimum(na[i], nb[j]), np.maximum(na[i], nb[j])
            fits = low >= high * similarity - 1e-9
            i, j = i[fits], j[fits]
            d = np.bitwise_count(fa[i] ^ fb[j]).sum(axis=1, dtype=np.int64)
            close = d <= radius
            if close.any():
                yield i[close], j[close], d[close]
        at = upto


def _turn(sig: np.ndarray) -> np.ndarray:
    """A place for every node in one random order."""
    return sig * np.int64(-7046029254386353131)


def wide_links(nodes: DataFrame, similarity: float, tile_rows: int) -> DataFrame:
    """``(kind, a, b)`` over all pairs of nodes within the radius.

    Kind 0 is a spanning forest of the candidate pairs.  Kind 1 leads a node
    ``a`` to one tight candidate ``b`` before it in a random order, the first
    one in that order, so that the members of a dense group share their leaders.
    """
    spark = nodes.sparkSession
    sizes = {r["grade"]: r["count"] for r in nodes.groupBy("grade").count().collect()}  # one row for each size grade
    slots = {g: max(1, -(-c // tile_rows)) for g, c in sizes.items()}
    slots_of = F.element_at(F.create_map(*[F.lit(x) for g, c in slots.items() for x in (g, c)]), F.col("grade")) if slots else F.lit(1)
    row = F.struct("sig", "n", *(f"f{k}" for k in range(WORDS)))
    tiles = nodes.withColumn("slot", F.pmod(F.xxhash64("sig"), slots_of).cast("int")).groupBy("grade", "slot").agg(F.collect_list(row).alias("rows"))
    tiles = cut(tiles)
    a = tiles.select(F.col("grade").alias("grade_a"), F.col("slot").alias("slot_a"), F.explode(F.array("grade", F.col("grade") + 1)).alias("grade_b"))
    b = tiles.select(F.col("grade").alias("grade_b"), F.col("slot").alias("slot_b"))
    pairs = a.join(b, "grade_b").where("grade_b > grade_a or slot_b >= slot_a")
    left = tiles.select(F.col("grade").alias("grade_a"), F.col("slot").alias("slot_a"), F.col("rows").alias("rows_a"))
    right = tiles.select(F.col("grade").alias("grade_b"), F.col("slot").alias("slot_b"), F.col("rows").alias("rows_b"))
    work = pairs.join(left, ["grade_a", "slot_a"]).join(right, ["grade_b", "slot_b"])
    work = work.repartition(max(2 * partitions(spark), sum(slots.values())), "grade_a", "slot_a", "grade_b", "slot_b")

    def tile(batch: pa.RecordBatch, name: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = batch.column(name).slice(k, 1).flatten()
        col = lambda f: rows.field(f).to_numpy(zero_copy_only=False)
        return col("sig"), col("n"), np.column_stack([col(f"f{w}").view(np.uint64) for w in range(WORDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sig, n, f = tile(batch, "rows_a", k)
                same = all(batch.column(f"{x}_a")[k] == batch.column(f"{x}_b")[k] for x in ("grade", "slot"))
                sig_b, n_b, f_b = (sig, n, None) if same else tile(batch, "rows_b", k)
                shift, every = (0, sig) if same else (len(sig), np.concatenate((sig, sig_b)))
                rank = np.empty(len(every), np.int64)
                rank[np.argsort(_turn(every), kind="stable")] = np.arange(len(every))
                forest, lead = Forest(len(every)), np.full(len(every), len(every), np.int64)
                for i, j, d in wide_matches(f, n, f_b, n_b, similarity):
                    j = j + shift
                    forest.add(i, j)
                    i, j = i[d <= TIGHT], j[d <= TIGHT]
                    np.minimum.at(lead, i, rank[j])
                    np.minimum.at(lead, j, rank[i])
                by_rank = np.argsort(rank)
                led = np.flatnonzero(lead < rank)
                a, b = forest.edges()
                a, b = np.concatenate((a, led)), np.concatenate((b, by_rank[lead[led]]))
                kind = np.repeat(np.array([0, 1], np.int32), [len(a) - len(led), len(led)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(every[a]), pa.array(every[b])], ["kind", "a", "b"])

    return work.mapInArrow(run, "kind int, a long, b long")


def _sets(batch: pa.RecordBatch | pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in batch.column(name).to_pylist()]


def wanted_sets(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``(sig, shingles)`` of the given nodes, read again from one text of each."""
    ids = checked_broadcast(cut(nodes.select(F.col("rep").alias("doc_id")).distinct()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([_longs(np.array([signature(s) for s in sets], np.uint64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "shingles"])

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(read, "sig long, shingles binary").groupBy("sig").agg(F.first("shingles").alias("shingles"))


def _similar(both: np.ndarray, n: np.ndarray, m: np.ndarray, least: Fraction) -> np.ndarray:
    return both * least.denominator >= least.numerator * (n + m - both)


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _sets(batch, "x"), _sets(batch, "y")
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], np.int64)
            near = _similar(both, np.array([len(p) for p in x], np.int64), np.array([len(q) for q in y], np.int64), least)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    work = spread_join(pairs, sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), ["b"])
    work = spread_join(work, sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), ["a"])
    return work.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def compare_slots(sets: list[np.ndarray], n: np.ndarray, f: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """All pairs between rows ``left`` and ``right`` that are of different parts, within the radius, and reach the similarity."""
    same = len(left) == len(right) and (left == right).all()
    flat = np.concatenate([sets[j] for j in right])
    known, codes = np.unique(flat, return_inverse=True)
    ends = np.cumsum([len(sets[j]) for j in right])
    starts = np.concatenate(([0], ends[:-1]))
    of: dict[int, list[np.ndarray]] = {}
    for i, j, _ in wide_matches(f[left], n[left], None if same else f[right], None if same else n[right], similarity):
        apart = part[left[i]] != part[right[j]]
        i, j = i[apart], j[apart]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for who, js in zip(i[np.concatenate(([0], cuts))] if len(i) else (), np.split(j, cuts)):
            of.setdefault(int(who), []).append(js)
    out_i, out_j = [], []
    mark = np.zeros(len(known), bool)
    for i, parts in of.items():
        j = np.concatenate(parts)
        own = sets[left[i]]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = at[known[at] == own]
        mark[at] = True
        lengths = ends[j] - starts[j]
        some = np.concatenate([codes[starts[k] : ends[k]] for k in j])
        both = np.add.reduceat(mark[some], np.concatenate(([0], np.cumsum(lengths)[:-1])), dtype=np.int64)
        mark[at] = False
        good = _similar(both, np.int64(len(own)), lengths, least)
        out_i.append(np.full(int(good.sum()), left[i]))
        out_j.append(right[j[good]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def family_links(members: DataFrame, sets: DataFrame, similarity: float, least: Fraction, slot_shingles: int) -> DataFrame:
    """Links ``(a, b)`` that join what the similarity links within each family, beyond the known parts.

    ``members`` is ``(sig, n, f0 .. f3, family, part)``.  A family is dealt into
    slots of bounded size, large parts into slots of their own; each pair of
    slots is a work item of its own, except within one part.
    """
    members = cut(members)
    parts = members.groupBy("family", "part").agg(F.sum("n").alias("size"))
    families = parts.groupBy("family").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("size") < slot_shingles, F.col("size"))).alias("rest")).where("parts > 1")
    own = F.ceil(F.col("size") / slot_shingles).cast("int")
    pool = F.greatest(F.lit(1), F.ceil(F.coalesce("rest", F.lit(0)) / slot_shingles)).cast("int")
    large = F.col("size") >= slot_shingles
    plan = spread_join(parts, families.select("family", pool.alias("pool")), ["family"])
    # a slot is its part and a number within it, or, for parts of the pool, part 0 and a number
    plan = plan.select(
        "family", "part", F.when(large, F.col("part")).otherwise(F.lit(0)).alias("of"), F.when(large, own).otherwise(F.col("pool")).alias("slots"), large.alias("large")
    )
    plan = cut(plan)
    dealt = spread_join(members, plan, ["family", "part"])
    turn = F.when(F.col("large"), F.xxhash64("sig")).otherwise(F.xxhash64("part"))
    dealt = dealt.withColumn("slot", F.xxhash64("of", F.pmod(turn, F.col("slots"))))
    dealt = cut(dealt.select("family", "part", "of", "slot", "sig", "n", *(f"f{k}" for k in range(WORDS))))
    slots = dealt.select("family", "of", "slot").distinct()
    other = slots.select("family", F.col("of").alias("of_b"), F.col("slot").alias("other"))
    pairs = spread_join(slots, other, ["family"]).where("of <> of_b or of = 0").select("family", "slot", "other")
    work = spread_join(spread_join(dealt, sets, ["sig"]), pairs, ["family", "slot"])
    work = work.select("family", F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b"), "slot", "sig", "part", "n", *(f"f{k}" for k in range(WORDS)), "shingles")
    work = work.repartition(2 * partitions(members.sparkSession), *ITEM).sortWithinPartitions(*ITEM, "sig")

    def report(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda c: table.column(c).to_numpy()
        sig, n, part, slot, a, b = (col(c) for c in ("sig", "n", "part", "slot", "a", "b"))
        f = np.column_stack([col(f"f{k}").view(np.uint64) for k in range(WORDS)])
        for s, e in item_bounds(table, ITEM):
            if len(set(part[s:e].tolist())) < 2:
                continue
            at = np.arange(e - s)
            left, right = at[slot[s:e] == a[s]], at[slot[s:e] == b[s]]
            if not len(left) or not len(right):
                continue
            i, j = compare_slots(_sets(table.slice(s, e - s), "shingles"), n[s:e], f[s:e], part[s:e], left, right, similarity, least)
            forest = Forest(e - s)
            forest.add(i, j)
            i, j = forest.edges()
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(sig[s:e][i]), pa.array(sig[s:e][j])], ["a", "b"])

    return work.mapInArrow(lambda it: whole_items(it, ITEM, report), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, tile_rows: int = 16384, slot_shingles: int = 64_000
) -> DataFrame:
    """``(doc_id, component_id)``: the smallest doc_id reachable over pairs of at least this Jaccard similarity of word shingles.

    Candidates are all pairs within a radius of wide fingerprints, found tile by
    tile; every link is verified on the full sets.  The radius is three and a
    half deviations beyond the mean distance at a similarity of 0.8, which
    misses about one in several thousand pairs that lie right at the limit.
    """
    need(docs, id_col, text_col)
    if not 0.8 <= similarity <= 1:
        raise ValueError("the radius is made for similarities of 0.8 or more")
    least = Fraction(str(similarity))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = cut(sketches(docs, size, similarity))
    words = [f"f{k}" for k in range(WORDS)]
    nodes = cut(rows.groupBy("sig").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "grade", *words))))
    near = cut(wide_links(nodes.where("n > 0"), similarity, tile_rows))
    families = connected_components(near.where("kind = 0"), "a", "b").select(F.col("node").alias("sig"), F.col("component").alias("family"))
    families = cut(spread_join(nodes.select("sig", "rep", "n", *words), families, ["sig"]))
    sets = cut(wanted_sets(families, docs, size))
    # texts that share an id are one document
    slim = rows.select("doc_id", "sig")
    low = slim.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a <> z").select("doc_id", "a")
    known_leads = cut(similar_pairs(near.where("kind = 1").select("a", "b").distinct(), sets, least))
    links = known_leads.union(slim.join(low, "doc_id").where("a <> sig").select("a", F.col("sig").alias("b")))
    # a node and its leader's leader are of one part
    lead = known_leads.groupBy("a").agg(F.min("b").alias("lead")).select(F.col("a").alias("sig"), "lead")
    above = lead.select(F.col("sig").alias("lead"), F.col("lead").alias("up"))
    lead = spread_join(lead, above, ["lead"], "left").select("sig", F.coalesce("up", "lead").alias("part"))
    members = spread_join(families.drop("rep"), lead, ["sig"], "left").withColumn("part", F.coalesce("part", "sig"))
    more = cut(family_links(members, sets, similarity, least, slot_shingles))
    groups = connected_components(links.union(more), "a", "b").withColumnRenamed("node", "sig")
    known = cut(nodes.select("sig", "rep").join(groups, "sig", "left").select("sig", "rep", F.coalesce("component", "sig").alias("part")))
    first = known.groupBy("part").agg(F.min("rep").alias("component_id"))
    known = spread_join(known, first, ["part"]).select("sig", "component_id")
    return spread_join(slim, known, ["sig"]).select("doc_id", "component_id").distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that are the first of their group of near-duplicates; documents without an id stay."""
    groups = near_duplicates(docs, id_col, text_col, **how)
    drop = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_near_drop")).distinct()
    return docs.join(drop, F.col(id_col).cast("long") == F.col("_near_drop"), "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that are the first of their component; documents without an id stay."""
    groups = simhash_components(docs, id_col, text_col, **how)
    drop = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_simhash_drop"))
    return docs.join(drop, F.col(id_col).cast("long") == F.col("_simhash_drop"), "left_anti")
