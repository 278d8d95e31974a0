"""Whitening of embeddings by shifted CholeskyQR.

The rows, centred, are a tall matrix A.  A pass over all rows sums the Gram
matrix of A in each task and adds the tasks' sums; its Cholesky factor R, with a small
shift on the diagonal so that an ill-conditioned matrix has one, makes A R^-1
nearly orthogonal.  Further passes solve the triangular systems again and refine
the factors until the Gram matrix is the identity; the product of the factors is
the R of a QR decomposition of A, and its SVD gives the components and their
variances at full precision, which the covariance itself would lose.

Entries are whole numbers, so row counts, sums and each row's deviation are exact.  Only sums
and d x d matrices come to the driver: bounded by the length d of a vector.

Edge cases: vectors that are null, or hold null, non-finite or absurd entries
(2 ** 40 or more after scaling) are dropped; vectors of each length are whitened
within themselves, with counts of their own; empty vectors have no components;
repeated rows and rows with a null id are rows like others; a component without
variance (constant columns, or fewer rows than columns) has null in ``whitened``
and takes no part in the error; a deviation beyond a long is null; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import need
from gristmill.llm.vectors import by_length, finite

COMPONENTS, SCALE, OFFSET, LIMIT = 32, 64.0, 1_000_000, float(2**40)
#: Passes at most, how far a Gram matrix may be from the identity to be done, and the share of the largest deviation under which a component has no variance.
PASSES, DONE, FLAT = 6, 1e-10, 1e-10
ROUNDING = 2.0**-53


@dataclass
class Fit:
    """What is known of the vectors of one length: exact counts and sums, then the triangular factors, then the components."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    done: bool = False
    axes: np.ndarray | None = None
    variances: np.ndarray | None = None
    trace: float = 0.0
    error: float | None = None

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - sum, exactly; whole-number objects where a long is too short."""
        near = [round(s / self.n) for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, near)]
        apart = x.astype(np.int64) - np.array(near, np.int64)
        wide = self.n * (int(np.abs(apart).max(initial=0)) + 1) >= 2**62
        return (apart.astype(object) if wide else apart) * self.n - np.array(rest, object if wide else np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        """The centred rows after the triangular solves so far."""
        q = self.centred(x)
        for r in self.factors:
            out = np.empty_like(q)
            for j in range(q.shape[1]):
                out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
            q = out
        return q

    def refine(self, gram: np.ndarray) -> None:
        """One more factor, unless the rows are orthogonal already."""
        d, size = len(gram), float(np.linalg.norm(gram, 2)) if len(gram) else 0.0
        if size == 0.0 or (self.factors and np.abs(gram - np.eye(d)).max() <= DONE):
            self.done = True
            return
        shift = 11 * (self.n * d + d * (d + 1)) * ROUNDING * size
        for extra in (0.0 if self.factors else shift, shift, 1e3 * shift):
            try:
                self.factors.append(np.linalg.cholesky(gram + extra * np.eye(d)).T)
                return
            except np.linalg.LinAlgError:
                continue
        self.done = True

    def finish(self, components: int) -> None:
        """Components by falling variance from the SVD of the composed factor."""
        r = np.eye(len(self.sums))
        for f in self.factors:
            r = f @ r
        spread = np.zeros(len(r))
        axes = np.eye(len(r))
        if self.factors:
            _, spread, axes = np.linalg.svd(r)
        variances = spread**2 / self.n
        self.trace = float(variances.sum())
        variances = np.where(spread > FLAT * spread.max(initial=0.0), variances, 0.0)
        self.axes, self.variances = axes[:components].T.copy(), variances[:components]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Scores of the components with variance, which come first."""
        live = int((self.variances > 0).sum())
        return self.centred(x) @ self.axes[:, :live] / np.sqrt(self.variances[:live])


def _whole(x: np.ndarray, scale: float, offset: int) -> np.ndarray:
    return np.floor(x * scale) + offset


def _sums(rows: DataFrame, scale: float, offset: int) -> dict[int, Fit]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_length(batch, "v"):
                n[dim] = n.get(dim, 0) + len(x)
                total[dim] = total.get(dim, 0) + _whole(x, scale, offset).astype(np.int64).sum(axis=0)
        for dim in n:
            yield pa.RecordBatch.from_pydict({"dim": [dim] * (dim + 1), "k": list(range(-1, dim)), "s": [n[dim], *total[dim].tolist()]}, pa.schema([("dim", pa.int32()), ("k", pa.int32()), ("s", pa.int64())]))

    got: dict[int, dict[int, int]] = {}
    for r in rows.select("v").mapInArrow(run, "dim int, k int, s long").groupBy("dim", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # d + 1 rows
        got.setdefault(r["dim"], {})[r["k"]] = int(r["s"])
    return {dim: Fit(of[-1], [of[k] for k in range(dim)]) for dim, of in got.items()}


def _grams(rows: DataFrame, fits: dict[int, Fit], view: Callable[[Fit, np.ndarray], np.ndarray], scale: float, offset: int) -> dict[int, np.ndarray]:
    """The sum of the outer products of all rows, as ``view`` shows them, for each length in ``fits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_length(batch, "v"):
                if dim in fits:
                    q = view(fits[dim], _whole(x, scale, offset))
                    own[dim] = own.get(dim, 0.0) + q.T @ q
        for dim, g in own.items():
            upper = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(upper[0]), dim, np.int32)), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(g[upper])], ["dim", "i", "j", "g"]
            )

    parts = rows.select("v").mapInArrow(run, "dim int, i int, j int, g double")
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).collect():  # d * (d + 1) / 2 rows
        g = out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    return out


def fit_whitening(rows: DataFrame, components: int, scale: float, offset: int) -> dict[int, Fit]:
    """The components of the vectors ``v`` of each length, and how far the whitened rows are from unit covariance."""
    fits = {dim: f for dim, f in _sums(rows, scale, offset).items() if dim}
    for _ in range(PASSES):
        going = {dim: f for dim, f in fits.items() if not f.done}
        if not going:
            break
        for dim, gram in _grams(rows, going, Fit.orthogonal, scale, offset).items():
            fits[dim].refine(gram)
    for f in fits.values():
        f.finish(components)
    for dim, gram in _grams(rows, fits, Fit.whitened, scale, offset).items():
        live = int((fits[dim].variances > 0).sum())
        if live:
            fits[dim].error = float(np.abs(gram[:live, :live] / fits[dim].n - np.eye(live)).max())
    return fits


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component, from 1 by falling variance."""
    need(vectors, id_col, vector_col)
    v = F.col(vector_col)
    rows = vectors.where(finite(v, scale, LIMIT)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fits = fit_whitening(rows, components, scale, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for dim, at, x in by_length(batch, "v"):
                if not dim:
                    continue
                fit, x = fits[dim], _whole(x, scale, offset)
                m, count = len(fit.variances), len(at)
                scores = np.full((count, m), np.nan)
                got = fit.whitened(x)
                scores[:, : got.shape[1]] = got
                numerators = fit.numerators(x)
                if numerators.dtype != object and int(np.abs(numerators).max(initial=0)) ** 2 * dim >= 2**63:
                    numerators = numerators.astype(object)
                deviation = [d if d < 2**63 else None for d in (numerators**2).sum(axis=1).tolist()]
                explained = fit.variances / fit.trace if fit.trace > 0 else np.full(m, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(at, m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)), pa.array(np.full(count * m, fit.n, np.int64)),
                     pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(count), m))), pa.array(scores.ravel(), mask=np.isnan(scores.ravel())),
                     pa.array(np.tile(explained, count), mask=np.isnan(np.tile(explained, count))), pa.array([fit.error] * (count * m), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
