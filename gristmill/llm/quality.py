"""Quality classifier by co-training of two views.

The text view sees what a page says: hashed counts of its words and of its runs
of four bytes, and some statistics of its whole text.  The metadata view sees
what is known about it: language, source, size.  Each view starts as a logistic
model on the labelled rows.  In each round every document of the corpus is
scored by both views; what one view is confident about becomes pseudo-labels
for the other, whose sums of slopes and curvatures are added up on Spark, and
each model takes Newton steps over its labelled rows and those sums.  A view that
orders the held labelled rows no better than chance has nothing to say and gives
no pseudo-labels away.  Both are then calibrated on labelled rows that they were not fitted on, and the
calibrated views are combined into the score of every document.

The labelled rows are a bounded sample, chosen by a hash of the id: at most
``label_rows``.  Pseudo-labels come from all documents, and what comes back of
them is one small matrix for each view whatever the corpus.

Edge cases: null and empty texts have the statistics of an empty text; null
metadata is a value of its own; without labels of both kinds every document has
score 1 (nothing is rejected); duplicated rows each get a row; an empty table
gives no rows.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, need, partitions, texts

SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~", np.uint8)
WORD_SLOTS, GRAM_SLOTS, N_SHARES = 128, 112, 15
LANG_SLOTS, SOURCE_SLOTS = 32, 256
N_TEXT, N_META = N_SHARES + WORD_SLOTS + GRAM_SLOTS, LANG_SLOTS + SOURCE_SLOTS + 4
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(64, 1_000_003, np.uint32), dtype=np.uint32)


def text_shares(data: bytes, counts: np.ndarray) -> list[float]:
    """Shares of kinds of bytes, and how words repeat, of one whole text."""
    n, h = max(1, len(data)), counts
    words = data.split()
    w = max(1, len(words))
    upper, lower = h[65:91].sum(), h[97:123].sum()
    same = sum(map(operator.eq, words, words[1:])) / w
    distinct = len(set(words)) / w
    symbols = h[SYMBOLS].sum()
    return [
        upper / n, upper / max(1, upper + lower), symbols / n, h[33] / n, h[63] / n, h[124] / n, h[48:58].sum() / n, h[[44, 46, 58, 59]].sum() / n,
        min(1.0, symbols / w), min(1.0, h[33] / w), min(1.0, h[124] / w), same, distinct * min(1.0, 200 / w), (w / n) if words else 0.0, 1.0 if same > 0.2 else 0.0,
    ]


def _spread(h: np.ndarray, slots: int) -> np.ndarray:
    """Roots of the shares of each slot."""
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    n = np.bincount((h ^ (h >> np.uint32(12))) % np.uint32(slots), minlength=slots)
    return np.sqrt(n / max(1, n.sum()))


def text_view(text: str) -> np.ndarray:
    """The shares, hashed words and hashed runs of four bytes of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(N_TEXT)
    out[:N_SHARES] = text_shares(data, np.bincount(raw, minlength=256))
    if not len(raw):
        return out
    low = _LOWER[raw]
    inside = ~_SPACE[raw]
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    if len(starts):
        # a word's hash sums its bytes, each times a power for its place
        begun = np.zeros(len(raw), np.int64)
        begun[starts[1:]] = np.diff(starts)
        place = (np.arange(len(raw)) - starts[0] - np.cumsum(begun)) & 63
        out[N_SHARES : N_SHARES + WORD_SLOTS] = _spread(np.add.reduceat(np.where(inside, low, 0).astype(np.uint32) * _POWERS[place], starts, dtype=np.uint32), WORD_SLOTS)
    if len(low) >= 4:
        wide = low.astype(np.uint32)
        out[N_SHARES + WORD_SLOTS :] = _spread(wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24)), GRAM_SLOTS)
    return out


def meta_view(lang: str | None, source: str | None, size: int | None) -> np.ndarray:
    """Language and source as hashed indicators, size on a log scale."""
    out = np.zeros(N_META)
    out[zlib.crc32(b"" if lang is None else b"=" + lang.encode("utf-8", "surrogatepass")) % LANG_SLOTS] = 1.0
    out[LANG_SLOTS + zlib.crc32(b"" if source is None else b"=" + source.encode("utf-8", "surrogatepass")) % SOURCE_SLOTS] = 1.0
    log = np.log1p(max(0, size)) if size is not None else 0.0
    out[-4:] = [log / 10, (log / 10) ** 2, 1.0 if size is None else 0.0, 1.0 if size is not None and size < 100 else 0.0]
    return out


# --- models ----------------------------------------------------------------------


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton steps for a ridge logistic model; the last coefficient is the constant."""
    x = np.column_stack((x, np.ones(len(x))))
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (weight * (y - p)) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def logit(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(x @ b[:-1] + b[-1], -30, 30)


class View:
    """A ridge logistic model over the labelled rows of one view, and the sums of its pseudo-labelled rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25):
        self.x, self.y = np.column_stack((x, np.ones(len(x)))), y
        self.penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
        self.b = np.zeros(x.shape[1] + 1)
        self.newton(steps=steps)

    def newton(self, n: int = 0, slope: np.ndarray | None = None, curve: np.ndarray | None = None, steps: int = 6) -> None:
        """Newton steps over the labelled rows and, as a parabola around the present model, the ``n`` pseudo-labelled ones.

        Pseudo-labels weigh less than labels, and together at most as much.
        """
        weight = min(0.5, len(self.y) / n) if n else 0.0
        start = self.b.copy()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.x @ self.b, -30, 30)))
            h = (self.x.T * (p * (1 - p))) @ self.x + np.diag(self.penalty + 1e-9)
            g = self.x.T @ (self.y - p) - self.penalty * self.b
            if n:
                h = h + weight * curve
                g = g + weight * (slope - curve @ (self.b - start))
            step = np.linalg.solve(h, g)
            self.b = self.b + step
            if np.abs(step).max() < 1e-8:
                break


def pseudo_sums(x: np.ndarray, b: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of a logistic model over rows with pseudo-labels."""
    x = np.column_stack((x, np.ones(len(x))))
    p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    return x.T @ (target - p), (x.T * (p * (1 - p))) @ x


def confident(x: np.ndarray, b: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a model is sure about, and what it takes them for."""
    p = 1 / (1 + np.exp(-logit(x, b)))
    rows = np.flatnonzero((p >= sure) | (p <= 1 - sure))
    return rows, (p[rows] >= 0.5).astype(float)


#: Standard errors by which a view has to beat chance on the held rows to give pseudo-labels away.
BEYOND_CHANCE = 3.0


def ranking(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Area under the curve of a score, and by how many standard errors it is better than chance."""
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n1 = float(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return 0.5, 0.0
    area = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    return float(area), float((area - 0.5) / np.sqrt((n1 + n0 + 1) / (12 * n1 * n0)))


def finish(views: dict[str, View], held: dict[str, np.ndarray], y: np.ndarray) -> dict:
    """Calibrate each view on the held rows and combine the calibrated views."""
    calibrated = {v: logistic(logit(held[v], m.b)[:, None], y, ridge=0.01) for v, m in views.items()}
    both = np.column_stack([logit(logit(held[v], views[v].b)[:, None], calibrated[v]) for v in ("text", "meta")])
    return {"model": {v: m.b for v, m in views.items()}, "calibrated": calibrated, "combine": logistic(both, y, ridge=0.1), "area": {v: ranking(logit(held[v], m.b), y)[0] for v, m in views.items()}}


def _scores(fit: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = logit(logit((text - fit["center"]) / fit["scale"], fit["model"]["text"])[:, None], fit["calibrated"]["text"])
    b = logit(logit(meta, fit["model"]["meta"])[:, None], fit["calibrated"]["meta"])
    c = logit(np.column_stack((a, b)), fit["combine"])
    return tuple(1 / (1 + np.exp(-v)) for v in (a, b, c))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_view(t) for t in texts(batch, "text")]).reshape(-1, N_TEXT)
    meta = [meta_view(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
    return text, np.array(meta).reshape(-1, N_META)


def _slim(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def exchange(docs: DataFrame, center: np.ndarray, scale: np.ndarray, models: dict[str, np.ndarray], speaks: set[str], sure: float) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """One round over all documents: for each view the number, slope and curvature of the rows that the other one, if it ``speaks``, is sure about.

    Every task sums its rows first; the sums are added up by matrix row.
    """
    sizes = {"text": N_TEXT + 1, "meta": N_META + 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: np.zeros((k + 1, k + 1)) for v, k in sizes.items()}  # curvature, then the slope; the last place counts rows
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                text, meta = _views(batch.slice(at, 1000))
                views = {"text": (text - center) / scale, "meta": meta}
                for v, other in (("text", "meta"), ("meta", "text")):
                    if v not in speaks:
                        continue
                    rows, target = confident(views[v], models[v], sure)
                    slope, curve = pseudo_sums(views[other][rows], models[other], target)
                    total[other][:-1, :-1] += curve
                    total[other][-1, :-1] += slope
                    total[other][-1, -1] += len(rows)
        for v, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(m)), pa.array(np.arange(len(m)), pa.int64()), pa.array([r.tobytes() for r in m], pa.binary())], ["view", "row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for v, row, sums in zip(*(batch.column(c).to_pylist() for c in ("view", "row", "sums"))):
                x = np.frombuffer(sums)
                total[v, row] = total[v, row] + x if (v, row) in total else x
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in total], pa.string()), pa.array([r for _, r in total], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["view", "row", "sums"])

    schema = "view string, row long, sums binary"
    parts = _slim(docs).mapInArrow(run, schema).repartition(partitions(docs.sparkSession), "view", "row").mapInArrow(add, schema)
    out = {v: np.zeros((k + 1, k + 1)) for v, k in sizes.items()}
    for r in parts.collect():
        out[r["view"]][r["row"]] = np.frombuffer(r["sums"])
    return {v: (int(round(m[-1, -1])), m[-1, :-1], m[:-1, :-1]) for v, m in out.items()}


def fit_views(docs: DataFrame, labels: DataFrame, label_col: str = "quality", label_rows: int = 10_000, rounds: int = 2, sure: float = 0.98, ridge: float = 10.0) -> dict | None:
    """Fit both views with exchanged pseudo-labels; None without labels of both kinds.  Every fourth labelled row is kept for calibration.

    The result tells the area under the curve of each view on the held rows, and
    how many pseudo-labels each one got in each round.
    """
    need(labels, "doc_id", label_col)
    y = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    some = F.broadcast(cut(y.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)))  # at most label_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array([r.tobytes() for r in np.column_stack(_views(batch))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), flat], ["doc_id", "y", "x"])

    rows = _slim(docs).join(some, "doc_id").mapInArrow(run, "doc_id long, y int, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "x"], kind="stable").drop_duplicates("doc_id")
    rows = rows.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in rows["doc_id"]], kind="stable")]
    label = rows["y"].to_numpy().astype(float)
    if len(set(label)) < 2:
        return None
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), np.float64).reshape(-1, N_TEXT + N_META)
    hold = np.arange(len(label)) % 4 == 3
    if len(set(label[hold])) < 2 or len(set(label[~hold])) < 2:
        hold = np.zeros(len(label), bool)
    on = hold if hold.any() else ~hold
    center, scale = x[:, :N_TEXT].mean(axis=0), np.maximum(x[:, :N_TEXT].std(axis=0), 1e-3)
    every = {"text": (x[:, :N_TEXT] - center) / scale, "meta": x[:, N_TEXT:]}
    views = {v: View(every[v][~hold], label[~hold], r) for v, r in (("text", ridge), ("meta", 1.0))}
    told = []
    for _ in range(rounds):
        speaks = {v for v, m in views.items() if ranking(logit(every[v][on], m.b), label[on])[1] > BEYOND_CHANCE}
        if not speaks:
            break
        got = exchange(docs, center, scale, {v: m.b for v, m in views.items()}, speaks, sure)
        for v, sums in got.items():
            views[v].newton(*sums)
        told.append({v: n for v, (n, _, _) in got.items()})
    return {"center": center, "scale": scale, "pseudo_labels": told} | finish(views, {v: z[on] for v, z in every.items()}, label[on])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label_col: str = "quality", **how) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score``, ``quality_score`` and ``keep`` (score at or over the threshold)."""
    need(docs, *COLUMNS)
    docs = docs.drop("text_score", "meta_score", "quality_score", "keep")
    fit = fit_views(docs, labels, label_col, **how)
    added = "text_score double, meta_score double, quality_score double"
    # columns of other types are cast beside the originals; the usual ones travel once
    wanted = {"text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    view = {c: c if dict(docs.dtypes)[c] == kind else f"_view_{c}" for c, kind in wanted.items()}
    spread = docs.withColumns({v: F.col(c).cast(wanted[c]) for c, v in view.items() if v != c})
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(view[c]) for c in COLUMNS[1:]], list(COLUMNS[1:]))
            scores = _scores(fit, *_views(own)) if fit else [np.ones(batch.num_rows)] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(s, pa.float64()) for s in scores)], [*names, "text_score", "meta_score", "quality_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return spread.mapInArrow(run, f"{schema}, {added}").withColumn("keep", F.col("quality_score") >= threshold)
