"""Toxicity of text after noisy-channel deobfuscation.

A character trigram model is counted over the words of the whole corpus.  Words
that may be disguised (with digits or signs, letters spelled out with
spaces, repeated letters, words broken in two) become lattices: each place holds
what the writer may have meant, with a channel cost.  A gap is a place of its
own: it may be a word border or nothing.  A Viterbi pass takes the likeliest
reading under the character model.  The restored words and their beginnings
are the features of a model learned from the labelled rows of the
training folds; only texts go into a score.

The character model covers the whole corpus.  The classifier is fitted on at
most ``fit_rows`` labelled rows, chosen by a hash of the id, and keeps
every feature with enough evidence for or against.

Edge cases: null and empty texts get the score of a text without features;
without labels of both kinds every score is 0; rows with a null id are not held
out; duplicated rows each get a row; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, need, texts
from gristmill.llm.quality import logistic

# --- character model -------------------------------------------------------

LETTERS = 32  # 0: word border, 1-26: a to z, 27: other letters, 28: everything else
CODE = np.full(256, 28, np.uint8)
CODE[[9, 10, 11, 12, 13, 32]] = 0
CODE[97:123] = np.arange(1, 27)
CODE[65:91] = np.arange(1, 27)
CODE[128:] = 27


def trigram_counts(docs: DataFrame, text_col: str = "text", slice_rows: int = 500) -> np.ndarray:
    """Counts of character trigrams over all texts; LETTERS**3 numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                data = "  ".join(["", *texts(batch.slice(at, slice_rows), "text"), ""]).encode("utf-8", "surrogatepass")
                c = CODE[np.frombuffer(data, np.uint8)].astype(np.int32)
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["code", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LETTERS**3, np.int64)
    for r in rows:
        out[r["code"]] = r["n"]
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a character after two others, smoothed by shorter histories."""
    c = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    two, one = c.sum(axis=0), c.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + LETTERS)
    p2 = (two + 10 * p1) / (two.sum(axis=1, keepdims=True) + 10)
    return np.log((c + 5 * p2[None]) / (c.sum(axis=2, keepdims=True) + 5))


# --- channel ---------------------------------------------------------------

#: What a sign may stand for (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
DROPPED = set(".-_*~'`^,:;/\\")
SPELLED = re.compile(r"(?<![^\W_])(?<![^\W_]['’])(?:[^\W_]|[0-9@$!|+(])(?:[ .\-_*]+(?:[^\W_]|[0-9@$!|+(])(?![^\W_])){2,}")
#: What every spelled run has in it, found sooner.
TWO_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_]|[0-9@$!|+(])[ .\-_*]+(?:[^\W_]|[0-9@$!|+(])[ .\-_*]")
GAP = re.compile(r"[ .\-_*]+")
TRIM = ".,;:!?\"'()[]{}<>%#*&|~`^_+=/\\$-"


#: Gaps in a lattice: between spelled letters, and wider than those.
GAP_SPELLED, GAP_WIDE = " ", "\n"


def _code(x: str) -> int:
    return 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else 27 if x.isalpha() else 28


def offers_of(ch: str, before: str, keep: float = -1.5, swap: float = -1.0, drop: float = -0.5) -> list[tuple[str, float]]:
    """What a place may mean, with its cost: what it shows, what it looks like, a border, or nothing."""
    if ch == GAP_SPELLED:
        return [("", 0.0), (" ", 0.0)]
    if ch == GAP_WIDE:
        return [(" ", 0.0), ("", 4 * swap)]
    if ch.isalpha():
        return [(ch, 0.0), ("", drop)] if ch == before else [(ch, 0.0)]
    out = [(x, swap) for x in LOOKS.get(ch, "")] + [(ch, 4 * keep)]
    return [*out, ("", drop)] if ch in DROPPED or ch == before else out


@lru_cache(maxsize=4096)
def _coded_offers(ch: str, repeats: bool) -> list[tuple[str, int, float]]:
    return [(x, _code(x) if x else -1, cost) for x, cost in offers_of(ch, ch if repeats else "")]


def _likeliest(paths: dict[tuple[int, int], tuple[float, tuple | None]], model: np.ndarray) -> tuple[float, str]:
    """The best path's score and text; paths are chains of (path before, piece), so that long words cost in proportion."""
    ends = [(s + (float(model[a][b][0]) if b else 0.0), r) for (a, b), (s, r) in paths.items()]
    best = max(s for s, _ in ends)

    def text(chain: tuple | None) -> str:
        out = []
        while chain is not None:
            chain, piece = chain
            out.append(piece)
        return "".join(reversed(out))

    return best, max(text(r) for s, r in ends if s == best)


def viterbi(word: str, model: np.ndarray) -> tuple[float, str]:
    """Score and text of the likeliest reading of one lattice under a model (an array or nested lists); states are the last two letters read, a border being one of them."""
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for ch in word:
        offers = _coded_offers(ch, ch == before)
        before = ch
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, read) in paths.items():
            after = model[a][b]
            for x, c, cost in offers:
                if c < 0:
                    key, value = (a, b), (score + cost, read)
                elif c == 0 and b == 0:
                    continue  # no border after a border
                else:
                    key, value = (b, c), (score + cost + after[c], (read, x))
                if key not in new or value[0] > new[key][0]:
                    new[key] = value
        paths = new
    return _likeliest(paths, model)


class Restorer:
    """Words of a text with disguised ones restored; remembers what it has read, within bounds."""

    def __init__(self, model: np.ndarray, most: int = 300_000):
        self.model, self.most, self.seen = model.tolist(), most, {}
        self.gaps: dict[str, bool] = {}

    def _read(self, word: str) -> str:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= self.most:
                self.seen = {}
            got = self.seen[word] = viterbi(word, self.model)[1]
        return got

    def _read_run(self, run: str) -> list[str]:
        """Words of a spelled-out run: the likeliest reading with borders, and that of each stretch as one word."""
        gaps = GAP.findall(run)
        usual = min(map(len, gaps))
        marks = [GAP_WIDE if len(g) > usual else GAP_SPELLED for g in gaps]
        lattice = "".join(x for pair in zip(GAP.split(run), [*marks, ""]) for x in pair)
        stretches = lattice.replace(GAP_SPELLED, "").split(GAP_WIDE)
        return [*self._read(lattice).split(), *map(self._read, stretches)]

    def _one_word(self, left: str, right: str) -> bool:
        """Whether the gap between two words is likelier nothing than a border: the lattice of the four letters around it."""
        m = self.model
        a, b = (0, _code(left[-1])) if len(left) < 2 else (_code(left[-2]), _code(left[-1]))
        c, d = _code(right[0]), 0 if len(right) < 2 else _code(right[1])
        return m[a][b][c] + m[b][c][d] - BROKEN > m[a][b][0] + m[b][0][c] + m[0][c][d]

    def alone(self, word: str) -> tuple[tuple[str, ...], bool]:
        """The readings of one word by itself, and whether it may be the left part of a broken one."""
        if word.isalpha():
            doubled = _doubled(word)
            # the beginning of a longer word is a feature of its own
            short = len(word) < STEMS[-1]
            if not doubled:
                return (word,), short
            return (self._read(word),) if _tripled(word) else (word, self._read(word)), short
        core = word.strip(TRIM)
        # signs at the ends may be letters or mere punctuation
        bare = word.strip(".,;:?\"'()[]{}<>%#*&~`^_=/\\-")
        out = {core, *(self._read(x) for x in {bare, core} if x and (not x.isalpha() or _doubled(x)))}
        return tuple(w for w in out if w), False

    def runs(self, text: str) -> list[list[str]]:
        """The words of each spelled-out run."""
        return [self._read_run(m[0]) for m in SPELLED.finditer(text)] if TWO_SPELLED.search(text) else []

    def joined(self, left: str, right: str) -> str | None:
        """The word that two words are likelier to be, if they are."""
        key = left[-2:] + " " + right[:2]
        got = self.gaps.get(key)
        if got is None:
            if len(self.gaps) >= self.most:
                self.gaps.clear()
            got = self.gaps[key] = not key.replace(" ", "").isalpha() or self._one_word(left, right)
        if got:
            right = right if right.isalpha() else right.strip(TRIM)
            if right.isalpha() and self._one_word(left, right):
                return left + right
        return None

    def words(self, text: str) -> set[str]:
        text = text.lower()
        out = {w for run in self.runs(text) for w in run}
        row = text.split()
        lefts = set()
        for word in set(row):
            found, left = self.alone(word)
            out.update(found)
            if left:
                lefts.add(word)
        out.update(self.joined(left, right) or "" for left, right in zip(row, row[1:]) if left in lefts)
        out.discard("")
        return out


#: What it costs to take the gap between two words for nothing.
BROKEN = 4.0
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")


def _doubled(word: str) -> bool:
    return _DOUBLE.search(word) is not None


def _tripled(word: str) -> bool:
    return _TRIPLE.search(word) is not None


STEMS = (4, 5, 6)


def features_of(words: set[str]) -> set[str]:
    """Whole words, and beginnings of 4 to 6 characters (marked by a trailing star)."""
    out = set(words)
    for k in STEMS:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    return out


# --- learning --------------------------------------------------------------


def fold(ident: Column, folds: int = 5) -> Column:
    return F.crc32(ident.cast("long").cast("string").cast("binary")) % folds


def _training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``fit_rows`` labelled rows outside the held-out fold, chosen by a hash of the id.

    The chosen ids are broadcast, so no text is shuffled.
    """
    y = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    y = y.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id")


def _feature_counts(rows: DataFrame, model: np.ndarray, slice_rows: int = 1000) -> DataFrame:
    """``(f, k1, k)``: in how many toxic and in how many training rows a feature is; summed up per slice of rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                for t, y in zip(texts(part, "text"), part.column("y").to_pylist()):
                    counts[y].update(features_of(restore.words(t)))
                names = list(counts[0].keys() | counts[1].keys())
                k1 = [counts[1][f] for f in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(k1, pa.int64()), pa.array([counts[0][f] + n for f, n in zip(names, k1)], pa.int64())], ["f", "k1", "k"]
                )

    return rows.mapInArrow(run, "f string, k1 long, k long").groupBy("f").agg(F.sum("k1").alias("k1"), F.sum("k").alias("k"))


def _feature_sets(rows: DataFrame, model: np.ndarray, place: dict[str, int]) -> DataFrame:
    """``(doc_id, y, at)``: which of the chosen features each training row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            at = [sorted(place[f] for f in features_of(restore.words(t)) if f in place) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "y", "at"])

    return rows.mapInArrow(run, "doc_id long, y int, at array<int>")


def _inputs(odds: np.ndarray) -> list[float]:
    """What the final model sees of the features of one text: the strongest one, and whether there are any.

    One sure word makes a text toxic, however much else it says.
    """
    return [float(odds.max()), 0.0] if len(odds) else [0.0, 1.0]


NONE = float("-inf")


class Scorer:
    """Log odds of the chosen features, and the final model over them."""

    def __init__(self, odds: dict[str, float], final: np.ndarray):
        self.odds, self.final = odds, final

    def strongest(self, words: Iterable[str]) -> float:
        """The largest log odds among the features of words."""
        return max((self.odds[f] for f in features_of(set(words)) if f in self.odds), default=NONE)

    def of_strongest(self, best: float) -> float:
        x = _inputs(np.array([best] if best > NONE else []))
        return float(1 / (1 + np.exp(-np.clip(np.dot(x, self.final[:-1]) + self.final[-1], -30, 30))))

    def score(self, words: set[str]) -> float:
        return self.of_strongest(self.strongest(words))


class TextScorer:
    """Scores of whole texts: what ``Scorer`` says of the words of ``Restorer``, without gathering them.

    Remembers of each word, within bounds, the strongest feature of its
    readings, its letters before a gap if it may be the left part of a broken
    word, and its letters after a gap.
    """

    def __init__(self, scorer: Scorer, restore: Restorer):
        self.scorer, self.restore = scorer, restore
        self.known: dict[str, tuple[float, str | None, str]] = {}

    def _entry(self, word: str) -> tuple[float, str | None, str]:
        readings, left = self.restore.alone(word)
        return self.scorer.strongest(readings), word[-2:] + " " if left else None, word[:2]

    def score(self, text: str) -> float:
        text = text.lower()
        row = text.split()
        best, scorer, restore = NONE, self.scorer, self.restore
        for run in restore.runs(text):
            best = max(best, scorer.strongest(run))
        if len(self.known) >= restore.most:
            self.known = {}
        known = self.known
        for word in set(row).difference(known):
            known[word] = self._entry(word)
        info = [known[w] for w in row]
        best = max(best, max((i[0] for i in info), default=NONE))
        gaps = restore.gaps
        for k, (a, b) in enumerate(zip(info, info[1:])):
            tail = a[1]
            if tail is not None and gaps.get(tail + b[2], True):
                joined = restore.joined(row[k], row[k + 1])
                if joined:
                    best = max(best, scorer.strongest((joined,)))
        return scorer.of_strongest(best)


def _evidence(n1: float, n0: float) -> Column:
    """Root of the likelihood-ratio statistic of a feature against the label."""
    k1, k0 = F.col("k1").cast("double"), (F.col("k") - F.col("k1")).cast("double")
    share = F.col("k") / F.lit(n1 + n0)
    term = lambda seen, n: F.when(seen > 0, seen * F.log(seen / (share * n))).otherwise(0.0) + F.when(n - seen > 0, (n - seen) * F.log((n - seen) / ((1 - share) * n))).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (term(k1, F.lit(n1)) + term(k0, F.lit(n0)))))


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, fit_rows: int = 16_000, least: float = 2.5) -> Scorer | None:
    """Keep every feature with evidence of ``least`` or more, then fit the model over them.

    What comes to the driver is bounded by ``fit_rows`` and the words of as many texts.
    """
    rows = cut(_training_rows(docs, labels, fit_rows))
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(totals) < 2:
        return None
    counts = _feature_counts(rows, model).withColumn("z", F.round(_evidence(float(totals[1]), float(totals[0])), 6))
    best = {r["f"]: (r["k1"], r["k"]) for r in counts.where(F.col("z") >= least).collect()}
    names = sorted(best)
    data = _feature_sets(rows, model, {f: k for k, f in enumerate(names)}).collect()
    data.sort(key=lambda r: (r["doc_id"], r["y"], r["at"]))
    return _fit([r["at"] for r in data], np.array([r["y"] for r in data], float), names, np.array([best[f] for f in names], float).reshape(-1, 2))


def _fit(sets: list[list[int]], y: np.ndarray, names: list[str], counts: np.ndarray) -> Scorer:
    """Log odds of each feature, and a logistic model over the strongest ones of a text.

    While fitting, a text is taken out of the counts of its own features, so a
    rare feature is not trusted for the texts it was counted on.
    """
    share = y.mean()
    odds = lambda k1, k: np.log((k1 + share) / (k - k1 + 1 - share))
    k1, k = counts[:, 0], counts[:, 1]
    x = np.array([_inputs(odds(k1[s] - t, k[s] - 1)) for s, t in zip(sets, y)]).reshape(-1, 2)
    return Scorer(dict(zip(names, odds(k1, k).tolist())), logistic(x, y, ridge=0.1, steps=25))


def toxicity_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    model = log_model(trigram_counts(docs))
    scorer = learn(docs, labels, model, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = TextScorer(scorer, Restorer(model)) if scorer else None
        for batch in batches:
            scores = [whole.score(t) if whole else 0.0 for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
