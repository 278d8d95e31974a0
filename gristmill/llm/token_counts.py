"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links; every node also holds how
many pieces are popped when its failure link is taken, so the greedy
longest-match-first piece count of a word comes out of one pass over its bytes
without building any piece (Song et al., "Fast WordPiece Tokenization", 2021).
All distinct words of an Arrow batch run through the automaton side by side
with numpy, and documents add up the counts of their words.

Edge cases: null and empty texts have 0 words and 0 tokens; a word that the
vocabulary cannot cover counts as one unknown token; duplicated rows each get
a row; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import need, texts


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies use for bytes, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Pieces of a byte-level tokenizer file as bytes, with their ids; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if piece not in special}


class LongestMatch:
    """Trie, failure links and popped counts as arrays.

    ``initial`` pieces may start a word and ``continuation`` pieces may follow;
    give the same set twice where the vocabulary does not tell them apart.
    """

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes] | None = None):
        children: list[dict[int, int]] = [{}]
        piece = [False]

        def grow(root: int, pieces: Iterable[bytes]) -> None:
            for p in pieces:
                if not p:
                    continue
                u = root
                for b in p:
                    v = children[u].get(b)
                    if v is None:
                        v = children[u][b] = len(children)
                        children.append({})
                        piece.append(False)
                    u = v
                piece[u] = True

        grow(0, initial)
        rest = 0
        if continuation is not None:
            rest = len(children)
            children.append({})
            piece.append(False)
            grow(rest, continuation)
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = list(dict.fromkeys((0, rest)))
        for u in queue:
            for b, v in children[u].items():
                queue.append(v)
                if piece[v]:
                    fail[v], popped[v] = rest, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and b not in children[z]:
                    z, n = fail[z], n + popped[z]
                if z >= 0:
                    fail[v], popped[v] = children[z][b], n
        self.rest, self.fail, self.popped = rest, np.array(fail, np.int32), np.array(popped, np.int32)
        keys = np.array([u * 256 + b for u, c in enumerate(children) for b in c], np.int64)
        to = np.array([v for c in children for v in c.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(state), -1, np.int32)
        want = state.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, -1 where the vocabulary cannot cover it."""
        order = np.argsort(np.array([len(w) for w in words], np.int64), kind="stable")[::-1]
        lengths = np.array([len(words[k]) for k in order], np.int64)
        flat = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
        start, falling = np.concatenate(([0], np.cumsum(lengths)))[:-1], -lengths
        state, n = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        for i in range(int(lengths[0]) if len(words) else 0):
            live = np.flatnonzero(state[: np.searchsorted(falling, -i, "left")] >= 0)
            byte = flat[start[live] + i]
            while len(live):
                u = state[live]
                v = self._step(u, byte)
                hit = v >= 0
                state[live[hit]] = v[hit]
                live, byte, u = live[~hit], byte[~hit], u[~hit]
                n[live] += self.popped[u]
                state[live] = self.fail[u]
                ok = state[live] >= 0
                live, byte = live[ok], byte[ok]
        live = np.flatnonzero((state > 0) & (state != self.rest))
        while len(live):
            u = state[live]
            n[live] += self.popped[u]
            state[live] = self.fail[u]
            live = live[(state[live] > 0) & (state[live] != self.rest)]
        n[state < 0] = -1
        out = np.empty(len(words), np.int32)
        out[order] = n
        return out


def token_counts(docs: DataFrame, automaton: LongestMatch, id_col: str = "doc_id", text_col: str = "text", prefix: bytes = b" ") -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_unknown)`` of every whole text.

    Words are runs of characters other than ASCII white space; ``prefix`` stands
    for the space before a word in vocabularies that mark word starts with it.
    The automaton is a few MB, bounded by the vocabulary, and is broadcast.
    """
    need(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            index: dict[bytes, int] = {}
            rows = [[index.setdefault(w, len(index)) for w in t.encode("utf-8", "surrogatepass").split()] for t in texts(batch, "text")]
            per = machine.counts([prefix + w for w in index])
            unknown = per < 0
            per = np.where(unknown, 1, per)
            ids = [np.array(r, np.int64) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in ids], pa.int64()), pa.array([int(per[r].sum()) for r in ids], pa.int64()), pa.array([int(unknown[r].sum()) for r in ids], pa.int64())],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        count, "doc_id long, n_words long, n_tokens long, n_unknown long"
    )
