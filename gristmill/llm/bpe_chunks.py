"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text places chunk borders, so a passage that
many documents share falls into the same chunks wherever it stands.  A worker
encodes each distinct chunk once and keeps the ids in a bounded store.  The ids
of neighbouring chunks are then joined: the seam is re-encoded over a window
that starts and ends at a certain word border, and the window widens until its
outermost words come out with exactly the ids they had in their chunks.

A certain word border is a visible character followed by a single space and a
visible ASCII character: no pre-token of the byte-level pattern reaches across
it, whatever stands further left or right.  A cut without enough such borders
on both sides is not made, so text without spaces is one chunk.

Edge cases: null and empty texts have 0 tokens and the hash of the empty
string; special-token strings inside a text become that token, as the
tokenizers library does it; duplicated rows each get a row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import need, texts
from gristmill.llm.token_counts import byte_vocabulary

#: The published pre-token pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16  # bytes under the rolling hash


def chunk_borders(data: bytes, bits: int = 10, least: int = 6) -> tuple[list[tuple[int, int]], list[int]]:
    """Cuts set by the content, and the certain word borders.

    Each cut comes with the number of certain borders before it.  A chunk has
    2**bits bytes on average and at least ``least`` certain borders; cuts are
    never inside a character.  The hash of the last 16 bytes is built by
    doubling: a window of 2w is two windows of w, one of them shifted.
    """
    if len(data) <= 4 * WINDOW:
        return [], []
    raw = np.frombuffer(data, np.uint8)
    visible = (raw > 32) & (raw != 127)
    certain = np.flatnonzero((raw[1:-1] == 32) & visible[:-2] & visible[2:] & (raw[2:] < 127)) + 1
    h = _gear()[raw]
    w = 1
    while w < WINDOW:
        h[w:] = h[w:] + (h[:-w] << np.uint64(w))
        w *= 2
    at = np.flatnonzero((h[WINDOW - 1 : -1] >> np.uint64(40)) & np.uint64((1 << bits) - 1) == 0) + WINDOW
    at = at[(raw[at] & 0xC0) != 0x80]
    cuts, last = [], 0
    for cut, k in zip(at.tolist(), np.searchsorted(certain, at).tolist()):
        if k - last >= least and len(certain) - k >= least:
            cuts.append((cut, k))
            last = k
    return cuts, certain.tolist()


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20240601).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class ChunkedBPE:
    """Encoder and decoder for a byte-level tokenizer file, with a bounded store of encoded chunks."""

    def __init__(self, path: str, bits: int = 10, store_bytes: int = 48 << 20, encode=None):
        vocabulary = byte_vocabulary(path)
        with open(path, encoding="utf-8") as f:
            special = {x["content"]: int(x["id"]) for x in json.load(f).get("added_tokens", [])}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.piece = {k: p for p, k in vocabulary.items()} | {k: c.encode() for c, k in special.items()}
        self.length = {k: len(p) for k, p in self.piece.items()}
        self.encode_text = encode or tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
        self.bits, self.room, self.store_bytes = bits, store_bytes, store_bytes
        self.store: dict[bytes, list[int]] = {}

    def _chunk(self, data: bytes) -> list[int]:
        ids = self.store.get(data)
        if ids is None:
            ids = self.encode_text(data.decode("utf-8", "surrogatepass"))
            self.room -= 200 + 10 * len(data)  # what the entry takes, roughly
            if self.room < 0:
                self.store, self.room = {}, self.store_bytes
            self.store[data] = ids
        return ids

    def _index(self, ids: list[int], at: int) -> int:
        """Index of the token that starts at byte ``at``; -1 if none does."""
        k = place = 0
        while place < at and k < len(ids):
            place += self.length[ids[k]]
            k += 1
        return k if place == at else -1

    def _index_back(self, ids: list[int], left: int) -> int:
        """As ``_index``, counted as ``left`` bytes back from the end."""
        k, place = len(ids), 0
        while place < left and k:
            k -= 1
            place += self.length[ids[k]]
        return k if place == left else -1

    def _seam(self, data: bytes, cut: int, left: list[int], right: list[int], before: list[int], after: list[int]) -> tuple[int, list[int], int] | None:
        """How two chunks meet: tokens of ``left`` that stay, the re-encoded window, tokens of ``right`` it replaces.

        ``before`` and ``after`` are the certain word borders on either side of
        the cut, nearest first.  None if no window agrees.
        """
        for n in range(1, min(len(before), len(after))):
            p, a, b, q = before[n], before[n - 1], after[n - 1], after[n]
            i, ia = self._index_back(left, cut - p), self._index_back(left, cut - a)
            j, jb = self._index(right, q - cut), self._index(right, b - cut)
            if min(i, ia, j, jb) < 0:
                continue
            window = self.encode_text(data[p:q].decode("utf-8", "surrogatepass"))
            if window[: ia - i] == left[i:ia] and window[len(window) - (j - jb) :] == right[jb:j]:
                return i, window, j
        return None

    def _segment(self, data: bytes) -> list[int]:
        cuts, certain = chunk_borders(data, self.bits)
        borders = [0, *(c for c, _ in cuts), len(data)]
        chunks = [self._chunk(data[a:b]) for a, b in zip(borders, borders[1:])]
        if len(chunks) == 1:
            return list(chunks[0])
        out, start = [], 0
        for n, (cut, k) in enumerate(cuts):
            low = cuts[n - 1][1] if n else 0
            high = cuts[n + 1][1] if n + 1 < len(cuts) else len(certain)
            met = self._seam(data, cut, chunks[n], chunks[n + 1], certain[low:k][::-1], certain[k:high])
            if met is None or met[0] < start:  # the chunks cannot be reconciled: encode without reuse
                return self.encode_text(data.decode("utf-8", "surrogatepass"))
            out += chunks[n][start : met[0]]
            out += met[1]
            start = met[2]
        out += chunks[-1][start:]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._segment(part.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _coder(path: str, bits: int) -> tuple[ChunkedBPE, dict[int, str]]:
    coder = ChunkedBPE(path, bits)
    return coder, {k: str(k) for k in coder.piece}


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bits: int = 10, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text, plus ``ids`` if asked for.

    ``path`` is the tokenizer file, present on every machine.
    """
    need(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = _coder(path, bits)
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for text in texts(batch, "text"):
                ids = coder.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    )
