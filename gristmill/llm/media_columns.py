"""Media columns: content-addressed payloads in tar shards.

Each task packs the payloads of its rows into one tar shard in the shared
folder, once per digest, as lossless 8-bit grey images.  Rows carry digest,
shard, offset and length.  A header-only range read (the image header at the
offset) fills the metadata columns; a full range read gives the payload back.

Shard names are unique per task attempt and a shard is complete before its
task succeeds, so a lost executor only leaves an unreferenced file behind.
Where tasks packed the same digest, all rows are pointed to one of the copies.
Shards stay in the shared folder for whoever reads the rows; its owner clears it.

Edge cases: null text is empty; an empty text is one block of filler; equal
texts have equal values in every column but the id; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, need, partitions, texts
from gristmill.session import shared_folder

BLOCK = 576
STRETCH = 4 << 20  # bytes of a shard that one task reads in a row
HEADER_BYTES = 33  # signature and header chunk of the image format
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PACKED = (
    "doc_id long, n_bytes long, payload_bytes long, digest string, media_bytes long, media_sha256 string,"
    " shard string, offset long"
)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_grey(payload: bytes, width: int = BLOCK) -> bytes:
    """A lossless 8-bit grey image whose rows are ``width`` bytes of the payload each."""
    rows = len(payload) // width
    raw = np.zeros((rows, width + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, width)
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first bytes of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not an image header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def decode_grey(image: bytes) -> np.ndarray:
    """The samples of an image written by ``encode_grey``, checked against its checksums."""
    width, height, _ = read_header(image[:HEADER_BYTES])
    at, data = HEADER_BYTES, b""
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, part = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        data += part if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation, filler share and a 64-bit average hash over an 8 x 8 grid of the flattened samples."""
    flat = samples.reshape(-1)
    cells = np.add.reduceat(flat, np.arange(64) * len(flat) // 64, dtype=np.int64) * 64
    bits = int("".join("1" if x else "0" for x in cells > flat.sum(dtype=np.int64)), 2)
    mean, std = flat.mean(dtype=np.float64), flat.std(dtype=np.float64)
    return f"mean={mean:.6f};std={std:.6f};filler={float((flat == 255).mean()):.6f};ahash={bits:016x}"


def pack_payloads(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack texts into shards in ``folder``; one row per document with digest, shard name, offset and lengths."""
    need(docs, id_col, text_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        filesystem.create_dir(root, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.tar"
        done: dict[str, tuple[int, int, str]] = {}
        out = tar = None
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in texts(batch, "text"):
                data = text.encode("utf-8", "surrogatepass")
                payload = data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in done:
                    if tar is None:
                        out = filesystem.open_output_stream(f"{root}/{name}")
                        tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
                    image = encode_grey(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(image)
                    done[digest] = (tar.offset + 512, len(image), hashlib.sha256(image).hexdigest())
                    tar.addfile(info, io.BytesIO(image))
                offset, n, sha = done[digest]
                for col, x in zip(cols, (len(data), len(payload), digest, n, sha, name, offset)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())))],
                ["doc_id", "n_bytes", "payload_bytes", "digest", "media_bytes", "media_sha256", "shard", "offset"],
            )
        if tar is not None:
            tar.close()
            out.close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, PACKED)


class _Ranges:
    """Range reads over shards, with the shard last used kept open."""

    def __init__(self) -> None:
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, n: int) -> bytes:
        if shard != self.name:
            self.close()
            filesystem, path = pafs.FileSystem.from_uri(shard) if "://" in shard or shard.startswith("file:") else (pafs.LocalFileSystem(), shard)
            self.name, self.file = shard, filesystem.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(n)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _reading(df: DataFrame, added: str, row) -> DataFrame:
    names = [x.split()[0] for x in added.split(", ")]
    types = [pa.int64() if x.endswith(" long") else pa.string() for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges()
        for batch in batches:
            got = [row(ranges, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "media_bytes", "digest", "media_sha256")))]
            new = [pa.array([g[k] for g in got], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])
        ranges.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, {added}")


def header_columns(media: DataFrame) -> DataFrame:
    """Metadata columns filled by reading only the image header of each payload."""
    return _reading(media, "media_width long, media_height long, media_depth long", lambda r, shard, at, n, d, m: read_header(r.read(shard, at, HEADER_BYTES)))


def payload_columns(media: DataFrame) -> DataFrame:
    """Read the stored bytes back, check them against their address and compute the features."""

    def row(ranges: _Ranges, shard: str, at: int, n: int, digest: str, stored: str):
        image = ranges.read(shard, at, n)
        samples = decode_grey(image)
        payload = samples.tobytes()
        sha = hashlib.sha256(payload).hexdigest()
        if sha != digest or hashlib.sha256(image).hexdigest() != stored:
            raise ValueError(f"payload {digest} is damaged in {shard}")
        return sha, zlib.crc32(payload[-32:]), feature_of(samples)

    return _reading(media, "payload_sha256 string, tail_crc32 long, feature string", row)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a payload and return one row per document with its media columns."""
    folder = f"{shared_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    rows = cut(pack_payloads(docs, folder, id_col, text_col))
    one = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "media_bytes", "media_sha256")).alias("at")).select("digest", "at.*")
    # dealt by stretches of the shards, not by the few bytes of these rows: a task reads its stretches in order
    one = one.repartition(4 * partitions(docs.sparkSession), "shard", F.expr(f"offset div {STRETCH}")).sortWithinPartitions("shard", "offset")
    media = payload_columns(header_columns(one.withColumn("shard", F.concat(F.lit(f"{folder}/"), "shard"))))
    # the folder and the digest, which is the hash of what was read back, do not travel twice
    media = media.withColumn("shard", F.substring("shard", len(folder) + 2, 100)).drop("digest")
    out = rows.select("doc_id", "n_bytes", "payload_bytes", "digest").join(media, F.col("digest") == F.col("payload_sha256"))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_width", "media_height", "media_depth",
        F.concat(F.lit(f"{folder}/"), "shard").alias("shard"), "offset",
    )
