"""Media columns: texts as greyscale PNG images in binary columns, and perceptual hashes of what is read back.

A payload of bytes becomes the samples of an 8-bit greyscale image, ``WIDTH`` wide. Rows
are filtered (none, sub or up, whichever has the least sum of absolute differences),
compressed with zlib and stored in chunks with CRC-32. Reading tests every chunk's
checksum, inflates, undoes all five filter types in numpy, and hashes the image: its block
means pass a cosine transform, and the signs of the low frequencies against their median
are the hash.

Defined results: null text is empty, and an empty payload is one row of padding; equal
texts give equal values; a damaged image (bad signature, chunk, checksum or size) gives
nulls and status ``damaged``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import ship

#: Payloads are padded to a multiple of this with ``PAD``; also the image's width in samples.
WIDTH = 576
PAD = b"\xff"
#: Side of the square of block means, and of the low frequencies in a hash.
SIDE, LOW = 32, 8
LEVEL = 4

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_COS = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    return data + PAD * (-len(data) % width if data else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, note: bytes = b"") -> bytes:
    """A greyscale image (rows x columns, uint8) as PNG; ``note`` goes to a tEXt chunk."""
    h, w = samples.shape
    up, sub = samples.copy(), samples.copy()
    up[1:] -= samples[:-1]
    sub[:, 1:] -= samples[:, :-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (samples, sub, up)]
    kind = np.argmin(cost, 0)
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = np.choose(kind[:, None], (samples, sub, up))
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    text = _chunk(b"tEXt", b"Comment\x00" + note) if note else b""
    return _SIGNATURE + _chunk(b"IHDR", head) + text + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows of one byte a sample; column 0 holds the filter types."""
    kind, x = rows[:, 0], rows[:, 1:].copy()
    h, w = x.shape
    zero = np.zeros(w, np.uint8)
    sub = kind == 1
    x[sub] = np.cumsum(x[sub], axis=1, dtype=np.uint8)
    for r in np.flatnonzero(kind > 1):
        above = x[r - 1] if r else zero
        if kind[r] == 2:
            x[r] += above
        elif kind[r] == 3:
            left = 0
            for c, (v, a) in enumerate(zip(x[r].tolist(), above.tolist(), strict=True)):
                x[r, c] = left = (v + (left + a) // 2) & 255
        elif kind[r] == 4:
            left = corner = 0
            for c, (v, a) in enumerate(zip(x[r].tolist(), above.tolist(), strict=True)):
                p = left + a - corner
                near = min((abs(p - left), 0, left), (abs(p - a), 1, a), (abs(p - corner), 2, corner))[2]
                x[r, c] = left = (v + near) & 255
                corner = a
        else:
            raise ValueError(f"filter type {kind[r]}")
    return x


def decode_png(data: bytes) -> tuple[np.ndarray, bytes]:
    """(samples, note) of an 8-bit greyscale PNG; ValueError if it is damaged."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("no PNG signature")
    at, parts, shape, note, ended = 8, [], None, b"", False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not plain 8-bit greyscale")
            shape = h, w + 1
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"tEXt":
            note = body.partition(b"\x00")[2]
        ended = kind == b"IEND"
    if not ended or shape is None:
        raise ValueError("chunks are missing")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != shape[0] * shape[1]:
        raise ValueError("wrong amount of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(shape)), note


def _shrink(x: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` near-equal blocks of rows; fewer rows than blocks are repeated."""
    at = np.arange(n) * x.shape[0] // n
    size = np.maximum(np.diff(np.append(at, x.shape[0])), 1)
    return np.add.reduceat(x, at, axis=0) / size[:, None] if x.shape[0] >= n else x[at]


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: low frequencies of the cosine transform of block means, against their median."""
    small = _shrink(_shrink(samples.astype(np.float64), SIDE).T, SIDE).T
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the texts as images: columns key, n_bytes, media (binary)."""
    ship(df.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, media = [], []
            for data in b["data"]:
                data = bytes(data)
                sizes.append(len(data))
                media.append(encode_png(np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH), b"bytes=%d" % len(data)))
            yield pd.DataFrame({key: b[key], "n_bytes": sizes, "media": pd.Series(media, dtype=object)})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    # keys pass as text, so that null integers stay exact
    cast = df.select(F.col(key).cast("string").alias(key), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("data"))
    out = cast.mapInPandas(encode, T.StructType([T.StructField(key, T.StringType()), *schema.fields[1:]]))
    return out.withColumn(key, F.col(key).cast(schema[key].dataType))


_READ = "status string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def from_media(df: DataFrame, media: str = "media", out: str = "read") -> DataFrame:
    """``df`` with a struct ``out`` of what the stored bytes hold."""
    ship(df.sparkSession)

    @F.pandas_udf(_READ)
    def read(stored: pd.Series) -> pd.DataFrame:
        rows = []
        for s in stored:
            try:
                x, note = decode_png(b"" if s is None else bytes(s))
                payload = x.tobytes()
                rows.append(("whole", int(note.partition(b"=")[2] or len(payload)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), cosine_hash(x)))
            except ValueError:
                rows.append(("damaged", None, None, None, None, None))
        d = pd.DataFrame(rows, columns=["status", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])
        return d.astype({"n_bytes": "Int64", "payload_bytes": "Int64", "tail_crc32": "Int64"})

    return df.withColumn(out, read(F.col(media)))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as an image and read back."""
    m = from_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    r = F.col("read")
    return m.select(
        "doc_id",
        r["n_bytes"].alias("n_bytes"),
        r["payload_bytes"].alias("payload_bytes"),
        r["payload_sha256"].alias("payload_sha256"),
        r["tail_crc32"].alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        r["feature"].alias("feature"),
    )
