"""WARC archives: writing with segmentation and chunked framing, reading with segment reassembly.

Writing gives gzip-compressed WARC/1.1 files in a shared folder. A record whose block is
longer than ``segment_bytes`` is cut: the first part keeps the record's type and carries
``WARC-Segment-Number: 1``; the rest are ``continuation`` records that name the origin, and
the last states ``WARC-Segment-Total-Length``. Reading groups parts by origin identifier,
orders them by segment number, verifies the numbering and the total length, and decodes the
chunked transfer framing of the HTTP body.

Defined results: null html is an empty payload; an empty table gives no archives and no
rows; repeated rows give a record each; a null page id gives a record without an id, which
revisits an equal payload that has one; a record with missing, repeated or misnumbered
segments, a wrong total length, bad framing or a digest mismatch has status ``damaged``
and a null payload, and so has, once ``resolved``, a revisit without its response; a cut or damaged file gives the records before the damage and one such row
for the rest. Records of other types (warcinfo, request, metadata) are skipped. The parts of one
record meet in one row, so a record's block is bounded by a row's memory. Other columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import lookup_join, new_path, ship, staged

#: Longest record block, in bytes; longer ones are segmented.
SEGMENT_BYTES = 4096
#: Bytes in each chunk of the HTTP body's transfer framing.
CHUNK_BYTES = 1500
#: Records per archive file, which with the bound on blocks limits a file's size.
RECORDS_PER_FILE = 4096

_SIZE = re.compile(rb"[0-9A-Fa-f]{1,16}")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + chunk_bytes]), c) for i in range(0, len(payload), chunk_bytes)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError if the framing is bad."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        digits = body[at:end].split(b";")[0].rstrip(b" \t")
        if not _SIZE.fullmatch(digits) or (size := int(digits, 16)) > len(body) - end:
            raise ValueError("a chunk's size is no number, or more than is left")
        at = end + 2
        if size == 0:
            # trailer fields, if any, end with an empty line
            while (end := body.index(b"\r\n", at)) != at:
                at = end + 2
            if end + 2 != len(body):
                raise ValueError("bytes after the last chunk")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _one_line(s: str | None) -> str | None:
    return None if s is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in s)


def page_records(uid: str, page_id, url: str | None, payload: bytes, refers_to, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The WARC records of one page."""
    origin = f"<urn:uuid:{uid}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", origin), ("WARC-Target-URI", _one_line(url)), ("X-Page-ID", page_id)]
    fields.append(("WARC-Payload-Digest", f"sha1:{digest32(payload)}"))
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        more = [("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
        return [_record(fields + more, _HTTP + b"\r\n")]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + frame(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = len(block) if n == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uid}:{n}>"), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", last)], part))
    return out


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """(named fields in lower case, block) of each record of one archive file, gzip-compressed or not.

    What follows damage can't be trusted: (None, b"") stands for it and ends the file. A file
    cut within its compressed data still gives the records before the cut.
    """
    if data[:2] == b"\x1f\x8b":
        data, whole = _inflated(data)
    else:
        whole = True
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            yield None, b""
            return
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or end + 4 + int(size) > n or "warc-type" not in fields:
            yield None, b""
            return
        yield fields, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size) + 4  # each record ends with two line ends
    if not whole:
        yield None, b""


def _inflated(data: bytes) -> tuple[bytes, bool]:
    """What gzip members hold, up to the first damage, and whether there was none."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        try:
            # in pieces, so that damage costs no more than the piece it is in
            for i in range(0, len(data), 1 << 16):
                out.append(d.decompress(data[i : i + (1 << 16)]))
                if d.eof:
                    data = d.unused_data + data[i + (1 << 16) :]
                    break
            else:
                return b"".join(out), False
        except zlib.error:
            return b"".join(out), False
    return b"".join(out), True


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) to archive files under ``path``.

    Of equal payloads (by SHA-1 and length) the row with the largest page id is written as
    a response, the others as revisits that refer to it.
    """
    spark = pages.sparkSession
    ship(spark)
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("key", F.concat_ws(":", F.sha1(F.col("html").cast("binary")), F.octet_length("html")))
    copies = p.groupBy("key").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first_id")
    p = lookup_join(p, copies, "key", F.col("page_id"))
    older = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")))
    p = p.select(F.expr("uuid()").alias("uid"), F.col("page_id").cast("string"), "url", F.col("html").cast("binary"), F.when(older, F.col("first_id")).cast("string").alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for uid, page_id, url, html, refers in b.itertuples(index=False):
                out += page_records(uid, page_id, url, bytes(html), refers, segment_bytes, chunk_bytes)
            yield pd.DataFrame({"record": pd.Series(out, dtype=object)})

    records = p.mapInPandas(write, "record binary")
    # the line separator is what ends a WARC record
    records.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


_PARTS = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("block", T.BinaryType()),
    ]
)
#: Types of records that hold payloads or refer to them; others are skipped.
_PAGES = ("response", "revisit", "resource", "continuation")
_KEEP = ("warc-type", "x-page-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "x-payload-length")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``, with its origin and segment number."""
    ship(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for f, block in parse_archive(bytes(content)):
                    if f is None:  # a row of its own, without an origin
                        rows.append((f"damaged:{uuid.uuid4()}", -1, None, {}, b""))
                        continue
                    if f["warc-type"] not in _PAGES:
                        continue
                    first = f["warc-type"] != "continuation"
                    total, number = f.get("warc-segment-total-length", ""), f.get("warc-segment-number", "0" if first else "")
                    origin = f.get("warc-record-id" if first else "warc-segment-origin-id") or f"damaged:{uuid.uuid4()}"
                    rows.append((origin, int(number) if number.isdigit() else -1, int(total) if total.isdigit() else None, {k: f[k] for k in _KEEP if k in f} if first else None, block))
                out = pd.DataFrame(rows, columns=[x.name for x in _PARTS])
                out["total"] = out["total"].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(parse, _PARTS)


_WHOLE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("n_segments", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)


def assemble(parts: list[tuple[int, int | None, bytes]], fields: dict[str, str]) -> tuple[str, int, bytes | None, int | None, str | None]:
    """One record from its parts in any order: (status, segments, payload, payload bytes, payload digest)."""
    parts = sorted(parts, key=lambda p: p[0])
    n, said = len(parts), (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
    try:
        numbers = [p[0] for p in parts]
        block = b"".join(p[2] for p in parts)
        if numbers != ([0] if n == 1 and not numbers[0] else list(range(1, n + 1))):
            raise ValueError("segments are missing, repeated or misnumbered")
        if numbers[0] and parts[-1][1] != len(block):
            raise ValueError("the total length differs")
        head, sep, body = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("no HTTP header")
        if fields["warc-type"] == "revisit":
            return "whole", n, None, int(fields["x-payload-length"]), said
        payload = unframe(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body
        if (got := digest32(payload)) != said:
            raise ValueError("the digest differs")
        return "whole", n, payload, len(payload), got
    except (ValueError, KeyError):
        return "damaged", n, None, None, None


def reassemble(parts: DataFrame) -> DataFrame:
    """A row per origin: page_id (string), url, record_type, refers_to (string), status, n_segments, payload, payload_bytes, payload_digest."""
    ship(parts.sparkSession)

    @F.pandas_udf(_WHOLE)
    def whole(segments: pd.Series, fields: pd.Series) -> pd.DataFrame:
        rows = [assemble([(s["segment"], None if s["total"] is None else int(s["total"]), bytes(s["block"])) for s in segs], dict(f) if f is not None else {}) for segs, f in zip(segments, fields, strict=True)]
        out = pd.DataFrame(rows, columns=[x.name for x in _WHOLE])
        out["payload_bytes"] = out["payload_bytes"].astype("Int64")
        return out

    g = parts.groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "block")).alias("segments"), F.first("fields", ignorenulls=True).alias("fields"))
    g = g.select("fields", whole("segments", "fields").alias("w"))
    return g.select(
        F.col("fields")["x-page-id"].alias("page_id"),
        F.col("fields")["warc-target-uri"].alias("url"),
        F.col("fields")["warc-type"].alias("record_type"),
        F.regexp_extract(F.col("fields")["warc-refers-to"], "<urn:page:(.*)>", 1).alias("refers_to"),
        "w.*",
    )


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with each revisit's payload length and digest taken from the response that it names.

    A revisit whose response isn't there, isn't whole or has another digest is ``damaged``.
    """
    records = staged(records.drop("payload"), "records")
    asked = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    whole = records.where("record_type <> 'revisit' AND status = 'whole'").select("page_id", "payload_digest", "payload_bytes")
    found = whole.join(asked, ["page_id", "payload_digest"]).groupBy(F.concat_ws(" ", "payload_digest", "page_id").alias("named")).agg(F.max("payload_bytes").alias("there"))
    revisit = F.col("record_type") == "revisit"
    r = lookup_join(records.withColumn("named", F.when(revisit, F.concat_ws(" ", "payload_digest", "refers_to"))), found, "named", F.col("page_id"))
    lost = F.coalesce(revisit, F.lit(False)) & F.col("there").isNull()
    return r.select(
        "page_id", "url", "record_type", "refers_to", F.when(lost, "damaged").otherwise(F.col("status")).alias("status"), "n_segments",
        F.when(revisit, F.col("there")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(~lost, F.col("payload_digest")).alias("payload_digest"),
    )


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``pages`` to archives and returns what reading them back gives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    r = resolved(reassemble(read_parts(spark, path)))
    return r.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: substr(right('000' || bin(instr('0123456789abcdef', c) - 1), 4), 1, 4)), '') AS bits FROM m)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (16 * substr(bits, (i * 5 + 1)::BIGINT, 1)::INT + 8 * substr(bits, (i * 5 + 2)::BIGINT, 1)::INT + 4 * substr(bits, (i * 5 + 3)::BIGINT, 1)::INT
     + 2 * substr(bits, (i * 5 + 4)::BIGINT, 1)::INT + substr(bits, (i * 5 + 5)::BIGINT, 1)::INT + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND (page_id IS NULL OR page_id < first_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND (page_id IS NULL OR page_id < first_id) THEN first_id END AS refers_to
FROM b
"""
