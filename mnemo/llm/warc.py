"""WARC archives of gzip members, written by Spark's text writer and read by byte ranges.

Writing. Each record is one gzip member. Of records with equal payloads the one with the largest id is a
``response``, the others are ``revisit`` records that refer to it and carry no payload. The text writer
puts out the members' raw bytes with a line separator after each; the separator is the zero byte that
ends every member of under 16 MiB (the high byte of its length field), so it is part of the member.
A longer record is followed by an empty member, which ends with that byte too.

Reading. Spark's text source splits files by byte ranges, each read by one task; with the gzip magic
as its separator, a task gets every piece that follows a magic inside its range. A piece is the
head of a record only if it is a sound gzip header and what it inflates to begins as a WARC record; any
other piece is the rest of the member before it, whose compressed bytes happened to hold the magic.
Records belong to the range that they start in. If a member goes on in pieces of a later range, its
incomplete head and these pieces (rare: about one in 2**24 bytes) are joined by file and range
and decoded then. Archive files must not be named as compressed, or the text source would inflate them.

Null payloads count as empty; rows with a null id are responses. Equal ids with equal payloads are all responses when they are the
largest. Empty tables give no archive rows. Digests are bare upper-case base32 SHA-1 of the full payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .textops import blocks

MAGIC = b"\x1f\x8b\x08"
WHOLE = 1 << 24
#: The record's version line and the end of headers.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, kind: str, refers_to: int | None, sha1: str, size: int, payload: bytes) -> bytes:
    """One WARC record; ``size`` and ``sha1`` are those of the full payload."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Bytes: {size}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if kind == "response" else b""
    return VERSION + "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + END + body + END


def member(raw: bytes, level: int = 6) -> bytes:
    out = gzip.compress(raw, compresslevel=level, mtime=0)
    return out if len(raw) < WHOLE else out + gzip.compress(b"", mtime=0)


def parsed(raw: bytes, payloads: bool = True) -> dict:
    head, _, rest = raw.partition(END)
    fields = dict(line.split(": ", 1) for line in head[len(VERSION):].decode("utf-8").split("\r\n"))
    payload = rest[: int(fields["Content-Length"])]
    kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != sha1 or len(payload) != int(fields["X-Payload-Bytes"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def number(name: str) -> int | None:
        value = fields.get(name, "<urn:page:None>").removeprefix("<urn:page:").removesuffix(">")
        return None if value == "None" else int(value)

    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("WARC-Refers-To"),
            "payload_digest": sha1, "payload_bytes": int(fields["X-Payload-Bytes"]), "payload": payload if kind == "response" and payloads else None}


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _sha1(text: str) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")))


def marked(pages: DataFrame, key: str = "page_id", text: str = "html", least: int = 0) -> DataFrame:
    """(page_id, sha1 in hex, refers_to): null refers_to for responses. Only ids and digests are moved."""
    each = pages.select(F.col(key).cast("long").alias("page_id"), _sha1(text).alias("sha1"), F.octet_length(F.coalesce(text, F.lit(""))).alias("bytes"))
    last = each.groupBy("sha1").agg(F.max("page_id").alias("last"))  # combined before the shuffle: a hot payload is one row a task
    same = (F.col("bytes") < least) | F.col("page_id").isNull() | (F.col("page_id").eqNullSafe(F.col("last")))
    return each.join(last, "sha1").select("page_id", "sha1", F.when(~same, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", text: str = "html", least: int = 0,
          level: int = 6) -> None:
    """Writes the archives of all pages under ``path``. Lost tasks are run again by Spark's committer."""
    marks = marked(pages, key, text, least).where(F.col("refers_to").isNotNull()).groupBy("page_id", "sha1").agg(F.max("refers_to").alias("refers_to"))
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(text).alias("body"))
    # Revisits are pages whose (id, payload) is marked; an id may occur with several payloads.
    joined = base.withColumn("sha1", _sha1("body")).join(marks, ["page_id", "sha1"], "left")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "body", 4 << 20):
            out = []
            for page_id, u, body, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "body", "refers_to")), strict=True):
                raw = (body or "").encode()
                out.append(member(record(page_id, u, "response" if refers is None else "revisit", refers, digest(raw), len(raw), raw), level)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = joined.mapInArrow(members, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


def _head(piece: bytes) -> bool:
    """Is magic + piece the head of a record's member, or an empty member? Both headers are decoded: gzip's,
    then as much of the record's version line as the piece's compressed bytes give."""
    if len(piece) < 7 or piece[0] & 0xE0 or piece[5] not in (0, 2, 4) or 13 < piece[6] < 255:
        return False
    try:
        first = zlib.decompressobj(31).decompress(MAGIC + piece[: 1 << 12], len(VERSION))
    except zlib.error:
        return False
    return first[:5] == VERSION[: len(first)][:5]


def _whole(raw: bytes) -> bytes | None:
    """The inflated record, or None if the member goes on."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(raw)
    except zlib.error:
        return None
    return out if d.eof else None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records under ``path``, each from the task whose byte range it starts in (payloads left out if not asked for)."""
    pieces = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_, first = None, None, 0

        def rows(found: list[dict], torn: list[tuple]) -> pa.RecordBatch:
            torn_column = pa.array([None] * len(found) + [{"file": f, "start": s, "head": h, "bytes": b, "n": n} for f, s, h, b, n in torn],
                                   pa.struct([("file", pa.string()), ("start", pa.int64()), ("head", pa.bool_()), ("bytes", pa.binary()), ("n", pa.int64())]))
            record_column = pa.StructArray.from_arrays(pa.Table.from_pylist(found + [{}] * len(torn), _ARROW).to_struct_array().combine_chunks().flatten()
                                                       if found or torn else [pa.array([], t) for t in _ARROW.types], fields=list(_ARROW))
            return pa.RecordBatch.from_arrays([record_column, torn_column], names=["record", "torn"])

        for b in batches:
            found, torn = [], []
            for piece, file, start in zip(b.column("piece").to_pylist(), b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                if (file, start) != place:
                    if open_ is not None:
                        torn.append((*place, True, open_, first))
                    place, open_, first = (file, start), None, 0
                    if start == 0 and piece == b"":
                        continue  # what stands before the first magic of a file
                first += 1
                if _head(piece):
                    if open_ is not None:
                        raise ValueError(f"a member of {file} is cut short")
                    open_ = MAGIC + piece
                elif open_ is not None:
                    open_ += MAGIC + piece
                else:
                    torn.append((file, start, False, MAGIC + piece, first))
                    continue
                whole = _whole(open_)
                if whole is not None:
                    if whole:
                        found.append(parsed(whole, payloads))
                    open_ = None
            yield rows(found, torn)
        if open_ is not None:
            yield rows([], [(*place, True, open_, first)])

    schema = f"record struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in RECORD.split(', ')))}>, torn struct<file:string,start:long,head:boolean,bytes:binary,n:long>"
    decoded = pieces.mapInArrow(decode, schema)

    def mend(pdf: pd.DataFrame) -> pd.DataFrame:
        found, open_ = [], None
        for row in pdf.sort_values(["start", "head", "n"]).itertuples():
            open_ = bytes(row.bytes) if row.head else (open_ or b"") + bytes(row.bytes)
            whole = _whole(open_)
            if whole:
                found.append(parsed(whole, payloads))
                open_ = None
        if open_ is not None:
            raise ValueError(f"a member of {pdf.file.iloc[0]} is cut short")
        # Nullable integers: a float column would round long ids.
        return pd.DataFrame({f.name: pd.array([r[f.name] for r in found], dtype="Int64") if f.type == pa.int64() else
                             pd.Series([r[f.name] for r in found], dtype=object) for f in _ARROW})

    whole = decoded.where("torn is null").select("record.*")
    mended = decoded.where("torn is not null").select("torn.*").groupBy("file").applyInPandas(mend, RECORD)
    return whole.unionByName(mended)


def round_trip(pages: DataFrame, least: int = 0, payloads: bool = True) -> DataFrame:
    """Writes the archives to a new folder in the shared one and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, least=least)
    return read(pages.sparkSession, path, payloads)
