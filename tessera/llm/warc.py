"""WARC archives in Zstandard: a dictionary in a leading skippable frame, one frame a record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary of all later
frames, itself compressed or not.  The reader walks frame headers and block headers to find each
frame's end, so one frame is decoded at a time and memory is bounded by the largest record; it checks
the version line, the mandatory headers, both length headers, the closing line ends and the digest.

Writing is safe against lost executors: each attempt writes files of its own names, and only the
attempts that Spark commits are listed in the manifest that reading starts from.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace
from tessera.workers import lean

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 256 << 20
SAMPLE_PAGES = 200
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers and drops the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A dictionary; a plain content dictionary where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples[:8]) + record(0, "http://", b"", payload_digest(b""), None, ""))[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    body = packed if len(packed) < len(dictionary) else dictionary
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


class Damaged(ValueError):
    """An archive that breaks the format, with the place where it does."""


def frame_end(buffer: bytes | bytearray, at: int = 0) -> int | None:
    """Where the frame at ``at`` ends, from its headers; None if the buffer ends before."""
    if len(buffer) - at < 8:
        return None
    magic, length = struct.unpack_from("<II", buffer, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + length if len(buffer) >= at + 8 + length else None
    if magic != FRAME_MAGIC:
        raise Damaged(f"no frame magic but {magic:#x}")
    flags = buffer[at + 4]
    single, content = flags >> 5 & 1, flags >> 6
    place = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[content])
    while len(buffer) >= place + 3:
        block = buffer[place] | buffer[place + 1] << 8 | buffer[place + 2] << 16
        place += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            place += 4 * (flags >> 2 & 1)
            return place if len(buffer) >= place else None
    return None


def frames(stream, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each frame; memory holds one frame and one piece."""
    buffer, offset = bytearray(), 0
    while True:
        end = frame_end(buffer)
        if end is None:
            more = stream.read(piece)
            if not more:
                if buffer:
                    raise Damaged(f"the archive ends inside a frame at {offset}")
                return
            buffer += more
            continue
        yield offset, bytes(buffer[:end])
        del buffer[:end]
        offset += end


def parse(data: bytes) -> dict:
    """Validate one record and return its fields."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Damaged("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged(f"a header without a colon: {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Damaged(f"no {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Damaged(f"Content-Length {length} of a record with {len(rest) - 4}")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not mark or size is None:
        raise Damaged("no HTTP headers with a length")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (size != len(payload) or digest != payload_digest(payload)):
        raise Damaged("payload of another length or digest than its headers tell")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise Damaged("a revisit with a payload or without a record to refer to")
    number = lambda v: None if (x := v.strip("<>").removeprefix(_ID)) == "none" else int(x)
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def read_archive(stream) -> Iterator[dict]:
    """Records of one archive."""
    dictionary, decoder = None, None
    for offset, frame in frames(stream):
        (magic,) = struct.unpack_from("<I", frame)
        if magic == DICTIONARY_MAGIC and offset == 0:
            body = frame[8:]
            if body[:4] == struct.pack("<I", FRAME_MAGIC):
                body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
            dictionary = zstandard.ZstdCompressionDict(body)
            continue
        if magic != FRAME_MAGIC:
            continue  # another skippable frame
        if decoder is None:
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        inner = decoder.decompressobj()
        data = inner.decompress(frame)
        if not inner.eof or inner.unused_data:
            raise Damaged(f"the frame at {offset} is not one whole frame")
        try:
            yield parse(data)
        except Damaged as e:
            raise Damaged(f"at {offset}: {e}") from e


def write_archives(pages: DataFrame, space: Workspace, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; returns the manifest (path, records) of the committed archives.

    A null html is an empty payload.  Of records with equal payloads of at least
    ``min_revisit_bytes`` bytes the one with the largest key is the response and others are
    revisits; a row with a null key is always a response, as are repeated rows of the largest key.
    A task begins another archive when one has ``archive_bytes``.  An empty table gives no archive.
    The dictionary is trained on a sample of 200 pages with the smallest key hashes, 64 KB of each.
    """
    picked = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    # a share of the hash range that holds about three times as many, so that no task sends 200 rows of its own
    part = min(1.0, 3 * SAMPLE_PAGES / max(1, pages.count()))
    h = F.xxhash64("page_id").bitwiseAND((1 << 53) - 1)
    sample = picked.where(h < int(part * (1 << 53))).select(F.substring("payload", 1, 1 << 16).alias("payload"), h.alias("h"), "page_id").orderBy("h", "page_id").limit(SAMPLE_PAGES).collect()
    dictionary = train([bytes(r.payload) for r in sample])
    hashed = picked.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # what refers to what is decided on digests alone; payloads meet it by page, so copies of one payload do not meet
    slim = hashed.select("page_id", "sha1", "size")
    equal = slim.groupBy("sha1", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes)).drop("n")
    again = slim.join(equal, ["sha1", "size"]).where("page_id < last").select("page_id", "sha1", F.col("last").alias("refers_to")).distinct()
    decided = hashed.join(again, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "refers_to")
    folder = f"{space.path}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        opening = dictionary_frame(dictionary)
        out, path, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page, link, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{root}/{path}")
                    out.write(opening)
                    n, size = 0, len(opening)
                frame = coder.compress(record(page, link, payload, payload_digest(payload), refers, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return space.save(decided.mapInArrow(lean(run), "path string, records long"), "manifest")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of listed archives.

    Raises where an archive is damaged or has another number of records than its manifest tells.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payload:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], f"{schema}, payload binary"

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                seen, rows, size = 0, [], 0
                with store.open_input_stream(place) as stream:
                    for r in read_archive(stream):
                        rows.append(r)
                        size += len(r["payload"] or b"") + 200 if payload else 200
                        seen += 1
                        if size >= 8 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)
                if seen != records:
                    raise Damaged(f"{path} has {seen} records; its manifest tells {records}")

    files = manifest.select("path", "records")
    width = max(1, min(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.count()))
    return files.repartition(width).mapInArrow(lean(run), schema)


def round_trip(spark: SparkSession, pages: DataFrame, space: Workspace) -> DataFrame:
    return read_archives(write_archives(pages, space), payload=False)


_BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '')"
ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS html, {_BITS} AS bits FROM pages
), coded AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to FROM coded
"""
