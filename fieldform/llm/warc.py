"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole WARC records, closed
by a skippable frame with a seek table (compressed and plain size of each frame, count, magic
number: the public seekable format).  An index row maps a record id to bundle, frame and the
record's place inside the frame, so one record is read by decompressing one frame.

Of records with an equal payload of at least ``least`` bytes, the smallest page id holds it and
the others are revisits that name it; shorter payloads are all written.  Nulls: a null payload is
empty, a null page id is larger than any other, a null URL is written as an empty one.  Rows that
repeat a page id are records of their own; the first of them with a payload holds it.  Line
breaks in URLs are percent-encoded.  A payload of any length is one record, whole inside one frame; a
task holds the pages of one Arrow batch.  An empty table gives an empty index.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldform.scale import materialize, new_folder

FRAME, BUNDLE, LEVEL = 1 << 20, 256 << 20, 3
# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

INDEX = "record_id string, page_id long, bundle string, frame int, place long, length long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of the given compressed and plain sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_places(handle, size: int) -> list[tuple[int, int, int]]:
    """``(start, compressed size, plain size)`` of each frame, read from the end of a bundle."""
    handle.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", handle.read(9))
    if magic != SEEKABLE:
        raise ValueError("bundle without a seek table")
    handle.seek(size - 9 - 8 * count)
    table, at, out = handle.read(8 * count), 0, []
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def record(page_id, url, payload: bytes, digest: str, held: bool, refers, record_id: str) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if held else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if held:
        head.append("Content-Type: application/http; msgtype=response")
        block = HTTP % len(payload) + payload
    else:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {'' if refers is None else refers}")
        block = b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``at``."""
    stop = plain.index(b"\r\n\r\n", at)
    lines = plain[at:stop].decode().split("\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start, size = stop + 4, int(head["Content-Length"])
    block = plain[start : start + size]
    if plain[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("record without an end")
    payload = block[block.index(b"\r\n\r\n") + 4 :] if block else b""
    return head, payload, start + size + 4


class _Bundle:
    """Frames of one file; index rows wait until the file is whole."""

    def __init__(self, fs, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out, self.packer = fs.open_output_stream(self.name, compression=None), zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.plain, self.rows, self.written = [], bytearray(), [], 0

    def add(self, record_id: str, page_id, raw: bytes) -> None:
        self.rows.append((record_id, page_id, self.name, len(self.frames), len(self.plain), len(raw)))
        self.plain += raw
        if len(self.plain) >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.plain:
            packed = self.packer.compress(bytes(self.plain))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.plain)))
            self.written += len(packed)
            self.plain = bytearray()

    def close(self) -> pa.RecordBatch:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), types, strict=True)], names=names)


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(uri: str, least: int):
    def write(batches):
        fs, folder = _filesystem(uri)
        fs.create_dir(folder, recursive=True)
        task, number, bundle, seen = TaskContext.get().partitionId(), 0, None, set()
        page = object()
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                if row["page_id"] != page:
                    page, seen = row["page_id"], set()
                # Rows come in the order of their page, so repeats of a page stand together.
                first = row["page_id"] == row["holder"] and row["digest"] not in seen
                held = len(payload) < least or not row["shared"] or first
                seen.add(row["digest"])
                bundle = bundle or _Bundle(fs, folder)
                record_id = f"urn:page:{'' if row['page_id'] is None else row['page_id']}:{task}-{number}"
                number += 1
                bundle.add(record_id, row["page_id"], record(row["page_id"], row["url"], payload, row["digest"], held, row["holder"], record_id))
                if bundle.written >= BUNDLE:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return write


def write_warc(pages: DataFrame, folder: str | None = None, *, least: int = 100, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives and return the index, one row per record.

    ``folder`` is shared by all executors; a new one under ``spark.checkpoint.dir`` by default.
    Files of failed attempts are never listed in the index, which is written by Spark.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # Digests alone find the holders: combined before the shuffle, so common payloads stay cheap.
    long = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    holders = long.groupBy("digest").agg(F.min("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = long.join(holders, "digest").select("page_id", "digest", "holder").distinct()
    named = named.select(F.col("page_id").alias("named_page"), F.col("digest").alias("named_digest"), "holder")
    # The payloads move once, by page.
    same = (F.col("page_id").eqNullSafe(F.col("named_page"))) & (F.col("digest") == F.col("named_digest"))
    rows = rows.join(named, same, "left").withColumn("shared", F.col("named_digest").isNotNull()).sortWithinPartitions("page_id", "url")
    return materialize(rows.select("page_id", "url", "html", "digest", "holder", "shared").mapInArrow(_writer(folder, least), INDEX), "index")


def _reader(batches):
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = _filesystem(row["bundle"])
            unpack = zstandard.ZstdDecompressor()
            with fs.open_input_file(path) as handle:
                places = frame_places(handle, handle.size())
                wanted = range(len(places)) if row["frame"] is None else [row["frame"]]
                for k in wanted:
                    start, packed, plain_size = places[k]
                    handle.seek(start)
                    plain = unpack.decompress(handle.read(packed), max_output_size=plain_size)
                    at, out = 0 if row["place"] is None else row["place"], []
                    while at < len(plain):
                        head, payload, at = parse(plain, at)
                        out.append(_row(head, payload))
                        if row["place"] is not None:
                            break
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD)


_RECORD = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload string, payload_bytes long, payload_digest string"


def _row(head: dict[str, str], payload: bytes) -> dict:
    number = lambda key: int(head[key]) if head.get(key) else None
    kind = head["WARC-Type"]
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), number("X-Payload-Length")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("payload does not agree with its digest")
    url = head["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {
        "record_id": head["WARC-Record-ID"][1:-1], "page_id": number("X-Page-ID"), "url": url, "record_type": kind,
        "refers_to": number("X-Refers-To-Page"), "payload": payload.decode() if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
    }


def read_warc(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index lists, read from the files; one task slot per bundle."""
    none = F.lit(None)
    bundles = index.select("bundle").distinct().select("bundle", none.cast("int").alias("frame"), none.cast("long").alias("place"))
    return bundles.mapInArrow(_reader, RECORD)


def fetch_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``, each read from its own frame."""
    hits = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    return hits.select("bundle", "frame", "place").mapInArrow(_reader, RECORD)
