"""WARC archives with a Zstandard dictionary.

Every task writes one archive: a skippable frame with the dictionary, then every
record as a frame of its own, so any record can be read by its offset. The dictionary
is trained on archived records: a bounded sample, the ``sample_records`` records with the
smallest hash among those of at most ``sample_bytes`` bytes.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the
smallest page_id is a response, the others are revisits of it without payload.
Repeated rows of that smallest id are all responses. Null ids are revisits of a
page that has one, and responses where none has. Null html is an empty payload.
Only ``page_id``, ``url`` and ``html`` are read.

A task gives its archive a new name, and only names in the committed manifest count;
an archive left by a lost task is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, scratch_path
from ._text import map_frames, text_batches

MIN_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 * 1024
SAMPLE_RECORDS = 256
SAMPLE_BYTES = 64 * 1024
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {digest}'.encode()).hexdigest()[:32])}>"


def _header_text(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, revisit: bool) -> bytes:
    """One WARC record: the response with its payload, or a revisit without."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(revisit_of, digest)}", f"X-Refers-To-Page: {revisit_of}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record; a response's length and digest are those of its payload as read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": number("X-Refers-To-Page"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and its digest."""
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """:func:`payloads` with ``first`` (the page a revisit refers to) and ``revisit``."""
    rows = payloads(pages)
    equal = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    equal = equal.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("__digest"), "first")
    joined = rows.join(equal, F.col("digest") == F.col("__digest"), "left").drop("__digest")
    return joined.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))


def _records(b: pd.DataFrame) -> Iterator[bytes]:
    clean = lambda v: None if pd.isna(v) else v
    for page_id, url, payload, digest, first, revisit in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["first"], b["revisit"]):
        yield record(clean(page_id), clean(url), payload, digest, clean(first), bool(revisit))


def dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES, sample_records: int = SAMPLE_RECORDS, sample_bytes: int = SAMPLE_BYTES) -> bytes | None:
    """A dictionary for the pages' records, trained in one task on the bounded sample; None where too few are there."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples = [r for b in batches for r in _records(b)]
        made, room = b"", size
        while not made and len(samples) >= 8 and room >= 256:  # too little to learn from: a smaller one
            try:
                made = zstandard.train_dictionary(room, samples).as_bytes()
            except zstandard.ZstdError:
                room //= 2
        yield pd.DataFrame({"dictionary": [made]})

    small = payloads(pages).where(F.octet_length("payload") <= sample_bytes)
    small = small.withColumns({"first": F.lit(None).cast("bigint"), "revisit": F.lit(False)})
    sample = small.orderBy(F.xxhash64("page_id", "digest"), "digest").limit(sample_records)
    made = map_frames(sample.coalesce(1), train, "dictionary binary").first()
    return bytes(made["dictionary"]) or None if made else None


def write(rows: DataFrame, folder: str, compression: bytes | None, level: int = LEVEL) -> DataFrame:
    """Write archives of :func:`archived` rows; returns the manifest (archive, n_records, n_bytes)."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        trained = zstandard.ZstdCompressionDict(compression) if compression else None
        press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, name = _open(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        n = 0
        with store.open_output_stream(name, compression=None) as out:
            if compression:
                out.write(struct.pack("<II", DICTIONARY_MAGIC, len(compression)) + compression)
            for b in chain([first], batches):
                for r in _records(b):
                    out.write(press.compress(r))
                    n += 1
            size = out.tell()
        yield pd.DataFrame({"archive": [path], "n_records": [n], "n_bytes": [size]})

    return durable(map_frames(rows, save, "archive string, n_records bigint, n_bytes bigint"))


def frames(archive: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one frame at a time."""
    store, name = _open(archive)
    with store.open_input_stream(name, compression=None) as source:
        data, trained = source.read(8), None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
            trained, data = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", data[4:])[0])), b""
        unpress = zstandard.ZstdDecompressor(dict_data=trained)
        while data := data or source.read(chunk):
            frame, out = unpress.decompressobj(), []
            while not frame.eof:
                out.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else source.read(chunk)
                if not frame.eof and not data:
                    raise EOFError(f"{archive} ends inside a record")
            yield b"".join(out)


def read(manifest: DataFrame) -> DataFrame:
    """All records of the archives, with payloads."""
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["archive"]:
                rows, size = [], 0
                for data in frames(archive):
                    rows.append(parse(data))
                    size += len(data)
                    if size > 4_000_000:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    # about one archive for each task, however small the manifest is
    return map_frames(manifest.repartition(max(1, manifest.count())), load, schema)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[c] for r in rows], dtype="Int64")
    return out


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages below ``folder`` (by default a new one in the shared folder); returns the manifest."""
    spark = text_batches(pages.sparkSession)
    return write(archived(pages, min_bytes), folder or scratch_path(spark, "warc"), dictionary(pages))
