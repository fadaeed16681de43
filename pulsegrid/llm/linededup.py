"""Line deduplication by range-partitioned line hashes.

Every line long enough becomes one record (hash, document, position). Records are
range-partitioned on (hash, document), so a line that a third of all documents
hold is spread over many tasks, and sorted by hash, document from the largest id,
position. A task streams over its runs of equal hashes; the first document of a
run is the one that keeps its lines. A run that touches the edge of a task may go
on in the next one: its records stay open and are settled by one small table with
the totals of such runs. Texts never move; the result is one compressed keep
bitmap per document that loses lines.

Rows are identified by (doc_id, hash of the text). Repeated rows get the same
result and count as one document; a null id is one document smaller than all others.
Null and empty texts have one empty line and lose nothing. Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ._text import clean, map_frames, text_batches, unused

MIN_CHARS = 20
MIN_DOCUMENTS = 3
BLANKS = " \t\n\x0b\x0c\r"

_LINES = "h1 bigint, h2 bigint, doc_id bigint, row bigint, n_lines int, pos int"
_RUNS = "kind int, " + _LINES + ", n_docs bigint"
_DROP, _OPEN, _TOTAL = 0, 1, 2


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, the hash of the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "row", F.xxhash64(F.coalesce("text", F.lit("")))
    )


def line_records(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One record per line of at least ``min_chars`` code points, compared without outer blanks and ASCII case."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = {c: [] for c in ("at", "h1", "h2", "n_lines", "pos")}
            for at, text in enumerate(clean(b["text"])):
                lines = (text or "").split("\n")
                for pos, line in enumerate(lines):
                    key = line.strip(BLANKS)
                    if len(key) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
                        found["at"].append(at)
                        found["h1"].append(h >> 64)
                        found["h2"].append(h & 0xFFFFFFFFFFFFFFFF)
                        found["n_lines"].append(len(lines))
                        found["pos"].append(pos)
            at = found["at"]
            yield pd.DataFrame(
                {
                    "h1": np.array(found["h1"], np.uint64).view(np.int64),
                    "h2": np.array(found["h2"], np.uint64).view(np.int64),
                    "doc_id": b["doc_id"].iloc[at].array,
                    "row": b["row"].iloc[at].array,
                    "n_lines": found["n_lines"],
                    "pos": found["pos"],
                }
            )

    text_batches(docs.sparkSession)
    return map_frames(keyed(docs), split, _LINES)


def _settle(b: pd.DataFrame, first: bool, last: bool, min_documents: int) -> pd.DataFrame:
    """Decide complete runs; the task's first and last run stay open. Rows are sorted."""
    h1, h2 = b["h1"].to_numpy(np.int64), b["h2"].to_numpy(np.int64)
    doc, none = b["doc_id"].fillna(0).to_numpy(np.int64), b["doc_id"].isna().to_numpy()
    new_run = np.ones(len(b), bool)
    new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_run.copy()
    new_doc[1:] |= (doc[1:] != doc[:-1]) | (none[1:] != none[:-1])
    begin = np.flatnonzero(new_run)
    run = np.cumsum(new_run) - 1
    n_docs = np.add.reduceat(new_doc.astype(np.int64), begin)
    keeper = (doc == doc[begin][run]) & (none == none[begin][run])
    open_run = np.zeros(len(begin), bool)
    open_run[0] |= first
    open_run[-1] |= last
    kind = np.where(open_run[run], _OPEN, np.where((n_docs[run] >= min_documents) & ~keeper, _DROP, -1))
    out = b.assign(kind=kind, n_docs=0)[kind >= 0]
    ends = b.iloc[begin[open_run]].assign(kind=_TOTAL, n_docs=n_docs[open_run])
    return pd.concat([out, ends])


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Lines to drop as (doc_id, row, n_lines, pos).

    A line held by at least ``min_documents`` documents stays only in the one with
    the largest id.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, first = None, True
        for b in batches:
            if not len(b):
                continue
            carry = b if carry is None else pd.concat([carry, b], ignore_index=True)
            h1, h2 = carry["h1"].to_numpy(np.int64), carry["h2"].to_numpy(np.int64)
            cut = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
            if len(cut):  # all runs but the last are complete
                n = int(cut[-1]) + 1
                yield _settle(carry.iloc[:n], first, False, min_documents)
                carry, first = carry.iloc[n:].reset_index(drop=True), False
        if carry is not None:
            yield _settle(carry, first, True, min_documents)

    spark = text_batches(docs.sparkSession)
    lines = durable(line_records(docs, min_chars))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    ordered = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc_id"), "row", "pos")
    found = durable(map_frames(ordered, stream, _RUNS))
    text_batches(spark)
    totals = (
        found.where(F.col("kind") == _TOTAL)
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("total"), F.max("doc_id").alias("keeper"))
        .where(F.col("total") >= min_documents)
    )
    # at most two rows of each task of the stream
    rest = found.where(F.col("kind") == _OPEN).join(F.broadcast(totals), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    columns = ["doc_id", "row", "n_lines", "pos"]
    return found.where(F.col("kind") == _DROP).select(columns).unionByName(rest.select(columns))


def _pack(positions, n_lines: int) -> tuple[bytes, int]:
    keep = np.ones(n_lines, np.uint8)
    keep[np.asarray(positions, np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes()), int(n_lines - keep.sum())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Keep flags of a document's lines; without a bitmap all stay."""
    if bitmap is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, row, n_dropped, bitmap) of the documents that lose lines; others keep everything."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [_pack(p, n) for p, n in zip(b["gone"], b["n_lines"])]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "row": b["row"], "n_dropped": [n for _, n in packed], "bitmap": [m for m, _ in packed]}
            )

    gone = dropped_lines(docs, min_chars, min_documents)
    per_doc = gone.groupBy("doc_id", "row", "n_lines").agg(F.collect_list("pos").alias("gone"))
    return map_frames(per_doc, pack, "doc_id bigint, row bigint, n_dropped bigint, bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, dropped: str = "__dropped", bitmap: str = "__bitmap") -> DataFrame:
    """All columns of ``docs`` with two more, ``dropped`` and ``bitmap`` (null where nothing is lost), which replace columns of those names."""
    docs = docs.drop(dropped, bitmap)
    doc, row = unused(docs.columns, "__id"), unused(docs.columns, "__row")
    marks = bitmaps.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("n_dropped").alias(dropped), F.col("bitmap").alias(bitmap))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(row))
    return docs.join(marks, same, "left").drop(doc, row)


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[str, int]:
    """The text without its dropped lines, and the number of lines before."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines)
    keep = unpack(bitmap, len(lines))
    return "\n".join(line for line, k in zip(lines, keep) if k), len(lines)
