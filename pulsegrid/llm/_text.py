"""Word splitting and hashing over whole batches of texts with numpy.

Texts are joined into one UTF-8 buffer. Upper-case A-Z is folded, other letters
are left alone, and every byte of a non-ASCII character has its high bit set, so
both word classes below are byte classes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of text per Arrow batch, and characters worked on at once inside a task.
BATCH_ROWS = 256
CHUNK_CHARS = 1 << 21

_BYTES = np.arange(256)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: ``[^\x20\x09-\x0D]``.
SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE_VALUES = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of whole texts small enough for an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def _importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did; clusters ship it as usual."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def unused(columns: list[str], name: str) -> str:
    """``name``, with more underscores in front where a column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def heavy(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys to as many tasks as the session shuffles to, however few bytes there are: the work is in Python."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def map_frames(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """``mapInPandas`` that keeps 64-bit integers exact beside nulls."""
    _importable(df.sparkSession)
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    shape = to_arrow_schema(fields)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pa.Table.from_batches([b]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(frames(batches)):
            yield from pa.Table.from_pandas(out, schema=shape, preserve_index=False).combine_chunks().to_batches()

    return df.mapInArrow(run, fields)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    buffer: bytes  # lower-cased UTF-8 of all texts
    start: np.ndarray  # byte offsets of the words
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, one more entry at the end
    hash: np.ndarray  # 64-bit hash of each word

    def text(self, i: int, j: int) -> str:
        """Words i to j of the buffer, joined by one space."""
        return b" ".join(self.buffer[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist())).decode("utf-8", "surrogatepass")


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` characters together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def clean(values: pd.Series) -> list:
    """A column of texts as a list with None for nulls."""
    return [t if isinstance(t, str) else None for t in values.tolist()]


def words_of(texts: list, member: np.ndarray) -> Words:
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buffer = b"\n".join(parts) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    inside = member[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    first = np.searchsorted(start, offsets)
    return Words(buffer, start, end, first, _word_hashes(data[inside], end - start))


def _word_hashes(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    if not len(length):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(begin, length)
    powers = np.multiply.accumulate(np.full(int(length.max()), _STEP | np.uint64(1), np.uint64))
    return mix(np.add.reduceat(_BYTE_VALUES[data] * powers[place], begin) + length.astype(np.uint64) * _STEP)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbouring words; a run may reach over a text's end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _SHINGLE_VALUES[j]
    return mix(total + np.uint64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of every text; a shorter text is one shingle, an empty one none."""
    every = runs(words.hash, k)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(every[lo : hi - k + 1]))
        elif hi > lo:
            out.append(runs(words.hash[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
