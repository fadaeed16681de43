"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows of 13 consecutive words (a shorter item is one
window). A window is a set of word shingles ordered by rarity in the documents;
as the whole window must be contained, its necessary prefix is its rarest
shingle. Documents are matched on that shingle only; the shingle's position and
the window's length bound where the window would have to lie; the words there are
then compared with the window exactly, by a join on the window's text.

Benchmarks are looked at in parts of at most ``part_windows`` windows, so what
every task holds is bounded whatever the benchmark's size; each part costs two
passes over the documents, one that counts shingles and one that matches.

Rows are identified by (doc_id, hash of the text), so repeated rows get equal
results. Null texts have no words. Items with null or empty texts have no
window; null item ids are ignored. Columns other than ``doc_id`` and ``text``, or
``item_id`` and ``text``, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ._text import ALNUM, chunks, clean, map_frames, runs, text_batches, words_of
from .linededup import keyed

WINDOW = 13
SHINGLE = 5
PART_WINDOWS = 2_000_000
#: A document is contaminated if at least one word in so many is hit.
WORDS_PER_HIT = 20


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Windows of each item as (item_id, window text, its length in words, its shingles' hashes in order)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["item_id"].tolist(), clean(b["text"])
            for lo, hi in chunks(texts):
                w = words_of(texts[lo:hi], ALNUM)
                out = []
                for at, (a, z) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    n = min(window, z - a)
                    if n == 0:
                        continue
                    k = min(shingle, n)
                    hashes = runs(w.hash[a:z], k).view(np.int64)
                    out += [(ids[lo + at], w.text(s, s + n), n, hashes[s - a : s - a + n - k + 1].tolist()) for s in range(a, z - n + 1)]
                yield pd.DataFrame(out, columns=["item_id", "window", "n", "shingles"])

    text_batches(items.sparkSession)
    # F.col: an extra column may have any name
    picked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_frames(picked.where("item_id IS NOT NULL"), cut, "item_id bigint, window string, n int, shingles array<bigint>")


def _lookup(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Indexes of the values that are among the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.flatnonzero(sorted_keys[at] == values)


def shingle_counts(docs: DataFrame, shingles: dict[int, np.ndarray]) -> DataFrame:
    """How often each given shingle, by its number of words, occurs in all documents."""
    given = docs.sparkSession.sparkContext.broadcast(shingles)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = clean(b["text"])
            found = []
            for lo, hi in chunks(texts):
                w = words_of(texts[lo:hi], ALNUM)
                for k, keys in given.value.items():
                    hashes = runs(w.hash, k)
                    found.append(hashes[_lookup(keys, hashes)])
            values, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"shingle": values.view(np.int64), "n": n})

    return map_frames(keyed(docs).select("text"), count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def rarest_shingles(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its rarest shingle and that shingle's offset."""
    each = windows.select("window", "n", F.size("shingles").alias("m"), F.posexplode("shingles").alias("at", "shingle"))
    ranked = each.join(counts.withColumnRenamed("n", "seen"), "shingle", "left")
    return ranked.groupBy("window", "n", "m").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "at")).alias("best")
    ).select("window", "n", (F.col("n") - F.col("m") + 1).alias("k"), "best.shingle", "best.at")


def candidates(docs: DataFrame, anchors: pd.DataFrame) -> DataFrame:
    """One row per document: n_words and the places where a window may lie, with the words there.

    ``anchors``: shingle, k, at and n of every distinct place a shingle has in a window.
    """
    by_k = {}
    for k, g in anchors.groupby("k"):
        keys = g["shingle"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        by_k[int(k)] = keys[order], g["at"].to_numpy(np.int64)[order], g["n"].to_numpy(np.int64)[order]
    given = docs.sparkSession.sparkContext.broadcast(by_k)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = clean(b["text"])
            for lo, hi in chunks(texts):
                w = words_of(texts[lo:hi], ALNUM)
                places = [[] for _ in range(hi - lo)]
                for k, (keys, offset, length) in given.value.items():
                    hashes = runs(w.hash, k)
                    hit = _lookup(keys, hashes)
                    left, right = np.searchsorted(keys, hashes[hit]), np.searchsorted(keys, hashes[hit], "right")
                    doc = np.searchsorted(w.first, hit, "right") - 1
                    for i, a, z, d in zip(hit.tolist(), left.tolist(), right.tolist(), doc.tolist()):
                        begin, stop = int(w.first[d]), int(w.first[d + 1])
                        for j in range(a, z):
                            s = i - int(offset[j])
                            if s >= begin and s + int(length[j]) <= stop:
                                places[d].append((s - begin, int(length[j]), w.text(s, s + int(length[j]))))
                part = b.iloc[lo:hi]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "row": part["row"],
                        "n_words": np.diff(w.first),
                        "places": [[{"start": s, "n": n, "window": t} for s, n, t in p] for p in places],
                    }
                )

    schema = "doc_id bigint, row bigint, n_words bigint, places array<struct<start:int,n:int,window:string>>"
    text_batches(docs.sparkSession)
    return map_frames(keyed(docs), match, schema)


def window_hits(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, part_windows: int = PART_WINDOWS
) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): (doc_id, row, n_words) of every row, and (doc_id, row, start, n, item_ids) of every window found."""
    windows = durable(item_windows(items, window, shingle).withColumn("part", F.xxhash64("window")))
    parts = max(1, -(-windows.count() // part_windows))
    held = windows.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))
    documents, hits = None, []
    for part in range(parts):
        own = windows.where(F.pmod("part", F.lit(parts)) == part)
        each = own.select((F.col("n") - F.size("shingles") + 1).alias("k"), F.explode("shingles").alias("shingle")).distinct().toPandas()
        keys = {int(k): np.sort(g["shingle"].to_numpy(np.int64).view(np.uint64)) for k, g in each.groupby("k")}
        anchors = durable(rarest_shingles(own, shingle_counts(docs, keys)))
        found = durable(candidates(docs, anchors.select("shingle", "k", "at", "n").distinct().toPandas()))
        documents = found.select("doc_id", "row", "n_words") if documents is None else documents
        placed = found.select("doc_id", "row", F.explode("places").alias("p")).select("doc_id", "row", "p.*").distinct()
        hits.append(placed.join(held, "window").select("doc_id", "row", "start", "n", "item_ids"))
    for h in hits[1:]:
        hits[0] = hits[0].unionByName(h)
    return documents, hits[0]


def contamination(docs: DataFrame, items: DataFrame, words_per_hit: int = WORDS_PER_HIT, **options) -> DataFrame:
    """Per row: doc_id, row, n_words, n_hit, item_ids (sorted as strings), spans of hit words and the verdict."""
    documents, hits = window_hits(docs, items, **options)
    per_doc = hits.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("found"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("item_ids"))), lambda i: i.cast("string"))).alias("item_ids"),
    )
    covered = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["stop"], x["stop"]).alias("stop"),
            (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["stop"], x["start"]))).alias("n"),
        ),
    )["n"]
    per_doc = per_doc.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "item_ids", F.col("found").alias("spans"), covered.alias("n_hit"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))
    joined = documents.join(per_doc, same, "left")
    n_hit = F.coalesce(F.col("n_hit").cast("bigint"), F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id",
        "row",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        "spans",
        ((n_hit > 0) & (n_hit * words_per_hit >= F.col("n_words"))).alias("contaminated"),
    )
