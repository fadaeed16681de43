"""Pipeline stages: each applies one operator to the documents its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``;
``n_chars``, where there is one, follows a changed text. Further columns are kept whatever their names; those that a stage
needs for itself get names that are free. An empty table stays empty. A null or empty text has no lines, passages or words to act on,
so only the classifier may drop it. Rows that are equal in id and text share one verdict, and near-duplicates keep
every row of the id they keep. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, linededup, mixing, neardup
from . import quality as classifier
from ._text import clean, map_frames, text_batches, unused


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` that ``verdicts`` (doc_id and row, perhaps several times) do not name."""
    doc, row, named = (unused(docs.columns, c) for c in ("__id", "__row", "__named"))
    picked = verdicts.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.lit(True).alias(named)).dropDuplicates([doc, row])
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(row))
    return docs.join(picked, same, "left").where(F.col(named).isNull()).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents hold too; every document stays."""
    text_batches(spark)
    dropped, bitmap = unused(docs.columns, "__dropped"), unused(docs.columns, "__bitmap")
    marked = linededup.with_bitmaps(docs, linededup.keep_bitmaps(docs), dropped, bitmap).drop(dropped)

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [linededup.kept_text(t, m)[0] for t, m in zip(clean(b["text"]), b[bitmap])]
            b["text"] = [k if m is not None else t for k, m, t in zip(kept, b[bitmap], clean(b["text"]))]
            yield b.drop(columns=[bitmap])

    out = map_frames(marked, rebuild, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates."""
    verdicts = neardup.near_duplicates(docs).where("NOT kept")
    return _without(docs, verdicts)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    found = decontam.contamination(docs, _table(spark, sf_dir, "benchmark")).where("contaminated")
    return _without(docs, found)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = classifier.train(docs, _table(spark, sf_dir, "labels"))
    score = unused(docs.columns, "__score")
    return classifier.scored(docs, model, score).where(F.col(score) >= classifier.THRESHOLD).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, with their places in it."""
    return mixing.in_order(mixing.mix(docs))
