"""Least squares per entity from second moments.

One aggregation yields means, variances and covariances of features and target
(Spark's covariance aggregate is numerically stable and combines map-side). The
system that remains has one row per entity and a handful of columns; it is solved
in vectorised batches where the row lives, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def second_moments(df: DataFrame, by: Sequence[str], feats: Sequence[str], y: str) -> DataFrame:
    """Counts, means, variances and covariances over rows complete in all columns."""
    cols = [*feats, y]
    complete = df.dropna(subset=cols).select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m_{c}") for c in cols]
    aggs += [F.var_pop(c).alias(f"v_{c}") for c in cols]
    aggs += [F.covar_pop(a, b).alias(f"c_{a}__{b}") for a, b in combinations(cols, 2)]
    return complete.groupBy(*by).agg(*aggs)


def ols_gram(df: DataFrame, feats: Sequence[str], y: str, by: Sequence[str], min_n: int = 100) -> DataFrame:
    """Coefficients per entity: ``n, intercept, coef_<feature>…``.

    The features are scaled to unit deviation before the solve; a feature without
    variance, or an exactly collinear set, gets the minimum-norm solution.
    """
    by, feats = list(by), list(feats)
    moments = second_moments(df, by, feats, y).where(F.col("n") >= min_n)
    by_fields = [f for f in moments.schema.fields if f.name in by]
    out_fields = [*by_fields, T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType())]
    out_fields += [T.StructField(f"coef_{f}", T.DoubleType()) for f in feats]
    schema = T.StructType(out_fields)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(feats)
        for pdf in batches:
            if pdf.empty:
                continue
            gram = np.zeros((len(pdf), k, k))
            cross = np.zeros((len(pdf), k))
            for i, a in enumerate(feats):
                gram[:, i, i] = pdf[f"v_{a}"]
                cross[:, i] = pdf[f"c_{a}__{y}"]
            for (i, a), (j, b) in combinations(enumerate(feats), 2):
                gram[:, i, j] = gram[:, j, i] = pdf[f"c_{a}__{b}"]
            scale = np.sqrt(np.einsum("nii->ni", gram))
            scale[scale == 0.0] = 1.0
            scaled = gram / scale[:, :, None] / scale[:, None, :]
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(scaled, hermitian=True), cross / scale) / scale
            means = np.column_stack([pdf[f"m_{a}"] for a in feats])
            out = pdf[by].copy()
            out["n"] = pdf["n"].to_numpy()
            out["intercept"] = pdf[f"m_{y}"].to_numpy() - (means * beta).sum(axis=1)
            for i, a in enumerate(feats):
                out[f"coef_{a}"] = beta[:, i]
            yield out

    return moments.mapInPandas(solve, schema)


def apply_coefficients(df: DataFrame, coefs: DataFrame, feats: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Join one coefficient row per entity and add the fitted value ``name``."""
    joined = df.join(coefs.drop("n"), list(by))
    fitted = F.col("intercept")
    for f in feats:
        fitted = fitted + F.col(f"coef_{f}") * F.col(f).cast("double")
    return joined.withColumn(name, fitted).drop("intercept", *[f"coef_{f}" for f in feats])


def two_feature_ols(df: DataFrame, by: Sequence[str], x1: str, x2: str, y: str, min_n: int = 3) -> DataFrame:
    """Closed form for two features: a pure aggregate, no Python worker."""
    a, b, c = (F.col(n).cast("double") for n in (x1, x2, y))
    v1, v2 = F.var_pop(a), F.var_pop(b)
    c12, c1y, c2y = F.covar_pop(a, b), F.covar_pop(a, c), F.covar_pop(b, c)
    det = v1 * v2 - c12 * c12
    b1 = F.when(det > 0, (c1y * v2 - c2y * c12) / det)
    b2 = F.when(det > 0, (c2y * v1 - c1y * c12) / det)
    return (
        df.dropna(subset=[x1, x2, y])
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            b1.alias(f"coef_{x1}"),
            b2.alias(f"coef_{x2}"),
            (F.avg(c) - b1 * F.avg(a) - b2 * F.avg(b)).alias("intercept"),
        )
        .where(F.col("n") >= min_n)
    )
