import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates as A
from pulsegrid.operators import windows as W

from .builders import day

BY = ["e"]


@pytest.fixture(scope="module")
def spine(spark):
    """Two entities × 120 days with calendar gaps and null runs of 1, 14, 15 and 31 rows."""
    rows = []
    for e in (1, 2):
        rng = random.Random(e)
        d = day("2024-01-01")
        for i in range(120):
            d += dt.timedelta(days=rng.choice([1, 1, 1, 2, 5]))
            gap = i == 5 or 20 <= i < 34 or 40 <= i < 55 or 70 <= i < 101
            rows.append((e, d, None if gap else float(rng.randrange(100))))
    pdf = pd.DataFrame(rows, columns=["e", "date", "v"])
    return spark.createDataFrame(rows, "e INT, date DATE, v DOUBLE").repartition(7), pdf


def collect(df, col):
    pdf = df.select("e", "date", col).toPandas().sort_values(["e", "date"])
    return pdf[col].to_numpy(dtype=float)


@pytest.mark.parametrize("n, need, shift", [(7, 5, 0), (7, 7, 1), (28, 28, 1), (7, 5, 1), (4, 2, 0)])
def test_trailing_rows_match_pandas(spine, n, need, shift):
    df, pdf = spine
    got = collect(df.withColumn("x", W.trailing("v", BY, "date", n, "avg", need, shift)), "x")
    want = pdf.groupby("e").v.transform(lambda s: s.shift(shift).rolling(n, min_periods=need).mean()).to_numpy()
    np.testing.assert_allclose(got, want, equal_nan=True)


def test_trailing_std_is_the_sample_deviation(spine):
    df, pdf = spine
    got = collect(df.withColumn("x", W.trailing("v", BY, "date", 7, "std", 5)), "x")
    want = pdf.groupby("e").v.transform(lambda s: s.rolling(7, min_periods=5).std()).to_numpy()
    np.testing.assert_allclose(got, want, equal_nan=True)


def test_trailing_days_honour_the_calendar(spine):
    df, pdf = spine
    got = collect(df.withColumn("x", W.trailing("v", BY, "date", 7, "sum", 1, frame="days")), "x")
    want = []
    for _, g in pdf.groupby("e"):
        for d in g.date:
            v = g.v[(g.date <= d) & (g.date > d - dt.timedelta(days=7))].dropna()
            want.append(v.sum() if len(v) else np.nan)
    np.testing.assert_allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("limit", [14, 30])
def test_ffill_carries_at_most_limit_rows(spine, limit):
    df, pdf = spine
    got = collect(df.withColumn("x", W.ffill("v", BY, "date", limit)), "x")
    want = pdf.groupby("e").v.transform(lambda s: s.ffill(limit=limit)).to_numpy()
    np.testing.assert_allclose(got, want, equal_nan=True)


def test_next_row_is_a_row_not_a_day(spine):
    df, pdf = spine
    got = collect(df.withColumn("x", W.next_row("v", BY)), "x")
    np.testing.assert_allclose(got, pdf.groupby("e").v.shift(-1).to_numpy(), equal_nan=True)


@pytest.mark.parametrize("n, folds", [(36, 0), (37, 1), (44, 2)])
def test_expanding_folds_drop_an_incomplete_tail(spark, n, folds):
    df = spark.range(n).select(F.lit(1).alias("e"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    out = W.expanding_folds(df, BY, "date").toPandas().sort_values("date")
    assert sorted(out.fold.dropna().unique()) == list(range(folds))
    assert (out.fold.dropna().value_counts() == 7).all()
    assert out.fold[:30].isna().all()


def test_row_positions_and_halo_match_one_big_window(spark):
    rng = random.Random(3)
    # one entity holds most rows
    rows = [(1 if rng.random() < 0.8 else 2, rng.randrange(40), i, rng.random() if rng.random() < 0.9 else None) for i in range(1500)]
    pdf = pd.DataFrame(rows, columns=["e", "t", "id", "v"]).sort_values(["e", "t", "id"]).reset_index(drop=True)
    pdf["pos"] = pdf.groupby("e").cumcount()
    df = spark.createDataFrame(rows, "e INT, t INT, id INT, v DOUBLE")
    placed = W.row_positions(df, BY, F.col("t"), ["t", "id"], "pos")
    got = placed.toPandas().sort_values(["e", "t", "id"]).reset_index(drop=True)
    assert (got.pos == pdf.pos).all()

    framed = W.with_halo(placed, "pos", 16, before=8, after=7)
    smooth = framed.withColumn("x", W.centred_mean("v", BY, "pos", 7)).withColumn("dx", F.col("x") - W.lag_in_block("x", BY, "pos")).where(W.CORE)
    out = smooth.toPandas().sort_values(["e", "pos"]).reset_index(drop=True)
    want = pdf.groupby("e").v.transform(lambda s: s.rolling(15, center=True, min_periods=1).mean().fillna(0.0))
    np.testing.assert_allclose(out.x, want)
    np.testing.assert_allclose(out.dx, want.groupby(pdf.e).diff(), equal_nan=True)

    ten = W.rolling_mean_rows(placed.fillna(0.0, ["v"]), BY, "pos", "v", 10, "m", size=16).toPandas().sort_values(["e", "pos"])
    full = pdf.fillna({"v": 0.0}).groupby("e").v.transform(lambda s: s.rolling(10).mean())
    np.testing.assert_allclose(ten.m, full, equal_nan=True)


@pytest.mark.parametrize("task_rows", [0, 300, 10**6])
def test_row_positions_of_large_and_small_entities(spark, task_rows):
    """Entities above and below the size of a task, rows without an entity or a day."""
    rng = random.Random(5)
    rows = [(rng.randrange(40), i, e) for i, e in enumerate([1] * 900 + [2] * 200 + [3])] + [(4, 5000, None), (None, 5001, 1)]
    df = spark.createDataFrame(rows, "t INT, id INT, e INT")
    placed = W.row_positions(df, BY, F.col("t"), ["t", "id"], "pos", task_rows)
    assert placed.columns == ["e", "t", "id", "pos"] and dict(placed.dtypes)["pos"] == "bigint"
    got = sorted((r.e, r.t, r.id, r.pos) for r in placed.collect())
    want, at = [], {1: 1}  # the row without a day has a place, the first
    for e, t, i in sorted((e, t, i) for t, i, e in rows if e is not None and t is not None):
        want.append((e, t, i, at.get(e, 0)))
        at[e] = at.get(e, 0) + 1
    assert got == want


def test_positions_blocks_and_totals_take_one_exchange(spark):
    df = spark.range(4000).select((F.col("id") % 7).alias("e"), F.col("id").alias("t"), F.rand(1).alias("v"))
    placed = W.row_positions(df, BY, F.col("t"), ["t"], "pos")
    smooth = W.with_halo(placed, "pos", 64, before=8, after=7).withColumn("x", W.centred_mean("v", BY, "pos", 7)).where(W.CORE)
    out = smooth.groupBy("e").agg(F.sum("x").alias("x"))
    assert len(out.collect()) == 7
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_keep_last_and_last_n(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (None, 1, "c"), (None, 2, "d")], "k INT, o INT, v STRING")
    assert sorted((r.k or 0, r.v or "") for r in W.keep_last(df, ["k"], ["o"]).collect()) == [(0, "d"), (1, "")]
    assert W.last_n(df, ["k"], ["o"], 2).count() == 4


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_floor_rank_quantile_takes_the_upper_median(spark, n):
    values = list(range(10, 10 + n))
    random.Random(n).shuffle(values)
    df = spark.createDataFrame([(1, float(v)) for v in values], "e INT, v DOUBLE")
    got = A.floor_rank_quantile(df, BY, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).first()
    s = sorted(values)
    assert (got.p25, got.p50, got.p75) == (s[n // 4], s[n // 2], s[3 * n // 4])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 2), st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True, width=64), st.integers(-5, 5).map(float))), min_size=1, max_size=60))
def test_floor_rank_quantile_property(spark, rows):
    df = spark.createDataFrame(rows, "e INT, v DOUBLE")
    got = {r.e: (r.lo, r.mid) for r in A.floor_rank_quantile(df, BY, "v", {"lo": 0.25, "mid": 0.5}).collect()}
    want = {}
    for e in (1, 2):
        s = sorted(v for k, v in rows if k == e and v is not None and np.isfinite(v))
        if s:
            want[e] = (s[len(s) // 4], s[len(s) // 2])
    assert got == want
