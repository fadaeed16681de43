import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.ranges import Range, asof_last, range_features, similar_runs

from .builders import day

BY = ["e"]
ROWS = "e INT, date DATE, v DOUBLE, s STRING, seq INT"


def brute(anchors, rows):
    out = {}
    for e, d in anchors:
        def vals(far, near=1, field=2):
            return [r[field] for r in rows if r[0] == e and near <= (d - r[1]).days <= far]

        v28 = [x for x in vals(28) if x is not None]
        s28 = [x for x in vals(28, field=3) if x is not None]
        last = [(r[1], r[4], r[2]) for r in rows if r[0] == e and 1 <= (d - r[1]).days <= 30 and r[2] is not None]
        out[(e, d)] = (
            sum(x for x in vals(7) if x is not None),
            sum(x for x in vals(28, 8) if x is not None),
            np.mean(v28) if v28 else None,
            max(v28, default=None),
            len(vals(84)),
            np.mean([x > 50 for x in v28]) if v28 else None,
            np.mean([x in ("A", "B") for x in s28]) if s28 else None,
            max(last)[2] if last else None,
        )
    return out


@pytest.mark.parametrize("seed", range(3))
def test_all_windows_against_brute_force(spark, seed):
    rng = random.Random(seed)
    start = day("2023-01-01")
    rows = [
        (rng.choice([1, 1, 1, 2]), start + dt.timedelta(days=rng.randrange(300)), rng.choice([None, float(rng.randrange(100))]), rng.choice([None, "A", "B", "C"]), i)
        for i in range(250)
    ]
    anchors = [(rng.choice([1, 2, 3]), start + dt.timedelta(days=rng.randrange(-5, 330))) for _ in range(60)]
    anchors += anchors[:5]  # repeated anchors must not multiply
    a = spark.createDataFrame(anchors, "e INT, date DATE").withColumn("i", F.monotonically_increasing_id())
    out = range_features(
        a,
        spark.createDataFrame(rows, ROWS),
        BY,
        [
            Range("sum7", "sum", "v", 7),
            Range("prior", "sum", "v", 28, 8),
            Range("mean", "mean", "v", 28),
            Range("max", "max", "v", 28),
            Range("n", "count", None, 84),
            Range("above", "share_above", "v", 28, arg=50.0),
            Range("in", "share_in", "s", 28, arg=["A", "B"]),
            Range("last", "last", "v", 30),
        ],
        order=["seq"],
    ).collect()
    assert len(out) == len(anchors)
    want = brute(anchors, rows)
    for r in out:
        for got, exp in zip((r.sum7, r.prior, r.mean, r["max"], r.n, r.above, r["in"], r.last), want[(r.e, r.date)]):
            assert (got is None) == (exp is None)
            if exp is not None:
                assert got == pytest.approx(exp)


def test_asof_tolerance_is_thirty_days(spark):
    rows = spark.createDataFrame([(1, day("2024-01-01"), 70.0), (1, day("2024-01-20"), None)], "e INT, date DATE, w DOUBLE")
    anchors = spark.createDataFrame([(1, day("2024-01-31")), (1, day("2024-02-01")), (1, day("2024-01-01"))], "e INT, date DATE")
    got = {r.date.isoformat(): r.w for r in asof_last(anchors, rows, BY, "w", 30).collect()}
    assert got == {"2024-01-31": 70.0, "2024-02-01": None, "2024-01-01": None}
    same_day = asof_last(anchors, rows, BY, "w", 30, include_same_day=True).where("date = '2024-01-01'").first().w
    assert same_day == 70.0


def test_similar_runs_bounds_are_inclusive_in_distance_only(spark):
    runs = [(1, 10, "2024-06-30", 10.0), (1, 1, "2024-06-29", 8.0), (1, 2, "2024-06-29", 12.0), (1, 3, "2024-06-29", 12.01), (1, 4, "2024-04-01", 10.0), (1, 5, "2024-04-02", 10.0)]
    df = spark.createDataFrame([(e, i, day(d), km) for e, i, d, km in runs], "e INT, activity_id INT, date DATE, distance_km DOUBLE")
    near = similar_runs(df, df.where("activity_id = 10"), BY)
    assert sorted(r.activity_id for r in near.collect()) == [1, 2, 5]
