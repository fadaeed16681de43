import random

import numpy as np
import pytest

from pulsegrid.operators import steady as S

DDL = "activity_id BIGINT, row_pos BIGINT, elapsed_sec DOUBLE, heart_rate INT, speed DOUBLE, altitude DOUBLE, distance DOUBLE, temperature DOUBLE, cadence INT, ground_contact_time DOUBLE, stride_length DOUBLE"


def series(aid, n, hr=lambda i: 140, step=lambda i: 3.0, alt=lambda i: 100.0, speed=lambda i: 3.0, temp=lambda i: 20.0, start=300.0):
    out, d = [], 0.0
    for i in range(n):
        d += step(i)
        out.append((aid, i, start + i, hr(i), speed(i), alt(i), d, temp(i), 85, None, 100.0))
    return out


def frame(spark, *parts):
    return spark.createDataFrame([r for p in parts for r in p], DDL).repartition(5)


def brute(rows):
    """Steady samples of one activity, by the definition."""
    alt = [r[5] for r in rows]
    smooth = []
    for i in range(len(rows)):
        w = [a for a in alt[max(0, i - 7) : i + 8] if a is not None]
        smooth.append(sum(w) / len(w) if w else 0.0)
    out = []
    for i in range(1, len(rows)):
        _, _, el, hr, v, _, d, *_ = rows[i]
        if v is None or hr is None or el is None or el < 300 or v < 1.5 or hr < 100:
            continue
        p = rows[i - 1][6]
        if d is None or p is None or d - p < 1.0:
            continue
        g = max(-0.45, min(0.45, (smooth[i] - smooth[i - 1]) / (d - p)))
        cost = max(1.0, 155.4 * g**5 - 30.4 * g**4 - 43.3 * g**3 + 46.3 * g**2 + 19.5 * g + 3.6)
        out.append((i, v * cost / 3.6, hr, el))
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_mark_steady_matches_the_definition(spark, block):
    rng = random.Random(5)
    rows = series(
        7,
        400,
        hr=lambda i: rng.choice([None, 90, 120, 150]),
        step=lambda i: rng.choice([0.0, 0.99, 1.0, 4.0]),
        alt=lambda i: rng.choice([None, 100.0, 130.0]) if i > 20 else None,
        speed=lambda i: rng.choice([None, 1.0, 1.5, 3.0]),
        start=200.0,
    )
    got = S.mark_steady(frame(spark, rows), block=block).where("steady").orderBy("row_pos").collect()
    want = brute(rows)
    assert [r.row_pos for r in got] == [w[0] for w in want]
    np.testing.assert_allclose([r.gap_speed for r in got], [w[1] for w in want])
    assert S.mark_steady(frame(spark, rows), block=block).count() == 400


def test_raw_and_steady_row_guards(spark):
    df = frame(
        spark,
        series(1, 59),
        series(2, 60),
        series(3, 100, speed=lambda i: 3.0 if i < 31 else 1.0),
        series(4, 100, speed=lambda i: 3.0 if i < 30 else 1.0),
        series(5, 400, start=0.0),
    )
    used = {r.activity_id: r.seconds_used for r in S.run_ce(S.mark_steady(df)).collect()}
    # the first sample has no predecessor; warm-up samples do not count
    assert used == {2: 59, 3: 30, 5: 100}


def test_run_ce_values_and_missing_temperature(spark):
    df = frame(spark, series(1, 100), series(2, 100, temp=lambda i: 30.0), series(3, 100, temp=lambda i: None))
    ce = {r.activity_id: r for r in S.run_ce(S.mark_steady(df)).collect()}
    raw = 3.0 / 140
    assert ce[1].ce == pytest.approx(raw) and ce[3].ce == pytest.approx(raw) and ce[3].avg_temp is None
    assert ce[2].ce == pytest.approx(raw + 0.000111 * 10)
    assert ce[1].avg_gct is None and ce[1].avg_stride == 100.0 and ce[1].hr_cv == 0.0


def test_drift_value_and_skip_reasons(spark):
    def swing(pct):
        return lambda i: round(150 * (1 + pct / 100 * (1 if i % 2 else -1)))

    df = frame(
        spark,
        series(1, 201, hr=lambda i: 140 if i <= 100 else 154),
        series(2, 60),
        series(3, 61),
        series(4, 200, hr=swing(8.0)),
        series(5, 200, hr=swing(9.4)),
        # one long pause: few samples before the elapsed midpoint
        [(6, i, 300.0 + (i if i < 15 else 1000 + i), 140, 3.0, 100.0, 3.0 * i, 20.0, 85, None, 100.0) for i in range(200)],
    )
    out = {r.activity_id: r for r in S.drift_from_details(df).collect()}
    assert {k: r.skip_reason for k, r in out.items()} == {1: None, 2: "TooShort", 3: None, 4: None, 5: "IntervalWorkout", 6: "UnevenHalves"}
    first, second = 3.0 / 140, 3.0 / 154
    assert out[1].hr_h1 == pytest.approx(140.0, abs=0.2) and out[1].decoupling_pct == pytest.approx((first - second) / first * 100, abs=0.2)
    assert out[6].decoupling_pct is None


def test_steady_rows_only_from_accepted_activities(spark):
    df = frame(spark, series(1, 59), series(2, 80))
    assert {r.activity_id for r in S.steady_rows(df).select("activity_id").distinct().collect()} == {2}


def test_missing_dynamics_columns(spark):
    df = frame(spark, series(1, 100)).drop("cadence", "ground_contact_time", "stride_length", "temperature")
    r = S.run_ce(S.mark_steady(df)).first()
    assert r.avg_cadence is None and r.ce == pytest.approx(3.0 / 140)


def test_order_of_input_does_not_matter(spark):
    rows = series(1, 300, hr=lambda i: 130 + i % 20, alt=lambda i: 100.0 + i % 13)
    a = S.run_ce(S.mark_steady(frame(spark, rows), block=64)).first()
    b = S.run_ce(S.mark_steady(frame(spark, rows[::-1]).coalesce(1))).first()
    assert a.ce == pytest.approx(b.ce, rel=1e-12) and a.first_elapsed == b.first_elapsed


def test_drift_marks_its_samples_once(spark):
    """Both passes read one written table: no window is left in the plan."""
    df = frame(spark, series(1, 201, hr=lambda i: 140 if i <= 100 else 154), series(2, 100))
    out = S.drift_from_details(df)
    assert {r.activity_id: r.skip_reason for r in out.collect()} == {1: None, 2: None}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
