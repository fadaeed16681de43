import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.functions import stats

from .builders import day


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def num(v):
    return F.lit(v).cast("double")


def test_month_series_including_inverted_range(spark):
    def months(a, b):
        return one(spark, S.months_between_inclusive(F.lit(a).cast("date"), F.lit(b).cast("date")))

    assert len(months("2024-03-05", "2024-03-25")) == 1
    assert [d.strftime("%Y-%m") for d in months("2023-11-15", "2024-02-10")] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert months("2024-02-01", "2024-01-01") == []


@pytest.mark.parametrize("sec, text", [(0.4, "0:00"), (-0.3, "0:00"), (-15.0, "-0:15"), (59.6, "1:00"), (301.0, "5:01"), (3725.0, "62:05")])
def test_fmt_pace(spark, sec, text):
    assert one(spark, S.fmt_pace(num(sec))) == text


def test_other_formats(spark):
    assert one(spark, S.fmt_time(num(3725.4))) == "1:02:05"
    assert one(spark, S.fmt_time(num(59.5))) == "1:00"
    assert one(spark, S.fmt_speed_pace(num(0.0))) == "---"
    assert one(spark, S.fmt_speed_pace(num(3.0))) == "5:33"
    assert [one(spark, S.fmt_secs(F.lit(v))) for v in (7, 61, 3661)] == ["7s", "1m01s", "1h01m"]


@pytest.mark.parametrize("km, label", [(4.79, None), (4.80, "5K"), (5.40, "5K"), (5.41, None), (9.60, "10K"), (22.20, "Half Marathon"), (43.50, "Marathon"), (43.51, None)])
def test_distance_bucket_bounds(spark, km, label):
    assert one(spark, S.distance_bucket(num(km))) == label


def test_quality_bounds(spark):
    assert [one(spark, S.quality(num(v), num(100.0))) for v in (100, 105, 105.1, 109.9, 110)] == ["good", "good", "neutral", "neutral", "bad"]
    assert one(spark, S.quality(num(1.0), num(0.0))) is None


@pytest.mark.parametrize(
    "km, hard, stress, rhr, acwr, level",
    [
        (5.1, 0, 3.1, 1.1, None, "RED"),
        (5.1, 3, 3.1, None, None, "RED"),
        (5.1, 2, 3.1, 1.0, None, "YEL"),
        (5.0, 3, 9.0, 9.0, 1.4, ""),
        (5.0, 3, 9.0, 9.0, 1.6, "VOL"),
        (9.0, 0, 3.0, 5.0, 1.5, ""),
        (9.0, 9, None, None, None, ""),
    ],
)
def test_warning_precedence(spark, km, hard, stress, rhr, acwr, level):
    assert one(spark, S.warning_level(num(km), F.lit(hard), num(stress), num(rhr), num(acwr))) == level


def test_z_score_and_readiness(spark):
    assert one(spark, S.zscore(num(70.0), num(60.0), num(5.0), -1.0)) == -2.0
    assert one(spark, S.zscore(num(70.0), num(60.0), num(0.0), 1.0)) == 0.0
    assert one(spark, S.zscore(num(None), num(60.0), num(0.0), 1.0)) is None
    assert [one(spark, S.readiness_score(num(z))) for z in (-9.0, -2.0, 0.0, 2.0, 9.0)] == [1.0, 1.0, 5.5, 10.0, 10.0]


def test_guards_do_not_raise_under_ansi(spark):
    assert one(spark, S.safe_div(num(1.0), num(0.0))) is None
    assert one(spark, S.taper(num(1.0), num(0.0))) is None
    assert one(spark, S.taper(num(10.0), num(60.0))) == 0.5
    assert one(spark, S.scale_0_20(num(3.0), num(3.0), num(3.0))) == 10
    assert one(spark, S.adjusted_ce(num(3.0), num(0.0), num(20.0))) is None


def test_minetti_is_clamped_and_floored(spark):
    assert one(spark, S.minetti_cost(num(0.0))) == pytest.approx(3.6)
    assert one(spark, S.minetti_cost(num(9.0))) == pytest.approx(one(spark, S.minetti_cost(num(0.45))))
    assert one(spark, S.gap_speed(num(3.6), num(-0.2))) >= 1.0


def test_haversine(spark):
    got = one(spark, S.haversine(num(52.52), num(13.405), num(48.8566), num(2.3522)))
    assert got == pytest.approx(877_464, rel=1e-3)
    assert one(spark, S.haversine(num(10.0), num(179.9995), num(10.0), num(-179.9995))) == pytest.approx(109.5, rel=1e-2)


def test_text_helpers(spark):
    horses = "🐎" * 40
    assert one(spark, S.ellipsis(F.lit(horses), 10)) == "🐎" * 9 + "…"
    assert one(spark, S.ellipsis(F.lit("short"), 10)) == "short"
    assert one(spark, S.strip_prefix(F.lit("next_day_hrv"), "next_day_")) == "hrv"
    assert [one(spark, S.clean_place(F.lit(v))) for v in ('"null"', "null", '""', '"Cary"')] == [None, None, None, "Cary"]


def test_json_race_predicate(spark):
    def race(text):
        return one(spark, S.json_is(F.lit(text).cast("string"), "$.eventType.typeKey", "race"))

    assert [race(t) for t in ('{"eventType":{"typeKey":"race"}}', '{"eventType":{}}', "{bad", None)] == [True, False, False, False]
    assert [one(spark, S.json_malformed(F.lit(t).cast("string"))) for t in ("{}", "{bad", "", None)] == [False, True, True, True]


def test_calendar(spark):
    d = F.lit("2024-12-30").cast("date")
    assert one(spark, S.iso_week_label(d)) == "2025-W01"
    assert one(spark, S.week_start(F.lit("2024-12-29").cast("date"))) == day("2024-12-23")
    assert one(spark, S.weekday_sin(F.lit("2024-12-29").cast("date"))) == pytest.approx(math.sin(2 * math.pi), abs=1e-9)
    assert one(spark, S.epoch_ms_text(F.lit(1_700_000_000_123))) == "2023-11-14T22:13:20"
    assert one(spark, S.epoch_us_date(F.lit(-1))) == day("1969-12-31")
    assert one(spark, S.partition_month(F.lit("2024-07.parquet"))) == day("2024-07-01")
    assert one(spark, S.partition_month(F.lit("7.parquet"))) is None
    assert one(spark, S.partition_week(F.lit("2024-W09"))) == "2024-W09"


def aggregate(spark, rows, expr):
    return spark.createDataFrame(rows, "x DOUBLE, y DOUBLE").agg(expr(F.col("x"), F.col("y")).alias("v")).first().v


def test_correlation_variants(spark):
    line = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]
    flat = [(1.0, 5.0), (1.0, 6.0), (1.0, 7.0)]
    dirty = line + [(float("nan"), 1.0), (float("inf"), 1.0), (None, 3.0)]
    assert aggregate(spark, dirty, stats.corr_safe) == pytest.approx(1.0)
    assert aggregate(spark, line, stats.corr_or_zero) == pytest.approx(1.0)
    assert aggregate(spark, flat, stats.corr_safe) is None
    assert aggregate(spark, flat, stats.corr_or_zero) == 0.0
    assert aggregate(spark, line[:2], stats.corr_or_zero) == 0.0
    assert aggregate(spark, line[:2], stats.corr_safe) == pytest.approx(1.0)
    assert aggregate(spark, flat, stats.slope_safe) is None
    assert aggregate(spark, line, stats.slope_safe) == pytest.approx(2.0)
    assert aggregate(spark, line, stats.intercept_safe) == pytest.approx(0.0, abs=1e-12)


def test_error_metrics(spark):
    rows = [(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)]
    assert aggregate(spark, rows, stats.mae) == pytest.approx(1.0)
    assert aggregate(spark, rows, stats.rmse) == pytest.approx((5 / 3) ** 0.5)
    assert aggregate(spark, rows, stats.r_squared) == pytest.approx(1 - 5 / 2)
    assert aggregate(spark, [(1.0, 2.0), (1.0, 3.0)], stats.r_squared) == 0.0


def test_percentile_is_strict(spark):
    rows = [(float(i), 3.0) for i in range(1, 6)]
    assert aggregate(spark, rows, stats.percentile_of) == 40
