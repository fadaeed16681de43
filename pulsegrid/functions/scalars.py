"""Column expressions: calendar, safe arithmetic, physiology, labels, text.

All of these stay inside whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
RUNNING_TYPES = ["running", "treadmill_running", "virtual_run"]
CROSS_TRAIN_TYPES = [
    "cycling",
    "indoor_cycling",
    "virtual_ride",
    "road_biking",
    "mountain_biking",
    "lap_swimming",
    "open_water_swimming",
    "hiking",
]
MINETTI = [155.4, -30.4, -43.3, 46.3, 19.5, 3.6]
FLAT_COST = 3.6
MAX_GRADE = 0.45
TEMP_COEFF = -0.000111
TEMP_REF = 20.0
EARTH_RADIUS_M = 6_371_000.0
# bucket label, inclusive km range, predictor column, nominal km
DISTANCE_BUCKETS = [
    ("5K", 4.80, 5.40, "race_5k_sec", 5.0),
    ("10K", 9.60, 10.80, "race_10k_sec", 10.0),
    ("Half Marathon", 20.50, 22.20, "race_half_sec", 21.0975),
    ("Marathon", 41.50, 43.50, "race_marathon_sec", 42.195),
]
GOOD_PCT_OFF = 0.05
BAD_PCT_OFF = 0.10


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


# -------------------------------------------------------------------- calendar
def iso_weekday(d: Column | str) -> Column:
    """Monday 1 … Sunday 7."""
    return F.weekday(col_of(d)) + 1


def weekday_sin(d: Column | str) -> Column:
    return F.sin(iso_weekday(d).cast("double") * F.lit(2.0 * math.pi / 7.0))


def weekday_cos(d: Column | str) -> Column:
    return F.cos(iso_weekday(d).cast("double") * F.lit(2.0 * math.pi / 7.0))


def week_start(d: Column | str) -> Column:
    return F.date_trunc("week", col_of(d)).cast("date")


def iso_week_label(d: Column | str) -> Column:
    d = col_of(d)
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


def month_label(d: Column | str) -> Column:
    return F.date_format(col_of(d), "yyyy-MM")


def day_number(d: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(col_of(d))


def epoch_ms_text(ms: Column | str) -> Column:
    """Epoch milliseconds as ``YYYY-MM-DDTHH:MM:SS``, whatever the session zone."""
    ms = col_of(ms)
    seconds = F.floor(ms / 1000)
    ntz = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
    return F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss")


def epoch_us_date(us: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(col_of(us) / F.lit(86_400_000_000)).cast("int"))


def months_between_inclusive(frm: Column, to: Column) -> Column:
    """First days of every month touched by [frm, to]; empty when frm > to."""
    first = F.trunc(frm, "month")
    # the step form raises on an inverted range, so the end is never before the start
    months = F.sequence(first, F.greatest(first, F.trunc(to, "month")), F.expr("INTERVAL 1 MONTH"))
    return F.when(frm <= to, months).otherwise(F.array().cast("array<date>"))


def month_end(d: Column | str) -> Column:
    return F.last_day(col_of(d))


def partition_month(name: Column | str) -> Column:
    """First day of the month encoded in a ``YYYY-MM`` file or folder name."""
    text = F.regexp_extract(col_of(name), r"(\d{4}-\d{2})(?:\.parquet)?$", 1)
    return F.try_to_date(F.concat(F.nullif(text, F.lit("")), F.lit("-01")))


def partition_week(name: Column | str) -> Column:
    """The ``YYYY-Wnn`` label of a file or folder name, null when absent."""
    return F.nullif(F.regexp_extract(col_of(name), r"(\d{4}-W\d{2})(?:\.parquet)?$", 1), F.lit(""))


# ------------------------------------------------------------- safe arithmetic
def safe_div(a: Column, b: Column) -> Column:
    """a / b where b > 0, else null."""
    return F.when(b > 0, a / b)


def taper(last_week: Column, prior_three_weeks: Column) -> Column:
    return F.when(prior_three_weeks > 0, 1.0 - last_week / (prior_three_weeks / 3.0))


def scale_0_20(v: Column, lo: Column, hi: Column) -> Column:
    """Min-max position on a 0..20 scale, 10 when the range is flat."""
    flat = F.abs(hi - lo) < 1e-9
    return F.when(flat, F.lit(10)).otherwise(
        F.round(F.try_divide(v - lo, hi - lo) * 20.0).cast("int")
    )


def squared(c: Column) -> Column:
    return c * c


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


# ------------------------------------------------------------------ physiology
def minetti_cost(grade: Column) -> Column:
    """Metabolic cost of running on a grade (J/kg/m), grade clamped to ±0.45."""
    g = clamp(grade, -MAX_GRADE, MAX_GRADE)
    cost = F.lit(MINETTI[0])
    for k in MINETTI[1:]:
        cost = cost * g + F.lit(k)
    return cost


def gap_speed(speed: Column, grade: Column) -> Column:
    return speed * F.greatest(minetti_cost(grade), F.lit(1.0)) / F.lit(FLAT_COST)


def adjusted_ce(gap: Column, hr: Column, temp: Column) -> Column:
    """Grade-adjusted speed per heart beat, normalised to 20 °C when known."""
    raw = safe_div(gap, hr)
    return F.coalesce(raw - F.lit(TEMP_COEFF) * (temp - F.lit(TEMP_REF)), raw)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat = F.radians(lat2 - lat1) / 2.0
    dlon = F.radians(lon2 - lon1) / 2.0
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


# ------------------------------------------------------------- pace and labels
def pace_sec_per_km(duration_sec: Column, distance_km: Column) -> Column:
    return safe_div(duration_sec, distance_km)


def _pad2(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def fmt_pace(sec_per_km: Column) -> Column:
    """``M:SS`` with a sign, never ``-0:00``."""
    total = F.round(F.abs(sec_per_km)).cast("bigint")
    sign = F.when((sec_per_km < 0) & (total != 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(total / 60).cast("string"), F.lit(":"), _pad2(total % 60))


def fmt_time(sec: Column) -> Column:
    """``H:MM:SS``, or ``M:SS`` below one hour."""
    total = F.round(sec).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    short = F.concat(m.cast("string"), F.lit(":"), _pad2(s))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _pad2(m), F.lit(":"), _pad2(s))).otherwise(short)


def fmt_speed_pace(speed_mps: Column) -> Column:
    total = F.round(F.try_divide(F.lit(1000.0), speed_mps)).cast("bigint")
    text = F.concat(F.floor(total / 60).cast("string"), F.lit(":"), _pad2(total % 60))
    return F.when(speed_mps > 0, text).otherwise(F.lit("---"))


def fmt_secs(secs: Column) -> Column:
    """``HhMMm``, ``MmSSs`` or ``SSs``."""
    secs = secs.cast("bigint")
    h, m, s = F.floor(secs / 3600), F.floor((secs % 3600) / 60), secs % 60
    hours = F.concat(h.cast("string"), F.lit("h"), _pad2(m), F.lit("m"))
    minutes = F.concat(m.cast("string"), F.lit("m"), _pad2(s), F.lit("s"))
    return F.when(secs >= 3600, hours).when(secs >= 60, minutes).otherwise(
        F.concat(s.cast("string"), F.lit("s"))
    )


def distance_bucket(km: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, lo, hi, _, _ in DISTANCE_BUCKETS:
        out = out.when((km >= lo) & (km <= hi), F.lit(label))
    return out


def by_bucket(bucket: Column, values: dict[str, Column | float]) -> Column:
    """Pick a value per bucket label (nominal km, predictor column, …)."""
    out = F.when(F.lit(False), F.lit(None))
    for label, value in values.items():
        out = out.when(bucket == label, value if isinstance(value, Column) else F.lit(value))
    return out


def nominal_km(bucket: Column) -> Column:
    return by_bucket(bucket, {label: km for label, _, _, _, km in DISTANCE_BUCKETS})


def predicted_pace(bucket: Column, seconds: dict[str, Column]) -> Column:
    """Predicted seconds of the bucket's distance, per kilometre."""
    picked = by_bucket(bucket, {label: seconds[p] for label, _, _, p, _ in DISTANCE_BUCKETS})
    return picked.cast("double") / nominal_km(bucket)


def quality(pace: Column, best: Column) -> Column:
    off = F.try_divide(pace - best, best)
    return (
        F.when(off <= GOOD_PCT_OFF, F.lit("good"))
        .when(off >= BAD_PCT_OFF, F.lit("bad"))
        .when(off.isNotNull(), F.lit("neutral"))
    )


def zscore(value: Column, mean: Column, std: Column, direction: float) -> Column:
    z = F.try_divide(value - mean, std) * F.lit(direction)
    return F.when((std < 0.001) & value.isNotNull(), F.lit(0.0)).otherwise(z)


def z_status(z: Column) -> Column:
    return (
        F.when(z > 0.5, F.lit("above avg")).when(z < -0.5, F.lit("below avg")).when(z.isNotNull(), F.lit("average"))
    )


def readiness_score(mean_z: Column) -> Column:
    return F.when(mean_z.isNotNull(), clamp((mean_z + 2.0) / 4.0 * 9.0 + 1.0, 1.0, 10.0))


def readiness_label(score: Column) -> Column:
    return (
        F.when(score >= 7.0, F.lit("ready to push"))
        .when(score >= 4.0, F.lit("normal day"))
        .when(score.isNotNull(), F.lit("recovery day"))
    )


def warning_level(weekly_km: Column, hard_runs: Column, stress_delta: Column, rhr_delta: Column, acwr: Column) -> Column:
    running = weekly_km > 5.0
    stress = stress_delta > 3.0
    strained = (rhr_delta > 1.0) | (hard_runs >= 3)
    return (
        F.when(running & stress & strained, F.lit("RED"))
        .when(running & stress, F.lit("YEL"))
        .when(acwr > 1.5, F.lit("VOL"))
        .otherwise(F.lit(""))
    )


def acwr_label(ratio: Column) -> Column:
    return (
        F.when(ratio > 1.5, F.lit("injury risk"))
        .when(ratio > 1.3, F.lit("building aggressively"))
        .when(ratio > 1.0, F.lit("building fitness"))
        .when(ratio >= 0.8, F.lit("maintaining"))
        .when(ratio >= 0.6, F.lit("losing fitness"))
        .when(ratio.isNotNull(), F.lit("detraining rapidly"))
    )


def acwr_regime(ratio: Column) -> Column:
    return (
        F.when(ratio < 0.8, F.lit("detraining"))
        .when(ratio > 1.3, F.lit("overtraining"))
        .when(ratio > 1.1, F.lit("safe_high"))
        .when(ratio < 0.9, F.lit("safe_low"))
        .when(ratio.isNotNull(), F.lit("safe"))
    )


def drift_label(pct: Column) -> Column:
    return (
        F.when(pct < 5.0, F.lit("strong"))
        .when(pct <= 10.0, F.lit("normal"))
        .when(pct.isNotNull(), F.lit("needs work"))
    )


def trend_label(delta: Column) -> Column:
    return (
        F.when(delta > 0.0001, F.lit("improving"))
        .when(delta < -0.0001, F.lit("declining"))
        .when(delta.isNotNull(), F.lit("stable"))
    )


def ce_marker(ce: Column, mean_ce: Column) -> Column:
    # equal means summed in another order may differ in the last bit
    return (
        F.when(ce - mean_ce >= -1e-12, F.lit("above"))
        .when(ce >= mean_ce - 0.0015, F.lit("slightly below"))
        .when(ce.isNotNull() & mean_ce.isNotNull(), F.lit("below"))
    )


def versus_label(pct: Column, band: float = 0.5) -> Column:
    return (
        F.when(pct > band, F.lit("better")).when(pct < -band, F.lit("worse")).when(pct.isNotNull(), F.lit("similar"))
    )


def note_flags(ce_pct: Column, drift_pct: Column, te: Column) -> dict[str, Column]:
    no = F.lit(False)
    return {
        "efficiency_above": F.coalesce(ce_pct > 2.0, no),
        "efficiency_below": F.coalesce(ce_pct < -2.0, no),
        "efficiency_in_line": F.coalesce((ce_pct <= 2.0) & (ce_pct >= -2.0), no),
        "low_drift": F.coalesce(drift_pct < 3.0, no),
        "high_drift": F.coalesce(drift_pct > 10.0, no),
        "te_high": F.coalesce(te >= 4.0, no),
        "te_low": F.coalesce(te < 2.0, no),
    }


def outlook(similar_mean: Column, overall_mean: Column) -> Column:
    diff = similar_mean - overall_mean
    return (
        F.when(diff > 0.0005, F.lit("better")).when(diff < -0.0005, F.lit("worse")).when(diff.isNotNull(), F.lit("typical"))
    )


def recommendation(score: Column, days_off: Column) -> Column:
    """Code for the (score, days off) matrix."""
    return (
        F.when((score >= 7.0) & (days_off >= 2), F.lit("hard_or_long"))
        .when(score >= 7.0, F.lit("steady"))
        .when((score >= 4.0) & (days_off >= 1), F.lit("easy_to_moderate"))
        .when(score >= 4.0, F.lit("easy"))
        .when(score.isNotNull() & (days_off == 0), F.lit("rest_tomorrow"))
        .when(score.isNotNull(), F.lit("rest_or_short_easy"))
    )


# ------------------------------------------------------------------------ text
def type_in(types: Sequence[str], c: Column | str = "activity_type") -> Column:
    return col_of(c).isin(list(types))


def json_is(raw: Column | str, path: str, value: str) -> Column:
    """True when the JSON text has ``value`` at ``path``; false when malformed or absent."""
    return F.coalesce(F.get_json_object(col_of(raw), path) == value, F.lit(False))


def json_malformed(raw: Column | str) -> Column:
    return F.try_parse_json(F.coalesce(col_of(raw), F.lit(""))).isNull()


def ellipsis(c: Column | str, n: int) -> Column:
    """Cut to n code points, the last being an ellipsis when something was cut."""
    c = col_of(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def strip_prefix(c: Column | str, prefix: str) -> Column:
    c = col_of(c)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def clean_place(c: Column | str) -> Column:
    """Trim quotes; empty text and the word ``null`` become real nulls."""
    trimmed = F.btrim(col_of(c), F.lit('"'))
    return F.when((trimmed != "") & (trimmed != "null"), trimmed)


def geo_key(lat: Column, lon: Column) -> Column:
    """Lookup key: coordinates at three decimals (about 100 m)."""
    return F.format_string("%.3f,%.3f", lat, lon)
