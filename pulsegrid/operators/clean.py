"""Cleaning rules, quality gates and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_week_label
from .windows import keep_last

# Valid range per column (low, high, low end excluded?)
DAILY_RULES = {
    "avg_stress": (0, None, False),
    "max_stress": (0, None, False),
    "resting_hr": (25, 200, False),
    "sleep_seconds": (0, 57600, True),
    "steps": (0, 200_000, False),
    "total_calories": (500, 10_000, False),
    "active_calories": (0, 8_000, False),
}
BATTERY = ("body_battery_start", "body_battery_end")
REQUIRED = ["resting_hr", "sleep_seconds", "steps"]
DIFF_COLUMNS = [
    "resting_hr",
    "sleep_seconds",
    "steps",
    "total_calories",
    "active_calories",
    "avg_stress",
    "max_stress",
    "body_battery_start",
    "body_battery_end",
]


def null_when(c: Column, cond: Column) -> Column:
    """Null where ``cond`` is true; an unknown condition keeps the value."""
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(None)).otherwise(c)


def null_out_of_range(df: DataFrame, rules: dict = DAILY_RULES) -> DataFrame:
    """Apply the range rules whose column exists, in one projection."""
    changed = {}
    for name, (lo, hi, lo_excluded) in rules.items():
        if name not in df.columns:
            continue
        c = F.col(name)
        bad = (c <= lo) if lo_excluded else (c < lo)
        if hi is not None:
            bad = bad | (c > hi)
        changed[name] = null_when(c, bad)
    return df.withColumns(changed) if changed else df


def null_together(df: DataFrame, cols: Sequence[str], lo: float, hi: float) -> DataFrame:
    """If any of the columns is out of range, null all of them."""
    if any(c not in df.columns for c in cols):
        return df
    bad = F.lit(False)
    for name in cols:
        bad = bad | (F.col(name) < lo) | (F.col(name) > hi)
    return df.withColumns({name: null_when(F.col(name), bad) for name in cols})


def drop_no_wear(df: DataFrame) -> DataFrame:
    """Keep days with a resting rate, a sleep duration or at least one step."""
    if any(c not in df.columns for c in REQUIRED):
        return df
    return df.where(F.col("resting_hr").isNotNull() | F.col("sleep_seconds").isNotNull() | (F.col("steps") > 0))


def clean_daily(df: DataFrame, by: Sequence[str], order: Sequence[str], d: str = "date") -> DataFrame:
    """Range rules, coupled battery rule, no-wear filter, then last write per day wins."""
    ranged = null_together(null_out_of_range(df), BATTERY, 0, 100)
    worn = drop_no_wear(ranged)
    return keep_last(worn, [*by, d], order) if d in df.columns else worn


def cleaning_diff(before: DataFrame, after: DataFrame, by: Sequence[str], cols: Sequence[str] = DIFF_COLUMNS) -> DataFrame:
    """Rows before, after and dropped, and remaining nulls per column."""
    present = [c for c in cols if c in after.columns]
    b = before.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_after"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in present],
    )
    filled = b.join(a, list(by), "left").fillna(0)
    return filled.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def filter_dates(df: DataFrame, d: str, frm: object = None, to: object = None) -> DataFrame:
    """Inclusive date range; either bound may be open."""
    if frm is not None:
        df = df.where(F.col(d) >= F.lit(frm).cast("date"))
    if to is not None:
        df = df.where(F.col(d) <= F.lit(to).cast("date"))
    return df


def ingest_range(df: DataFrame, d: str, frm: object, to: object, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows inside [frm, to] with their ISO week, and per-entity counts of what was left out.

    A null date stands for a text that did not parse.
    """
    lo, hi = F.lit(frm).cast("date"), F.lit(to).cast("date")
    inside = F.col(d).between(lo, hi)
    kept = df.where(inside).withColumn("iso_week", iso_week_label(d))
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("considered"),
        F.count_if(F.col(d).isNull()).alias("unparseable"),
        F.count_if(~inside).alias("out_of_range"),
    )
    return kept, counts


def class_contribution(value: Column, types: Sequence[str], activity_type: str = "activity_type") -> Column:
    """The value for rows of the class, 0.0 for others; a null value in the class stays null."""
    return F.when(F.col(activity_type).isin(list(types)), value).otherwise(F.lit(0.0))


def derive_daily(df: DataFrame) -> DataFrame:
    """Double-typed signals plus sleep hours and battery change."""
    doubles = ["resting_hr", "steps", "active_calories", "avg_stress", "hrv_last_night", "avg_spo2", "sleep_score"]
    cols = {c: F.col(c).cast("double") for c in doubles if c in df.columns}
    cols["sleep_hours"] = F.col("sleep_seconds").cast("double") / 3600.0
    cols["body_battery_delta"] = (F.col("body_battery_end") - F.col("body_battery_start")).cast("double")
    return df.withColumns(cols)


def plausible_runs(
    df: DataFrame,
    min_distance_m: float | None = None,
    above_distance_m: float | None = None,
    min_duration_s: float | None = None,
    need_start: bool = False,
) -> DataFrame:
    """Distance (inclusive or strict), duration and GPS-start filters."""
    if min_distance_m is not None:
        df = df.where(F.col("distance_m") >= min_distance_m)
    if above_distance_m is not None:
        df = df.where(F.col("distance_m") > above_distance_m)
    if min_duration_s is not None:
        df = df.where(F.col("duration_sec") >= min_duration_s)
    if need_start:
        df = df.where(F.col("start_lat").isNotNull() & F.col("start_lon").isNotNull())
    return df


def prefer_rows(df: DataFrame, keys: Sequence[str], preferred: Column) -> DataFrame:
    """Preferred rows of each key; all rows where a key has none."""
    flagged = df.withColumn("_pref", F.coalesce(preferred, F.lit(False)))
    has = flagged.where("_pref").select(*keys).distinct()
    chosen = flagged.where("_pref")
    rest = flagged.join(has, list(keys), "left_anti")
    return chosen.unionByName(rest).drop("_pref")


def null_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: row count and null count per column (a missing column counts as all null)."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("rows"),
        *[(F.count_if(F.col(c).isNull()) if c in df.columns else n).alias(c) for c in cols],
    )


def prune_sparse(df: DataFrame, cols: Sequence[str], max_null: float = 0.30) -> list[str]:
    """Columns whose null rate is at most ``max_null``. Runs one aggregate job."""
    row = null_rates(df, cols).first()
    if row["rows"] == 0:
        return list(cols)
    return [c for c in cols if row[c] / row["rows"] <= max_null]


def quality_gate(
    df: DataFrame,
    by: Sequence[str],
    min_rows: int = 60,
    required: Sequence[str] = REQUIRED,
    max_null: float = 0.30,
) -> DataFrame:
    """One row per entity and check: (entity, check, value, ok)."""
    n = F.count(F.lit(1))
    rates = {c: (F.avg(F.col(c).isNull().cast("double")) if c in df.columns else F.lit(1.0)) for c in required}
    wide = df.groupBy(*by).agg(n.cast("double").alias("rows"), *[r.alias(c) for c, r in rates.items()])
    checks = [F.struct(F.lit("rows").alias("check"), F.col("rows").alias("value"), (F.col("rows") >= min_rows).alias("ok"))]
    checks += [
        F.struct(F.lit(f"null_rate:{c}").alias("check"), F.col(c).alias("value"), (F.col(c) <= max_null).alias("ok"))
        for c in required
    ]
    return wide.select(*by, F.inline(F.array(*checks)))


class QualityError(ValueError):
    """Raised when training data does not pass the quality gate."""


def require_quality(df: DataFrame, by: Sequence[str], **limits) -> DataFrame:
    """Keep the entities that pass every check; raise when none does."""
    checks = quality_gate(df, by, **limits)
    good = checks.groupBy(*by).agg(F.every("ok").alias("_ok")).where("_ok").select(*by)
    out = df.join(good, list(by), "left_semi")
    if out.isEmpty():
        raise QualityError("no entity has enough rows with acceptable null rates")
    return out
