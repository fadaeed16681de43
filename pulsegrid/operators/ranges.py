"""Interval joins: features of the days before an anchor date.

An anchor (race, run, assessment) asks for aggregates over ``[D−k, D−1]`` for
several k at once. Rows are first reduced to one partial record per entity and
day. Anchors and days then meet in an equi-join on a day block as wide as the
longest window, so each anchor is copied at most twice and a (entity, block)
group holds at most one block of days. One aggregation yields all windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_number


@dataclass(frozen=True)
class Range:
    """One feature: ``agg`` of ``col`` over the days D−``far`` … D−``near``.

    agg: sum, mean, max, count (rows), share_above (threshold in ``arg``),
    share_in (list in ``arg``), last (latest non-null; same-day ties resolved by
    the ``order`` columns of the call).
    """

    name: str
    agg: str
    col: str | None
    far: int
    near: int = 1
    arg: object = field(default=None, hash=False)


def _partials(spec: Range, order: Sequence[str]) -> dict[str, Column]:
    """Day-level partial aggregates a feature is rebuilt from."""
    c = None if spec.col is None else F.col(spec.col)
    tag = spec.col
    if spec.agg == "sum":
        return {f"s_{tag}": F.sum(c.cast("double"))}
    if spec.agg == "mean":
        return {f"s_{tag}": F.sum(c.cast("double")), f"n_{tag}": F.count(c)}
    if spec.agg == "max":
        return {f"m_{tag}": F.max(c.cast("double"))}
    if spec.agg == "count":
        return {"rows": F.count(F.lit(1))}
    if spec.agg == "share_above":
        hit = (c.cast("double") > spec.arg).cast("long")
        return {f"a_{tag}_{spec.arg}": F.sum(hit), f"n_{tag}": F.count(c)}
    if spec.agg == "share_in":
        hit = c.isin(list(spec.arg)).cast("long")
        return {f"i_{tag}_{'_'.join(spec.arg)}": F.sum(hit), f"n_{tag}": F.count(c)}
    if spec.agg == "last":
        key = F.struct(*[F.col(o) for o in order]) if order else F.lit(1)
        return {f"l_{tag}": F.max_by(c, F.when(c.isNotNull(), key))}
    raise ValueError(f"unknown range aggregate {spec.agg!r}")


def _rebuild(spec: Range, back: Column, source: str) -> Column:
    inside = (back <= spec.far) & (back >= spec.near)
    tag = spec.col

    def total(name: str) -> Column:
        return F.sum(F.when(inside, F.col(f"`{source}{name}`")))

    if spec.agg == "sum":
        return F.coalesce(total(f"s_{tag}"), F.lit(0.0))
    if spec.agg == "mean":
        return F.try_divide(total(f"s_{tag}"), total(f"n_{tag}"))
    if spec.agg == "max":
        return F.max(F.when(inside, F.col(f"`{source}m_{tag}`")))
    if spec.agg == "count":
        return F.coalesce(total("rows"), F.lit(0))
    if spec.agg == "share_above":
        return F.try_divide(total(f"a_{tag}_{spec.arg}").cast("double"), total(f"n_{tag}"))
    if spec.agg == "share_in":
        return F.try_divide(total(f"i_{tag}_{'_'.join(spec.arg)}").cast("double"), total(f"n_{tag}"))
    value = F.col(f"`{source}l_{tag}`")
    return F.max_by(value, F.when(inside & value.isNotNull(), F.col("_day")))


Source = tuple[DataFrame, Sequence[Range], Sequence[str]]


def _days(rows: DataFrame, by: list[str], specs: Sequence[Range], d: str, order: Sequence[str], tag: str) -> DataFrame:
    """One partial record per entity and day of one source; its columns begin with ``tag``."""
    partials: dict[str, Column] = {}
    for s in specs:
        partials.update(_partials(s, order))
    return (
        rows.groupBy(*by, F.col(d).alias("_d"))
        .agg(*[expr.alias(f"{tag}{name}") for name, expr in partials.items()])
        .withColumn("_day", day_number("_d"))
        .drop("_d")
    )


def range_features_from(anchors: DataFrame, sources: Sequence[Source], by: Sequence[str], d: str = "date") -> DataFrame:
    """Add the features of several (rows, specs, order) sources to ``anchors``.

    Every source is reduced to a record per entity and day, and the records of all sources lie in one
    frame; so however many sources there are, anchors meet it in one join on (entity, block of
    days), one aggregation yields all windows, and one join brings them back. Missing days give null
    (0 for sum and count).
    """
    by = list(by)
    every = [(f"{i}_", rows, specs, order) for i, (rows, specs, order) in enumerate(sources)]
    flat = [(tag, s) for tag, _, specs, _ in every for s in specs]
    if not flat:
        return anchors
    width, nearest = max(s.far for _, s in flat), min(s.near for _, s in flat)
    days = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_days(rows, by, specs, d, order, tag) for tag, rows, specs, order in every])
    days = days.withColumn("_slot", F.floor(F.col("_day") / width))
    asked = anchors.select(*by, F.col(d).alias("_anchor"), day_number(d).alias("_at")).distinct()
    first, last = F.floor((F.col("_at") - width) / width), F.floor((F.col("_at") - nearest) / width)
    back = F.col("_at") - F.col("_day")
    found = (
        asked.withColumn("_slot", F.explode(F.sequence(first, last)))
        .join(days, [*by, "_slot"])
        .where((back <= width) & (back >= nearest))
        .groupBy(*by, F.col("_anchor").alias(d))
        .agg(*[_rebuild(s, back, tag).alias(s.name) for tag, s in flat])
    )
    empty = {s.name: (0.0 if s.agg == "sum" else 0) for _, s in flat if s.agg in ("sum", "count")}
    out = anchors.join(found, [*by, d], "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(zero)) for name, zero in empty.items()}) if empty else out


def range_features(
    anchors: DataFrame,
    rows: DataFrame,
    by: Sequence[str],
    specs: Sequence[Range],
    d: str = "date",
    order: Sequence[str] = (),
) -> DataFrame:
    """Add one column per spec to ``anchors``, from a single source."""
    return range_features_from(anchors, [(rows, specs, order)], by, d)


def asof_last(
    anchors: DataFrame,
    rows: DataFrame,
    by: Sequence[str],
    col: str,
    max_days: int = 30,
    include_same_day: bool = False,
    d: str = "date",
    order: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """Latest non-null ``col`` of the ``max_days`` before each anchor date."""
    spec = Range(name or col, "last", col, max_days, 0 if include_same_day else 1)
    return range_features(anchors, rows, by, [spec], d, order)


def similar_runs(
    runs: DataFrame,
    anchors: DataFrame,
    by: Sequence[str],
    days: int = 90,
    tolerance: float = 0.20,
    run_id: str = "activity_id",
) -> DataFrame:
    """Runs of the ``days`` before each entity's anchor run with a similar distance.

    ``anchors`` holds one run per entity (``by``, run id, date, distance_km), so
    the join adds no pairs beyond one row per run; a hot entity is split by
    adaptive skew handling because only the run side is large.
    """
    a = anchors.select(
        *by,
        F.col(run_id).alias("_id"),
        F.col("date").alias("_date"),
        F.col("distance_km").alias("_km"),
    )
    return (
        runs.join(a, list(by))
        .where(
            (F.col("date") > F.date_sub("_date", days))
            & (F.col(run_id) != F.col("_id"))
            & (F.col("distance_km") >= F.col("_km") * (1.0 - tolerance))
            & (F.col("distance_km") <= F.col("_km") * (1.0 + tolerance))
        )
        .drop("_id", "_date", "_km")
    )


def similar_days(history: DataFrame, today: DataFrame, by: Sequence[str], band: float = 0.5) -> DataFrame:
    """Historical rows whose mean z lies within ``band`` of the entity's z today.

    ``today`` has one row per entity (``by``, ``today_z``).
    """
    return history.join(today.select(*by, "today_z"), list(by)).where(
        F.abs(F.col("mean_z") - F.col("today_z")) < band
    )
