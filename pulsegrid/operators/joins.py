"""Equi, outer, existence and lookup joins of the report pipelines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_place, geo_key

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def small_enough(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether the optimiser's size estimate of ``df`` is within the broadcast limit."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimated size allows it; else leave the join to shuffle."""
    return F.broadcast(df) if small_enough(df, limit) else df


def spine_join(spine: DataFrame, side: DataFrame, keys: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Left join a side table that is unique on ``keys``; the row count stays the spine's."""
    out = spine.join(side, list(keys), "left")
    return out.fillna(fill) if fill else out


def full_join(frames: Sequence[DataFrame], keys: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Full outer join of several frames with coalesced keys."""
    out = reduce(lambda a, b: a.join(b, list(keys), "full"), frames)
    return out.fillna(fill) if fill else out


def semi(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_semi")


def anti(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


def health_on_day(activities: DataFrame, daily: DataFrame, by: Sequence[str], d: str = "date") -> DataFrame:
    """Activities with the health row of their day; activities without one are dropped."""
    return activities.join(daily, [*by, d])


def date_spine(bounds: DataFrame, by: Sequence[str], d: str = "date") -> DataFrame:
    """Every calendar day between each entity's first and last date.

    ``bounds`` has one row per entity with ``first_date`` and ``last_date``.
    """
    return bounds.select(*by, F.explode(F.sequence("first_date", "last_date")).alias(d))


def place_names(
    df: DataFrame, places: DataFrame, lat: str = "start_lat", lon: str = "start_lon", fallback: str = "location_name"
) -> DataFrame:
    """Name of the rounded coordinate, else the row's own location, else ``Unknown``.

    ``places`` is a dimension (``geo_key``, ``place``), unique on its key.
    """
    keyed = df.withColumn("geo_key", geo_key(F.col(lat), F.col(lon)))
    named = keyed.join(broadcast_if_small(places.select("geo_key", "place")), "geo_key", "left")
    return named.withColumn("place", F.coalesce(F.col("place"), clean_place(fallback), F.lit("Unknown"))).drop("geo_key")
