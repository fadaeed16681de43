"""Spatial matching and route detection on a grid.

Start points fall into cells at least ``radius`` high and wide (column count
depends on the latitude row, so cells stay wide enough near the poles and wrap
at the date line) and into logarithmic distance bands as wide as the tolerance.
Whatever matches lies in one of the 27 neighbouring cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_M, haversine
from ..session import durable

START_RADIUS_M = 200.0
DISTANCE_TOLERANCE = 0.10


class Grid:
    """Cell arithmetic for one radius and distance tolerance."""

    def __init__(self, radius_m: float = START_RADIUS_M, tolerance: float = DISTANCE_TOLERANCE):
        self.radius_m = radius_m
        self.tolerance = tolerance
        self.lat_step = math.degrees(radius_m / EARTH_RADIUS_M) * 1.01
        self.band_width = -math.log(1.0 - tolerance) * 1.01

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.lat_step)

    def columns_in(self, row: Column) -> Column:
        """Number of equal cells around the globe in a latitude row."""
        edge = F.greatest(F.abs((row - 1) * self.lat_step - 90.0), F.abs((row + 2) * self.lat_step - 90.0))
        width = self.lat_step / F.greatest(F.cos(F.radians(F.least(edge, F.lit(89.99)))), F.lit(1e-6))
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))

    def col(self, lon: Column, row: Column) -> Column:
        n = self.columns_in(row)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n), n)

    def band(self, km: Column) -> Column:
        return F.floor(F.log(km) / self.band_width)

    def place(self, df: DataFrame, lat: str, lon: str, km: str) -> DataFrame:
        """Add the row's own cell."""
        return (
            df.withColumn("_r", self.row(F.col(lat)))
            .withColumn("_c", self.col(F.col(lon), F.col("_r")))
            .withColumn("_b", self.band(F.col(km)))
        )

    def neighbours(self, df: DataFrame, lat: str, lon: str, km: str) -> DataFrame:
        """Copy each row into the (at most 27) cells that can hold a match."""
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        rows = df.select("*", F.explode(F.transform(around, lambda k: self.row(F.col(lat)) + k)).alias("_r"))
        cols = F.transform(around, lambda k: F.pmod(F.col("_c0") + k, F.col("_n")))
        return (
            rows.withColumn("_n", self.columns_in(F.col("_r")))
            .withColumn("_c0", F.floor((F.col(lon) + 180.0) / 360.0 * F.col("_n")))
            .withColumn("_b0", self.band(F.col(km)))
            .withColumn("_c", F.explode(F.array_distinct(cols)))
            .withColumn("_b", F.explode(F.transform(around, lambda k: F.col("_b0") + k)))
            .drop("_n", "_c0", "_b0")
        )

    def matches(self, lat: Column, lon: Column, km: Column, lat0: Column, lon0: Column, km0: Column) -> Column:
        """Within the radius of, and within the tolerance relative to, the reference run."""
        return (haversine(lat, lon, lat0, lon0) <= self.radius_m) & (F.abs(km - km0) / km0 <= self.tolerance)


CELL = ["_r", "_c", "_b"]


def near_reference(
    df: DataFrame, references: DataFrame, by: Sequence[str], grid: Grid | None = None, ref_id: str = "route_id"
) -> DataFrame:
    """Rows with the references they match.

    Both sides carry ``start_lat, start_lon, distance_km``; references are route
    leaders, of which a cell holds only a few, so this never emits the pairs of a
    crowded start point.
    """
    grid = grid or Grid()
    refs = grid.neighbours(
        references.select(
            *by,
            ref_id,
            F.col("start_lat").alias("_lat0"),
            F.col("start_lon").alias("_lon0"),
            F.col("distance_km").alias("_km0"),
        ),
        "_lat0",
        "_lon0",
        "_km0",
    )
    here = grid.place(df, "start_lat", "start_lon", "distance_km")
    return (
        here.join(refs, [*by, *CELL])
        .where(
            grid.matches(
                F.col("start_lat"), F.col("start_lon"), F.col("distance_km"), F.col("_lat0"), F.col("_lon0"), F.col("_km0")
            )
        )
        .drop(*CELL, "_lat0", "_lon0", "_km0")
    )


def route_leaders(runs: DataFrame, by: Sequence[str], order: Sequence[str], grid: Grid | None = None) -> DataFrame:
    """The runs that open a new route when runs are taken in ``order``.

    A run opens a route when no earlier leader matches it. Taken literally that is
    one sequential scan per entity; here it runs in rounds. In each round the
    earliest undecided run of every neighbourhood is certain to be a leader, since
    nothing undecided before it can match it; the runs it absorbs are then
    decided too. Each round moves one record per occupied cell; the undecided
    remainder shrinks from round to round and is written to the shared folder, so
    a lost executor costs one round. All entities share the rounds. There are as many as the
    longest chain of neighbouring cells whose first runs get ever earlier, plus the
    routes that start in one neighbourhood: few for starts that repeat, at worst the
    number of cells in a line for starts that move steadily through space.
    """
    grid = grid or Grid()
    by, order = list(by), list(order)
    usable = F.col("start_lat").isNotNull() & F.col("start_lon").isNotNull() & (F.col("distance_km") > 0)
    points = runs.where(usable).select(*by, *order, "start_lat", "start_lon", "distance_km")
    undecided = durable(grid.place(points, "start_lat", "start_lon", "distance_km"))
    leaders = [undecided.select(*points.columns).limit(0)]
    while not undecided.isEmpty():
        opened, undecided = _round(undecided, by, order, grid)
        leaders.append(opened.select(*points.columns))
    return reduce(lambda a, b: a.unionByName(b), leaders)


def _round(undecided: DataFrame, by: list[str], order: list[str], grid: Grid) -> tuple[DataFrame, DataFrame]:
    """New leaders, and the runs that are still undecided after them."""
    first = F.struct(*order, "start_lat", "start_lon", "distance_km")
    earliest = undecided.groupBy(*by, *CELL).agg(F.min(first).alias("_e"))
    at = earliest.select(
        *by, "_e", F.col("_e.start_lat").alias("_la"), F.col("_e.start_lon").alias("_lo"), F.col("_e.distance_km").alias("_km")
    )
    probes = grid.neighbours(at, "_la", "_lo", "_km").select(*by, *CELL, F.col("_e").alias("_own"))
    opened = durable(
        probes.join(earliest, [*by, *CELL])
        .groupBy(*by, "_own")
        .agg(F.min("_e").alias("_best"))
        .where(F.col("_own") == F.col("_best"))
        .select(*by, "_own.*")
    )
    lead = opened.select(
        *by,
        F.struct(*order).alias("_at"),
        F.col("start_lat").alias("_lat0"),
        F.col("start_lon").alias("_lon0"),
        F.col("distance_km").alias("_km0"),
    )
    reach = grid.neighbours(lead, "_lat0", "_lon0", "_km0").withColumnsRenamed({c: f"r{c}" for c in [*by, *CELL]})
    absorbed = grid.matches(
        F.col("start_lat"), F.col("start_lon"), F.col("distance_km"), F.col("_lat0"), F.col("_lon0"), F.col("_km0")
    ) & (F.struct(*order) >= F.col("_at"))
    for c in [*by, *CELL]:
        absorbed = (F.col(c) == F.col(f"r{c}")) & absorbed
    return opened, durable(undecided.join(reach, absorbed, "left_anti"))


def leader_routes(
    runs: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    run_id: str = "activity_id",
    grid: Grid | None = None,
) -> DataFrame:
    """Assign each run to the earliest route leader it matches (``route_id`` = the leader's run id).

    ``order`` must end in ``run_id`` so that it is total. The leader's start point
    and distance stay those of its first run.
    """
    grid = grid or Grid()
    by, order = list(by), list(order)
    leaders = route_leaders(runs, by, order, grid).withColumn("_lead", F.struct(*order)).drop(*order)
    matched = near_reference(runs, leaders, by, grid, "_lead").where(F.struct(*order) >= F.col("_lead"))
    assigned = matched.groupBy(*by, run_id).agg(F.min("_lead").alias("_lead"))
    return runs.join(assigned.select(*by, run_id, F.col(f"_lead.{run_id}").alias("route_id")), [*by, run_id])
