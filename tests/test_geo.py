import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.geo import Grid, leader_routes, near_reference

DDL = "e INT, activity_id INT, start_lat DOUBLE, start_lon DOUBLE, distance_km DOUBLE"


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


def sequential(rows):
    """The definition: first matching route wins, routes are frozen at their first run."""
    out = {}
    for e in {r[0] for r in rows}:
        lead = []
        for _, i, la, lo, km in sorted((r for r in rows if r[0] == e), key=lambda r: r[1]):
            for j, la0, lo0, km0 in lead:
                if metres(la, lo, la0, lo0) <= 200 and abs(km - km0) / km0 <= 0.1:
                    out[e, i] = j
                    break
            else:
                lead.append((i, la, lo, km))
                out[e, i] = i
    return out


def crowd(seed, n, lat, lon):
    rng = random.Random(seed)
    k = math.cos(math.radians(lat))
    # entity 1 holds most rows, many of them at one crowded start
    return [
        (1 if rng.random() < 0.7 else 2, i, lat + rng.choice([0, 0, 0.0012, 0.0024]) + rng.gauss(0, 0.0005), (lon + rng.gauss(0, 0.0008) / k + 180) % 360 - 180, rng.choice([5, 5.3, 5.6, 8, 10]) * rng.uniform(0.96, 1.04))
        for i in range(n)
    ]


@pytest.mark.parametrize("lat, lon", [(40.0, -75.0), (69.6, 180.0), (-89.99, 10.0), (0.0, 0.0)])
def test_routes_equal_the_sequential_scan(spark, lat, lon):
    rows = crowd(int(lat), 150, lat, lon)
    df = spark.createDataFrame(rows, DDL).repartition(6)
    got = {(r.e, r.activity_id): r.route_id for r in leader_routes(df, ["e"], ["activity_id"]).collect()}
    assert got == sequential(rows)


def test_chain_where_the_last_matches_only_the_middle(spark):
    # A and B are 150 m apart and share a route; C is 150 m beyond B, out of A's reach
    step = math.degrees(150 / 6_371_000)
    rows = [(1, 1, 10.0, 5.0, 8.0), (1, 2, 10.0 + step, 5.0, 8.0), (1, 3, 10.0 + 2 * step, 5.0, 8.0), (1, 4, 10.0 + step, 5.0, 8.0)]
    df = spark.createDataFrame(rows, DDL)
    got = {r.activity_id: r.route_id for r in leader_routes(df, ["e"], ["activity_id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_radius_and_tolerance_bounds(spark):
    up = lambda m: 10.0 + math.degrees(m / 6_371_000)
    rows = [(1, 1, 10.0, 5.0, 10.0), (1, 2, up(199), 5.0, 10.0), (1, 3, up(201), 5.0, 10.0), (1, 4, 10.0, 5.0, 11.0), (1, 5, 10.0, 5.0, 11.01), (1, 6, 10.0, 5.0, 8.99)]
    df = spark.createDataFrame(rows, DDL)
    refs = df.where("activity_id = 1").withColumnRenamed("activity_id", "route_id")
    assert sorted(r.activity_id for r in near_reference(df, refs, ["e"]).collect()) == [1, 2, 4]


def test_missing_starts_are_left_out(spark):
    rows = [(1, 1, None, 5.0, 10.0), (1, 2, 10.0, 5.0, 10.0), (1, 3, 10.0, None, 10.0)]
    df = spark.createDataFrame(rows, DDL)
    assert [r.activity_id for r in leader_routes(df, ["e"], ["activity_id"]).collect()] == [2]
    assert leader_routes(df.limit(0), ["e"], ["activity_id"]).count() == 0


def test_grid_covers_every_match(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        la, lo = rng.uniform(-89, 89), rng.uniform(-180, 180)
        b, m = rng.uniform(0, 2 * math.pi), rng.uniform(0, 200)
        la2 = la + math.degrees(m * math.cos(b) / 6_371_000)
        lo2 = (lo + math.degrees(m * math.sin(b) / 6_371_000) / math.cos(math.radians(la)) + 180) % 360 - 180
        rows.append((i, la, lo, la2, lo2, 10.0, 10.0 * rng.uniform(0.9, 1.1)))
    df = spark.createDataFrame(rows, "i INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, k DOUBLE, k2 DOUBLE")
    grid = Grid()
    cells = grid.neighbours(df.select("i", "a", "b", "k"), "a", "b", "k").select("i", "_r", "_c", "_b")
    own = grid.place(df.select("i", "c", "d", "k2"), "c", "d", "k2")
    assert own.join(cells, ["i", "_r", "_c", "_b"], "left_anti").agg(F.count("*")).first()[0] == 0
