"""Forests against a plain version that grows one tree after the other from rows."""

import datetime as dt
import math
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import forest as M
from pulsegrid.operators import trees as T

SMALL = T.Settings(trees=6, depth=4, min_split=5, seed=11)
FEATS = ["a", "b", "c", "d"]
PRIME = 2**31 - 1


def table(n=160, entities=2, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for e in range(entities):
        for i in range(n):
            a, b, c, d = float(rng.integers(0, 12)), float(rng.normal()), float(i % 7), float(rng.normal())
            out.append((e, dt.date(2024, 1, 1) + dt.timedelta(days=i), a, b, c, d, 3 * a + (5 if b > 0 else 0) + float(rng.normal())))
    return out


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "p int, date date, a double, b double, c double, d double, y double")
    return df.repartition(parts)


def number(row):
    return row[0] * 40_000 + (row[1] - dt.date(1970, 1, 1)).days


def row_number():
    return F.col("p") * 40_000 + F.datediff("date", F.lit("1970-01-01"))


def draw(seed, a, b, c=0):
    a, b, c = a % PRIME, b % PRIME, c % PRIME
    x = (a * 48271 + b * 69621 + c * 16807 + seed) % PRIME
    for extra in (a, b, c, seed):
        x = (x * x + extra) % PRIME
    return x


def count(u):
    total, k = 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        if u < total:
            return k
        k += 1


def plain_tree(rows, tree, settings, thresholds, node=1, level=0):
    """A dict of node -> value or (feature, threshold)."""
    n, s = sum(w for _, w, _ in rows), sum(w * q for _, w, q in rows)
    if n >= settings.min_split and level < settings.depth:
        tried = sorted(sorted(range(len(FEATS)), key=lambda f: (draw(settings.seed + 1, tree, node, f), f))[: math.isqrt(len(FEATS))])
        best = None
        for f in tried:
            for v in thresholds[f]:
                left = [r for r in rows if r[0][f] <= v]
                ln, ls = sum(w for _, w, _ in left), sum(w * q for _, w, q in left)
                if 0 < ln < n:
                    gain = ls * ls / ln + (s - ls) ** 2 / (n - ln) - s * s / n
                    if best is None or gain > best[0]:
                        best = (gain, f, v)
        if best and best[0] > 1e-9 * max(1.0, s * s / n):
            _, f, v = best
            out = {node: (f, v)}
            out |= plain_tree([r for r in rows if r[0][f] <= v], tree, settings, thresholds, 2 * node, level + 1)
            return out | plain_tree([r for r in rows if r[0][f] > v], tree, settings, thresholds, 2 * node + 1, level + 1)
    return {node: s / n}


def plain_forest(rows, settings, scale):
    x = [r[2:6] for r in rows]
    at = sorted({j * len(rows) // T.BINS for j in range(1, T.BINS)})
    thresholds = [sorted({sorted(c)[i] for i in at}) for c in zip(*x)]
    out = []
    for t in range(settings.trees):
        drawn = [(r[2:6], count(draw(settings.seed, number(r), t) / PRIME), float(round(r[6] * scale))) for r in rows]
        out.append(plain_tree([r for r in drawn if r[1]], t, settings, thresholds))
    return out


def plain_predict(forest, x, scale):
    total = 0.0
    for tree in forest:
        node = 1
        while isinstance(tree[node], tuple):
            f, v = tree[node]
            node = 2 * node + (x[f] > v)
        total += tree[node] / scale
    return total / len(forest)


def scale_of(rows):
    return 2.0**30 / max(abs(r[6]) for r in rows)


@pytest.mark.parametrize("local_rows", [T.LOCAL_ROWS, 40])
def test_fit_equals_the_plain_forest(spark, monkeypatch, local_rows):
    monkeypatch.setattr(T, "LOCAL_ROWS", local_rows)
    rows = table()
    model = T.fit(frame(spark, rows), FEATS, "y", ["p", "date"], SMALL, row_number())
    plain = plain_forest(rows, SMALL, scale_of(rows))
    nodes = model.nodes.collect()
    assert len(nodes) == sum(map(len, plain)) and len({(r.tree, r.node) for r in nodes}) == len(nodes)
    for r in nodes:
        want = plain[r.tree][r.node]
        assert (r.feature, r.threshold) == want if isinstance(want, tuple) else r.feature == -1 and abs(r.value - want / scale_of(rows)) < 1e-9
    fresh = table(seed=9)
    got = {(r.p, r.date): r.prediction for r in model.predict(frame(spark, fresh)).collect()}
    assert len(got) == len(fresh)
    assert all(abs(got[r[0], r[1]] - plain_predict(plain, r[2:6], scale_of(rows))) < 1e-9 for r in fresh)


def test_same_forest_however_rows_are_dealt(spark):
    rows = table(80)
    one = T.fit(frame(spark, rows, 1), FEATS, "y", ["p", "date"], SMALL, row_number()).nodes
    two = T.fit(frame(spark, rows[::-1], 7), FEATS, "y", ["p", "date"], SMALL, row_number()).nodes
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(one) == key(two)
    assert key(one) != key(T.fit(frame(spark, rows), FEATS, "y", ["p", "date"], T.Settings(6, 4, 5, 12), row_number()).nodes)


@pytest.mark.parametrize("local_rows", [T.LOCAL_ROWS, 120])
def test_cross_validation_equals_a_plain_loop_of_fits(spark, monkeypatch, local_rows):
    monkeypatch.setattr(T, "LOCAL_ROWS", local_rows)
    rows = table(75)
    got = M.time_series_cv(frame(spark, rows), FEATS, "y", ["p"], start=40, step=10, settings=SMALL, row=row_number()).collect()
    assert len(got) == 2 * 30 and {r.fold for r in got} == {0, 1, 2}
    values = {(r[0], r[1]): r for r in rows}
    for f in range(3):
        first = dt.date(2024, 1, 1) + dt.timedelta(days=40 + 10 * f)
        forest = plain_forest([r for r in rows if r[1] < first], SMALL, scale_of(rows))
        part = [r for r in got if r.fold == f]
        assert {r.date for r in part} == {first + dt.timedelta(days=i) for i in range(10)} and {r.trained_until for r in part} == {first - dt.timedelta(days=1)}
        assert all(abs(r.prediction - plain_predict(forest, values[r.p, r.date][2:6], scale_of(rows))) < 1e-9 for r in part)


def test_jobs_do_not_grow_with_folds(spark):
    rows, sc = table(75), spark.sparkContext

    def jobs(step):
        sc.setJobGroup(f"cv-{step}", "count jobs")
        M.time_series_cv(frame(spark, rows), FEATS, "y", ["p"], start=30, step=step, settings=T.Settings(2, 2), row=row_number())
        n = len(sc.statusTracker().getJobIdsForGroup(f"cv-{step}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return n

    few, many = jobs(20), jobs(1)
    assert few == many > 0


def test_baselines_share_rows_and_folds(spark):
    rows = [r for r in table(75) if r[0] == 0 or r[1] >= dt.date(2024, 2, 25)]  # the second entity begins inside a fold
    df = frame(spark, rows).withColumn("src", F.col("y") + 1)
    got = {(r.p, r.date): r for r in M.cv_baselines(df, "y", "src", ["p"], start=40, step=10).collect()}
    cv = {(r.p, r.date): r.fold for r in M.time_series_cv(df, FEATS, "y", ["p"], start=40, step=10, settings=T.Settings(2, 2), row=row_number()).collect()}
    assert {k: r.fold for k, r in got.items()} == cv
    for (p, d), r in got.items():
        first = dt.date(2024, 1, 1) + dt.timedelta(days=40 + 10 * r.fold)
        own = [x[6] for x in rows if x[0] == p and x[1] < first] or [x[6] for x in rows if x[1] < first]
        assert abs(r.mean_pred - mean(own)) < 1e-9 and r.persistence_pred == r.src


def test_importance_equals_a_plain_shuffle(spark):
    rows = table(60)
    model = T.fit(frame(spark, rows), FEATS, "y", ["p", "date"], SMALL, row_number())
    tail = M.importance_tail(frame(spark, rows), ["p"])
    got = M.permutation_importance(model, tail, "y", ["p"], order=(F.datediff("date", F.lit("1970-01-01")) * 7919) % 101).collect()
    plain, scale = plain_forest(rows, SMALL, scale_of(rows)), scale_of(rows)
    picked = [[r for r in rows if r[0] == p][48:] for p in (0, 1)]
    other = [sorted(part, key=lambda r: (((r[1] - dt.date(1970, 1, 1)).days * 7919) % 101, r[1])) for part in picked]
    error = lambda change: mean(abs(r[6] - plain_predict(plain, change(r[2:6], o[2:6]), scale)) for part, order in zip(picked, other) for r, o in zip(part, order))
    base = error(lambda x, o: x)
    want = {f: error(lambda x, o, i=i: (*x[:i], o[i], *x[i + 1 :])) - base for i, f in enumerate(FEATS)}
    assert {r.feature: pytest.approx(r.importance, abs=1e-9) for r in got} == want
    assert [r.feature for r in got] == sorted(want, key=lambda f: (-want[f], f)) and got[0].feature == "a"


def test_repeated_rows_constant_targets_and_no_rows(spark):
    rows = [(0, dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 2.0)] * 20
    model = T.fit(frame(spark, rows), FEATS, "y", ["p", "date"], SMALL, row_number())
    assert {(r.node, r.feature) for r in model.nodes.collect()} == {(1, -1)}
    out = model.predict(frame(spark, rows)).collect()
    assert len(out) == 20 and {round(r.prediction, 9) for r in out} == {2.0}
    assert model.predict(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        T.fit(frame(spark, []), FEATS, "y", ["p", "date"], SMALL, row_number())
