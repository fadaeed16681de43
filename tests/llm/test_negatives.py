import numpy as np
import pytest

from pulsegrid.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<double>, label int, g int, kind string, a string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], y, 7, "k", "a") for i, v, y in rows], SCHEMA)


def brute(rows, positives=5, negatives=10, low=30, high=90, scale=256, every=100):
    ok = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(c is None or not np.isfinite(c) or not np.isfinite(scale * float(c)) for c in v):
            continue
        ok.append((i, tuple(int(np.floor(scale * float(c))) for c in v), y))
    ok = sorted(set(ok))
    out = []
    for a in ok:
        if a[0] % every:
            continue
        score = {r: sum(p * q for p, q in zip(a[1], r[1])) for r in ok if r[0] != a[0] and len(r[1]) == len(a[1])}
        best = sorted((-s, r[0]) for r, s in score.items() if r[2] == a[2])[:positives]
        for s, p in best:
            p_score = -s
            fits = sorted((-s, r[0]) for r, s in score.items() if r[2] != a[2] and low * p_score <= 100 * s <= high * p_score)[:negatives]
            out += [(a[0], p, k, m, p_score, -s) for k, (s, m) in enumerate(fits, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.normal(size=(labels, dim // 4)), 4, axis=1)
    return [(i, (centres[(i * 7) % labels] * rng.uniform(0, 1.5) + rng.normal(size=dim) * 0.3).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("group_bytes", [N.GROUP_BYTES, 20_000])
def test_equals_brute_force(spark, group_bytes):
    rows = clustered(900, 16, 3)
    assert got(N.mine(table(spark, rows), group_bytes=group_bytes)) == brute(rows)


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(5)
    x, y = np.floor(rng.normal(size=(40, 19)) * 50), np.floor(rng.normal(size=(9, 19)) * 50)
    rows, own = N.Summaries(x), N.Summaries(y)
    exact, width = y @ x.T, []
    for level in range(len(rows.levels)):
        low, high = rows.bounds(level, np.arange(40), own)
        assert (low <= exact).all() and (exact <= high).all()
        width.append((high - low).mean())
    assert len(width) == 3 and width[0] > width[1] > width[2]


def test_smooth_vectors_are_mostly_skipped():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(3000, 16)), 4, axis=1) * 100 + rng.normal(size=(3000, 64))
    shelf = N.Shelf(np.arange(3000), np.zeros(3000, np.int64), np.floor(x))
    scored = []
    best = N.Best(5)
    wanted = lambda rows, low, high: np.ones((1, len(rows)), bool) if high is None else high >= (best.floor if best.floor is not None else 150_000.0)
    shelf.scored(np.floor(x[:1]), wanted, lambda i, rows, s: (scored.append(len(rows)), best.add(s, shelf.ids[rows])))
    assert best.ids[0] == 0 and sum(scored) < 1500


def test_ties_copies_and_one_hot_label(spark):
    rows = [(i, [1.0, 0.5], 1) for i in range(0, 300)] + [(1000 + i, [0.5, 0.25 * (i % 3)], i % 5) for i in range(200)]
    assert got(N.mine(table(spark, rows + rows[:150]), group_bytes=2_000)) == brute(rows)


def test_unusable_rows_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, None], 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, None, 2)]
    rows += [(7, [0.5, 0.1], None), (None, [0.5, 0.2], 2), (8, [0.5], 2), (9, [0.5, 0.0, 0.0], 2), (100, [], 1), (101, [], 1), (102, [], 2), (10, [1e307, 0.0], 2), (200, [-1.0, 0.0], 1)]
    want = brute(rows)
    assert (0, 1, 1, 2, 65536, 32768) in want and (100, 101, 1, 102, 0, 0) in want
    assert got(N.mine(table(spark, rows))) == want


def test_wide_components_stay_exact(spark):
    big = float(2**30)
    rows = [(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big, 0.5], 1), (3, [big * 0.75, 3.0], 2), (4, [big * 0.75, 2.0], 2), (5, [big * 0.75, 2.5], 2)]
    want = brute(rows, scale=1)
    assert [r[3] for r in want if r[1] == 1] == [3, 4, 5] and got(N.mine(table(spark, rows), scale=1)) == want


def test_scores_beyond_64_bits_do_not_fail(spark):
    rows = [(0, [1e200], 1), (1, [1e200], 1), (2, [5e199], 2), (3, [-5e199], 2)]
    out = got(N.mine(table(spark, rows)))
    assert all(r[4] == 2**63 - 1 for r in out)


def test_one_id_with_two_rows_and_negative_ids(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 2.0], 2), (-100, [2.0, 1.0], 2), (5, [1.0, 1.5], 1), (6, [1.0, 0.5], 2), (-7, [0.5, 0.5], 3)]
    assert got(N.mine(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert N.mine(table(spark, [])).collect() == []
