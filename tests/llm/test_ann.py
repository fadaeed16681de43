import numpy as np

from pulsegrid.llm import ann as A

SCHEMA = "vec_id bigint, embedding array<float>, c int, ids string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in vectors], SCHEMA)


def exact(vectors, k=5):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i is not None and v is not None and len(v) and None not in v}
    ok = {i: v for i, v in ok.items() if np.isfinite(v).all() and v.any()}
    out = {}
    for q in ok:
        if q % 50 == 0:
            near = [(-float(ok[q] @ v / np.linalg.norm(ok[q]) / np.linalg.norm(v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
            out[q] = [i for _, i in sorted((round(s, 9), i) for s, i in near)[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    return {q: [n[i] for i in sorted(n)] for q, n in out.items()}


def clustered(n=1200, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    return [(i, centres[i % 10] * 0.6 + rng.normal(size=dim)) for i in range(n)]


def test_recall_against_brute_force(spark):
    vectors = clustered()
    want, got = exact(vectors), found(A.nearest(table(spark, vectors)))
    hits = sum(len(set(want[q]) & set(got.get(q, []))) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_copies_ties_and_unusable_vectors(spark):
    base = [1.0, 2.0, 0.0]
    vectors = [(i, base) for i in range(0, 240, 2)] + [(301, [2.0, 4.0, 0.0]), (303, [0.0, 0.0, 1.0]), (305, [0.0, 0.0, 0.0])]
    vectors += [(307, None), (309, [1.0, None, 2.0]), (311, [float("nan"), 1, 1]), (313, [float("inf"), 1, 1]), (None, base), (0, base), (315, [])]
    got = found(A.nearest(table(spark, vectors), group_rows=1))
    assert got[0][:5] == [2, 4, 6, 8, 10]
    assert got[50] == [0, 2, 4, 6, 8] and got[200] == [0, 2, 4, 6, 8]
    assert set(got) == {0, 50, 100, 150, 200}


def test_lengths_never_meet_and_few_candidates(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.1])]
    got = found(A.nearest(table(spark, vectors), width=8.0))
    assert got == {0: [1], 50: [2]}


def test_empty_table(spark):
    assert A.nearest(table(spark, [])).collect() == []


def test_perturbations_are_ordered_and_use_one_edge_per_cell():
    sets = A.perturbations(6, 50).astype(int)
    assert len(sets) == 50 and sets[0].sum() == 0 and sets[1].tolist() == [1] + [0] * 11
    assert (sets[:, :6] + sets[:, :5:-1] <= 1).all()
    assert len({tuple(s) for s in sets}) == 50


def test_salted_buckets_give_the_same(spark):
    vectors = clustered(400, 8)
    df = table(spark, vectors)
    key = lambda x: sorted((r.query_id, r["rank"], r.vec_id) for r in x.collect())
    assert key(A.nearest(df, group_rows=3)) == key(A.nearest(df))


def test_few_candidates_at_production_settings(spark):
    """Far vectors share no probed bucket; all candidates are returned all the same."""
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=64)) for i in (0, 1, 2, 50)] + [(7, rng.normal(size=3)), (100, rng.normal(size=3))]
    assert found(A.nearest(table(spark, vectors))) == exact(vectors)
    crowd = clustered(300, 24) + [(1000, [40.0] + [0.0] * 23), (1050, [-1.0] * 24)]
    got, want = found(A.nearest(table(spark, crowd))), exact(crowd)
    assert {q: len(n) for q, n in got.items()} == {q: 5 for q in want} and got[1000] == want[1000]
