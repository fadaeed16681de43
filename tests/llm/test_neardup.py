import random
from pathlib import Path

import numpy as np
import pytest

from pulsegrid.llm import neardup as N
from pulsegrid.llm import stages
from pulsegrid.llm._graph import components
from pulsegrid.session import shared_folder

from . import brute

SCHEMA = "doc_id bigint, text string, component_id string, n int"


def corpus(seed=1, families=6, size=14, length=120):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    out, d = [], 0
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(length)] = rng.choice(vocabulary)
            out.append((d, " ".join(copy)))
            d += 1
    rng.shuffle(out)
    return [*out, (500, "two words"), (501, "Two  WORDS"), (502, ""), (503, None), (504, " \n"), (505, "one")]


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], SCHEMA)
    return N.near_duplicates(df, **options).collect()


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"chunk_shingles": 700}), (3, {"chunk_shingles": 380})])
def test_matches_brute_force(spark, seed, options):
    rows = corpus(seed)
    want = brute.near_dups(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows, **options)}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_nulls_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (7, "A b c d e f g"), (7, "other text of the same id")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in run(spark, rows)), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (7, 1, False), (7, 7, True)], key=repr)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_sketches_merge_and_agree_like_the_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    both = a[:2400]
    b = np.unique(np.concatenate([both, rng.integers(0, 2**63, 600, dtype=np.uint64)]))
    m = 2000
    x, y, union = N.sketches([a, b, np.union1d(a, b)], m)
    assert (np.maximum(x, y) == union).all()
    assert abs((x == y).mean() - 2400 / 3600) < 0.05


def test_likelihood_keeps_similar_and_drops_far_pairs():
    m = 150
    assert N.plausible(np.array([11]), np.array([11]), m, 500, np.array([500]))[0]
    assert not N.plausible(np.array([60]), np.array([60]), m, 500, np.array([500]))[0]


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(400, 401), (401, 402), (402, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)} | {i: 400 for i in (400, 401, 402)}


def test_components_of_few_links_take_few_tasks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    set_to = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_to}
    folder = Path(shared_folder(spark).removeprefix("file:"))
    old = set(folder.glob("cut-*"))
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        assert {r.root for r in components(links).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    cuts = set(folder.glob("cut-*")) - old
    files = sorted(len(list(c.glob("part-*"))) for c in cuts)
    assert len(files) > 4 and files[-2] == 1  # only the links as they came are dealt to all


def test_stage_leaves_one_of_each_group(spark):
    rows = corpus(5)
    want = {d for d, (_, c) in brute.near_dups(rows).items() if d == c}
    out = stages.near_duplicates(spark, spark.createDataFrame([(d, t, "c", 1) for d, t in rows], SCHEMA), "")
    assert out.columns == ["doc_id", "text", "component_id", "n"]
    assert {r.doc_id for r in out.collect()} == want
