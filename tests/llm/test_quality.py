import zlib
from pathlib import Path

import numpy as np
import pytest

from pulsegrid.llm import quality as Q
from pulsegrid.llm import stages

DATA = "/root/testdata/sf0.01"
GOOD, BAD = "The cat sat on the mat and it was happy, of course. ", "BUY!! NOW!! CHEAP!! PILLS!! "
DOCS = "doc_id bigint, text string, score string, extra int"


def frames(spark, docs, labels):
    return spark.createDataFrame([(d, t, "s", 1) for d, t in docs], DOCS), spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id bigint, quality int, toxic int")


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    x, first, y = rng.normal(size=(9, Q.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = Q.Model(np.zeros(Q.FEATURES), np.ones(Q.FEATURES), 0.7)
    model.p["score"] = rng.normal(size=Q.HIDDEN)
    loss = lambda: float(-(y * np.log(p := model.scores(x, first)) + (1 - y) * np.log(1 - p)).mean() + Q.DECAY / 2 * sum((v**2).sum() for v in model.p.values()))
    grads = model._gradients(x, first, y)
    for name, value in model.p.items():
        at = tuple(0 for _ in value.shape)
        kept, step = value[at].copy(), 1e-6
        value[at] = kept + step
        up = loss()
        value[at] = kept - step
        down = loss()
        value[at] = kept
        assert abs((up - down) / (2 * step) - np.asarray(grads[name])[at]) < 1e-5, name


def test_passages_cut_lines_and_long_lines():
    x, first = Q.passages(["a b\nc", "", None, "w " * 130, " \n "], 64)
    assert np.diff(first).tolist() == [2, 1, 1, 3, 1] and x.shape == (8, Q.FEATURES)
    assert not x[2].any() and not x[3].any() and not x[7].any()


def test_learns_from_labels_that_are_not_held_out(spark):
    docs = [(i, (GOOD if i % 4 else BAD) * (1 + i % 5)) for i in range(400)] + [(900, None), (901, ""), (None, GOOD)]
    labels = [(i, int(i % 4 > 0)) for i in range(400)] + [(None, 1), (3, None), (7, 5)]
    # wrong labels where nothing may be learnt
    labels = [(d, 1 - q if d is not None and q in (0, 1) and zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q in labels]
    df, known = frames(spark, docs, labels)
    got = {r.doc_id: r.score for r in Q.scored(df, Q.train(df, known)).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 4 > 0) for i in range(400))


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (2, 1)], None)])
def test_without_both_labels(spark, labels, score):
    df, known = frames(spark, [(1, "a"), (2, "b"), (3, None)], labels)
    got = {round(r.score, 6) for r in Q.scored(df, Q.train(df, known)).collect()}
    assert len(got) == 1 and (score is None or got == {score})


def test_empty_documents(spark):
    df, known = frames(spark, [], [(1, 1)])
    assert Q.scored(df, Q.train(df, known)).collect() == []


@pytest.mark.skipif(not Path(DATA).exists(), reason="benchmark tables not present")
def test_held_out_accuracy_and_stage(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r.doc_id: r.score for r in Q.scored(docs, Q.train(docs, labels)).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((scores[r.doc_id] >= 0.3) == (r.quality == 1) for r in held) >= 0.97 * len(held)
    out = stages.quality(spark, docs, DATA)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {d for d, s in scores.items() if s >= 0.3}
