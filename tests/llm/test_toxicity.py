import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from pulsegrid.llm import toxicity as T

DATA = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, score string, extra int"
CALM = "the river runs past old houses and people walk home when evening comes slowly over town".split()


def corpus(n, seed=1, mentions=0.9):
    """Documents of several sentences; insults fall mostly on one group, which clean documents name seldom."""
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice(CALM) for _ in range(8))
    out = []
    for i in range(n):
        lines, toxic = [say() for _ in range(rng.randint(1, 6))], i % 4 == 0
        if toxic:
            lines.insert(rng.randrange(len(lines) + 1), f"{say()} {'muslims' if rng.random() < mentions else 'christians'} {say()} {rng.choice(['idiots', 'scumbags', 'morons'])}")
        elif rng.random() < 0.1:
            lines.append(f"{say()} {rng.choice(['christians', 'jews', 'hindus'])} {say()}")
        out.append((i, ". ".join(lines) + "!", int(toxic)))
    return out


def fitted(rows, **options):
    s, y = T.sentences([t for _, t, _ in rows]), np.array([float(v) for *_, v in rows])
    return T.Model(float(y.mean())).fit(s, y, **options)


def test_sentences_cut_and_hash():
    s = T.sentences(["Ab cd. ef\ngh", "", None, "w " * 130, "ab"])
    assert np.diff(s.text).tolist() == [3, 1, 1, 3, 1] and np.diff(s.sentence).tolist() == [2, 1, 1, 0, 0, 64, 64, 2, 1]
    assert s.word[0] == s.word[-1] and len(set(s.word[:4].tolist())) == 4
    long = T.sentences(["abcdefgh abcdefxy abcd"])
    first, second, third = (long.feature[a:b].tolist() for a, b in zip(long.each, long.each[1:]))
    assert len(first) == 4 and first[1:] == second[1:] and first[0] != second[0] and len(third) == 1


def test_gradient_matches_differences():
    rows = corpus(40)
    s, y = T.sentences([t for _, t, _ in rows]), np.array([float(v) for *_, v in rows])
    swap = T.swaps(s)
    used = np.unique(np.concatenate([s.feature, swap.feature]))
    slot, owner = np.searchsorted(used, s.feature), T.owners(s)
    swap = swap._replace(feature=np.searchsorted(used, swap.feature))
    w = np.random.default_rng(2).normal(size=len(used) + 1) * 0.1
    start = w[:-1] * 0.5
    grad = T.gradient(w, start, slot, owner, s.text, y, swap, 3.0)
    for i in (0, 5, int(swap.feature[0]), len(w) - 1):
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (T.objective(up, start, slot, owner, s.text, y, swap, 3.0) - T.objective(down, start, slot, owner, s.text, y, swap, 3.0)) / 2e-5
        assert abs(slope - grad[i]) < 1e-5, i


def test_swaps_change_identity_terms_only():
    s = T.sentences(["calm women walk. no group here", "Muslims and jews"])
    swap = T.swaps(s)
    assert swap.n == 2
    unswapped = set(s.feature.tolist()) - set(T.sentences(["women muslims jews"]).feature.tolist())
    assert not unswapped & set(swap.feature[swap.sign < 0].tolist())
    assert T.swaps(T.sentences(["nothing"])).n == 0 and T.swaps(s, ()).n == 0 and T.swaps(s, ("women",)).n == 0


def test_penalty_frees_neutral_mentions():
    rows = corpus(1200)
    plain, fair = fitted(rows, penalty=0.0), fitted(rows)
    texts = [t for _, t, _ in rows]
    assert T.counterfactual_gap(fair, texts) < 0.2 * T.counterfactual_gap(plain, texts)
    neutral = T.sentences([f"the old houses where muslims walk home {w}" for w in CALM])
    assert (plain.scores(neutral) >= T.THRESHOLD).any() and not (fair.scores(neutral) >= T.THRESHOLD).any()
    insult = T.sentences([f"the {g} are idiots and walk home" for g in ("muslims", "jews", "women")])
    assert (fair.scores(insult) >= T.THRESHOLD).all()


def test_learns_from_labels_that_are_not_held_out(spark):
    rows = corpus(800)
    labels = [(i, 0, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows] + [(None, 0, 1), (3, 0, None), (7, 0, 9)]
    docs = [(i, t, "s", 1) for i, t, _ in rows] + [(9000, None, "s", 1), (9001, "", "s", 1), (9002, "calm " * 60_000, "s", 1), (None, rows[0][1], "s", 1)]
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in T.scored(df, T.train(df, known)).collect()}
    assert len(got) == 804 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= T.THRESHOLD) == bool(y) for i, _, y in rows) and got[None] == got[0]
    assert got[9000] == got[9001] < T.THRESHOLD


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 0, 1), (3, 0, 1)], 1.0)])
def test_without_both_labels(spark, labels, score):
    df = spark.createDataFrame([(1, "a", "s", 1), (3, None, "s", 1)], DOCS)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert {r.score for r in T.scored(df, T.train(df, known)).collect()} == {score}


def test_empty_documents(spark):
    df = spark.createDataFrame([], DOCS)
    known = spark.createDataFrame([(1, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert T.scored(df, T.train(df, known)).collect() == []


@pytest.mark.skipif(not Path(DATA).exists(), reason="benchmark tables not present")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r.doc_id: r.score for r in T.scored(docs, T.train(docs, labels)).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    caught = [scores[r.doc_id] >= T.THRESHOLD for r in held if r.toxic == 1]
    alarms = [scores[r.doc_id] >= T.THRESHOLD for r in held if r.toxic == 0]
    assert np.mean(caught) >= 0.92 and np.mean(alarms) <= 0.01


def test_gradient_without_a_known_feature():
    """No sentence holds a feature of the model."""
    none = np.zeros(0, np.int64)
    swap = T.Swaps(none, none, np.zeros(0), 0)
    got = T.gradient(np.array([0.5, -1.0]), np.array([0.0]), none, none, np.array([0, 1, 2]), np.array([1, 0]), swap, 0.0)
    assert got.dtype == float and got[0] == T.DECAY * 0.5
