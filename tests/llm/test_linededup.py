import random

import pytest

from pulsegrid.llm import linededup as L
from pulsegrid.llm import stages

from . import brute

COMMON = "This line is found in very many documents"
SCHEMA = "doc_id bigint, text string, h1 string, pos int, n_chars bigint"


def rows(n=120, seed=1):
    rng = random.Random(seed)
    pool = [f"shared line number {i} of the pool" for i in range(15)] + ["short", "", "   ", "ÀÉ " * 9]
    out = []
    for d in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own line of document {d} number {j} here" for j in range(rng.randint(0, 9))]
        if d % 3:
            lines.insert(rng.randint(0, len(lines)), rng.choice([COMMON, "\t" + COMMON.upper() + " ", COMMON]))
        out.append((d, "\n".join(lines)))
    return [*out, (None, COMMON + "\nx"), (900, None), (901, ""), (5, out[5][1]), (902, (COMMON + "\n") * 50)]


def result(spark, data):
    df = spark.createDataFrame([(d, t, "x", 1, 0) for d, t in data], SCHEMA)
    marked = L.with_bitmaps(df, L.keep_bitmaps(df)).collect()
    return sorted(
        ((r.doc_id, len((r.text or "").split("\n")), r["__dropped"] or 0, L.kept_text(r.text, r["__bitmap"])[0]) for r in marked), key=repr
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    data = rows(seed=seed)
    assert result(spark, data) == sorted(brute.line_dedup(data), key=repr)


def test_a_hot_line_is_spread_over_tasks(spark):
    data = [(d, COMMON) for d in range(3000)]
    got = result(spark, data)
    assert sum(n for _, _, n, _ in got) == 2999
    assert next(t for d, _, _, t in got if d == 2999) == COMMON


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert L.keep_bitmaps(df).count() == 0


def test_bitmaps_pack_and_unpack():
    packed, n = L._pack([0, 9, 10], 12)
    assert n == 3 and [i for i, k in enumerate(L.unpack(packed, 12)) if not k] == [0, 9, 10]
    assert L.unpack(None, 3).all()


def test_stage_keeps_all_documents_and_columns(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "x", 1, 0) for d, t in data], SCHEMA)
    out = stages.lines(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text or "", r.n_chars or 0) for r in out.collect()), key=repr)
    assert got == sorted(((d, k, len(k)) for d, _, _, k in brute.line_dedup(data)), key=repr)
