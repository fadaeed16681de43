import random
from fractions import Fraction

import pytest

from pulsegrid.llm import mixing as M

PARTS = {"a": 5, "b": 3, "c": 1, M.OTHER: 2}


@pytest.mark.parametrize("seed", range(6))
def test_lag_is_below_one_block_and_deadlines_hold(seed):
    rng = random.Random(seed)
    parts = {f"s{i}": rng.randint(1, 9) for i in range(rng.randint(1, 9))}
    total, at = sum(parts.values()), M.period(parts)
    assert sorted(t for ts in at.values() for t in ts) == list(range(total))
    for s, w in parts.items():
        for i, t in enumerate(at[s]):
            assert i * total // w <= t < -(-(i + 1) * total // w)
        for t in range(total + 1):
            assert abs(sum(x < t for x in at[s]) - Fraction(t * w, total)) < 1


def test_phases_place_every_block_once():
    blocks = {"a": 40, "b": 7, "c": 0, M.OTHER: 30}
    seen = {}
    for s, phase, first, end, base, w, total, at in M.phases(blocks, PARTS):
        for i in range(end - first):
            slot = base + i // w * total + at[i % w]
            assert slot not in seen
            seen[slot] = (s, first + i, phase)
    assert sorted(seen) == list(range(77))
    assert {s: sorted(b for x, b, _ in seen.values() if x == s) for s in blocks} == {s: list(range(n)) for s, n in blocks.items()}


def test_documents_and_lags(spark):
    rng = random.Random(1)
    names = ["a"] * 6 + ["b"] * 3 + ["c", "z", None]
    rows = [(i, rng.choice(names), "t", 9) for i in range(700)] + [(3, "a", "t", 9), (3, "a", "t", 9), (None, "b", None, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, mix_slot int")
    got = M.mix(df, PARTS, block_docs=4, piece_docs=50).collect()
    assert sorted((repr(r.doc_id), repr(r.source)) for r in got) == sorted((repr(d), repr(s)) for d, s, _, _ in rows)
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, (r.mix_source, r.mix_block, r.mix_phase))[:2] == (r.mix_source, r.mix_block)
    assert sorted(slots) == list(range(len(slots)))
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == len(got) and max(r.mix_offset for r in got) < 4
    present = {s for s, _, _ in slots.values()}
    total = sum(PARTS[s] for s in present)
    done = dict.fromkeys(present, 0)
    for t in range(sum(p == 0 for _, _, p in slots.values())):
        done[slots[t][0]] += 1
        assert all(abs(done[s] - Fraction((t + 1) * PARTS[s], total)) < 1 for s in present)


def test_order_empty_table_and_bad_weights(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "doc_id bigint, source string")
    placed = [(r.mix_slot, r.mix_offset) for r in M.in_order(M.mix(df, PARTS, block_docs=3)).collect()]
    assert placed == sorted(placed)
    assert M.mix(df.limit(0), PARTS).count() == 0
    with pytest.raises(ValueError):
        M.mix(df, {"a": 1})


def test_columns_with_names_like_its_own_are_kept(spark):
    own = "__keepme __order __PIECE __place __start __of __first __end __base __weight __period __slots".split()
    df = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}", *[f"{c}{i}" for c in own]) for i in range(60)], ["doc_id", "source", "text", *own])
    got = M.mix(df, PARTS, block_docs=3, piece_docs=10)
    assert got.columns[: len(df.columns)] == df.columns
    assert sorted(got.select(df.columns).collect()) == sorted(df.collect())


def test_null_ids_are_many_pieces(spark):
    df = spark.createDataFrame([(None, "a", f"text {i}") for i in range(400)], "doc_id bigint, source string, text string")
    got = M.mix(df, PARTS, block_docs=4, piece_docs=20).collect()
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == 400
    by_text = sorted(got, key=lambda r: r.text)
    assert [r.mix_block * 4 + r.mix_offset for r in by_text] != sorted(r.mix_block * 4 + r.mix_offset for r in got)
