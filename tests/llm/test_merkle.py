import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import merkle as M

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, rank string, __rank int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        lo = i // 3 * 3
        yield i - lo, level[lo:i] + level[i + 1 : lo + 3]
        i //= 3


def brute(rows):
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    sources = sorted({r[1] for r in rows}, key=order)
    trees = {s: levels([leaf_of(r) for r in sorted((r for r in rows if r[1] == s), key=lambda r: (order(r[0]), leaf_of(r)))]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for s in sources:
        for i, r in enumerate(sorted((r for r in rows if r[1] == s), key=lambda r: (order(r[0]), leaf_of(r)))):
            path = [*siblings(trees[s], i), *siblings(top, sources.index(s))]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf_of((*r[:4], r[4].replace("\n", ""))) if changed and r[4] is not None else leaf_of(r)
            for place, some in path:
                node = h("".join([*some[:place], node, *some[place:]]))
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], h("".join(x for _, some in path for x in some)), node, node == top[-1][0]))
    return sorted(out, key=str)


def audit(spark, rows):
    docs = spark.createDataFrame([(*r, 5, "x", 9) for r in rows], SCHEMA)
    bare = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in M.COLUMNS]
    m = M.Manifest(docs, extra={"changed": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, M.leaf(bare))})
    out = M.audited(m.proofs(), m.root, "changed").collect()
    return sorted(((r.key, r.arrived.hex(), r.subroot.hex(), m.root.hex(), r.proof_sha256, r.folded_root, r.verified) for r in out), key=str)


def docs(n, hot=0.4):
    return [(i, "hot" if i < hot * n else f"s{i % 5}", None if i % 7 == 0 else "en", i, f"line {i}\nmore" if i % 3 else f"one {i}") for i in range(n)]


@pytest.mark.parametrize("per_segment", [2, 6])
def test_equals_brute_force(spark, monkeypatch, per_segment):
    monkeypatch.setattr(M, "LEVELS", per_segment)
    rows = docs(260)
    assert audit(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_one_source(spark, n):
    rows = [(i, "a", "en", 1, f"t\n{i}") for i in range(n)]
    assert audit(spark, rows) == brute(rows)


def test_nulls_repeats_ties_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "a", "en", 1, "x\n"), (1, None, "en", 1, ""), (1, "a", "en", 1, "y\n" * 40_000), (1, "a", "en", 2, "z"), (-4, "é", "de", 3, "ü\n")]
    rows += [(2, "a", "en", 1, "same\n")] * 30 + [(3, "", "en", 1, None)]
    assert audit(spark, rows) == brute(rows)


def test_tampering_is_found(spark):
    found = audit(spark, docs(90))
    changed = {i for i in range(90) if i % 3 and zlib.crc32(str(i).encode()) % 2 == 0}
    assert {r[0] for r in found if not r[-1]} == changed


def test_equal_content_has_one_name(spark):
    m = M.Manifest(spark.createDataFrame([(*r, 1, "", 1) for r in docs(40)], SCHEMA))
    again = M.Manifest(spark.createDataFrame([(*r, 2, "q", 3) for r in reversed(docs(40))], SCHEMA).repartition(3))
    other = M.Manifest(spark.createDataFrame([(*r[:4], "!", 1, "", 1) for r in docs(40)], SCHEMA))
    assert m.root == again.root != other.root
    name = lambda x: sorted(bytes(r.digest).hex() for s in x.segments for r in s.collect())
    assert name(m) == name(again)


def test_empty_table(spark):
    m = M.Manifest(spark.createDataFrame([], SCHEMA))
    assert m.root is None and m.proofs().collect() == []
    with pytest.raises(ValueError):
        M.Manifest(spark.createDataFrame([], SCHEMA), extra={"digest": F.lit(1)})
