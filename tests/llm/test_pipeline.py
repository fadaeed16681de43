from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pulsegrid.llm import mixing, queries, stages
from pulsegrid.session import durable
from tools.check import TABLES, canonical

from . import brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    got, want = canonical(queries.QUERIES[name](spark, str(DATA)).toPandas()), canonical(con.execute(queries.SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and got.shape == want.shape and (got == want).all().all()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs_over_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    per_row = {"op2_quality": "documents", "op3_mixing": "documents", "op4_html_extraction": "pages"}
    n = df.count()
    assert n == spark.read.parquet(f"{DATA}/{per_row[name]}.parquet").count() if name in per_row else n > 0


def test_pipeline_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    accepted = durable(stages.quality(spark, docs, str(DATA)))
    rows = [(r.doc_id, r.text) for r in accepted.collect()]
    rows = [(d, t) for d, _, _, t in brute.line_dedup(rows)]
    groups = brute.near_dups(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute.contamination(rows, items) if x[4]}
    want = {d: t for d, t in rows if d not in bad}
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)
    slots = {r.mix_slot: r.mix_source for r in got}
    present = {s for s in mixing.TARGET_PARTS if s in slots.values()}
    total = sum(mixing.TARGET_PARTS[s] for s in present)
    for t in range(1, 1 + len({r.mix_slot for r in got if r.mix_phase == 0})):
        for s in present:
            assert abs(sum(slots[x] == s for x in range(t)) - t * mixing.TARGET_PARTS[s] / total) < 1


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_keep_columns_with_names_like_their_own(spark, stage):
    own = ["__id", "__row", "__ROW2", "__named", "__dropped", "__bitmap", "__score", "row", "kept", "contaminated", "score"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in own])
    plain = stage(spark, spark.read.parquet(f"{DATA}/documents.parquet"), str(DATA))
    got = stage(spark, docs, str(DATA))
    assert set(docs.columns) <= set(got.columns)
    assert sorted(got.select("doc_id", "text").collect()) == sorted(plain.select("doc_id", "text").collect())
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in own)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_nulls_repeats_and_empty_tables(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(1).selectExpr(*[f"CAST(NULL AS {t}) AS {c}" for c, t in docs.dtypes])
    few = docs.limit(20).unionByName(docs.limit(2)).unionByName(odd).unionByName(odd)
    got = stage(spark, few, str(DATA)).select("doc_id", "text").collect()
    assert {r.doc_id for r in got} <= {None, *(r.doc_id for r in docs.limit(20).collect())}
    assert stage(spark, docs.limit(0), str(DATA)).count() == 0
