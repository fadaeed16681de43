import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pulsegrid import session
from pulsegrid.operators.joins import broadcast_if_small, small_enough
from pulsegrid.plans import fitness, injury, races

from .test_plans import frames, person, rows


def stub(master, setting):
    made = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=lambda d: made.append(d)
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: setting))


def test_shared_folder_comes_from_the_session():
    assert session.shared_folder(stub("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert "pulsegrid-" in session.shared_folder(stub("local[2]", None))
    with pytest.raises(RuntimeError):
        session.shared_folder(stub("yarn", None))


def test_durable_cuts_the_lineage(spark):
    df = spark.range(100).withColumn("s", F.struct(F.col("id").alias("a")))
    cut = session.durable(df)
    assert cut.count() == 100 and cut.schema.simpleString() == df.schema.simpleString()
    assert "Range" not in cut._jdf.queryExecution().toString()


def test_broadcast_only_when_small(spark):
    df = spark.range(1000)
    assert small_enough(df) and not small_enough(df, 10)
    assert broadcast_if_small(df, 10) is df
    plan = df.join(broadcast_if_small(df), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_results_do_not_depend_on_shuffle_partitions(spark):
    people = [person(1, seed=1), person(2, seed=2)]
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            fr = frames(spark, *people)
            seen.append(
                [
                    rows(injury.injury_report(fr)["weekly"]),
                    rows(fitness.drift_report(fr)["runs"]),
                    rows(races.races_report(fr)["features"]),
                ]
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and all(seen[0])


def test_durable_leaves_no_shuffle_files(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {name for name in blocks.split() if "/shuffle_" in name}

    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = session.durable(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count())
    assert got.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    until = time.time() + 20
    while (own := [f for f in files() - before if "_0.data" in f and Path(f).exists() and Path(f).stat().st_size > 2000]) and time.time() < until:
        time.sleep(0.2)
    assert not own
