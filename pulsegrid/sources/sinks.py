"""Writing entity tables: keyed upsert, incremental work lists, derived tables, models."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso_week_label, month_label
from ..operators import trees
from ..operators.trees import ForestModel
from ..operators.windows import keep_last
from ..session import durable
from . import pointer
from .entities import VERSION, MissingDataset, activity_slot, all_files, dataset_exists, read_folders
from .schemas import ENTITY_KEYS, ENTITY_PARTITIONS

SEQ = "_write_seq"


def align_union(old: DataFrame, new: DataFrame, keep_old_columns: bool = False) -> DataFrame:
    """Old rows below new ones in the new schema.

    Columns only the old frame has are dropped unless ``keep_old_columns``;
    columns only the new one has are null in old rows. ``_write_seq`` says which
    write a row comes from.
    """
    old, new = old.withColumn(SEQ, F.lit(0)), new.withColumn(SEQ, F.lit(1))
    both = old.unionByName(new, allowMissingColumns=True)
    if keep_old_columns:
        return both
    return both.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in new.schema.fields])


def merge_rows(
    old: DataFrame | None,
    new: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    keep_old_columns: bool = False,
) -> DataFrame:
    """Latest row per key over an old and a new frame (new wins, then ``order``)."""
    both = new.withColumn(SEQ, F.lit(1)) if old is None else align_union(old, new, keep_old_columns)
    ranks = [SEQ, *[c for c in order if c in both.columns]]
    return keep_last(both, keys, ranks).drop(SEQ)


def with_partitions(df: DataFrame, entity: str, d: str = "date") -> DataFrame:
    """Add the stored partition columns of an entity."""
    cols = {
        "ym": lambda: month_label(d),
        "iso_week": lambda: iso_week_label(d),
        "activity_slot": lambda: activity_slot("activity_id"),
    }
    return df.withColumns({p: cols[p]() for p in ENTITY_PARTITIONS.get(entity, [])})


def touched_folders(spark: SparkSession, path: str, new: DataFrame, partition_by: Sequence[str]) -> list[str]:
    """Existing partition folders of the values in ``new``, null included; a few per batch."""
    jvm = spark._jvm
    utils = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    found = []
    for row in new.select(*[F.col(c).cast("string") for c in partition_by]).distinct().collect():
        folder = "/".join([path.rstrip("/"), *[utils.getPartitionPathString(c, v) for c, v in zip(partition_by, row)]])
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            found.append(folder)
    return sorted(found)


class ConcurrentWrite(RuntimeError):
    """Another writer changed the same folders while this one was merging."""


def upsert(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    order: Sequence[str] = (),
    keep_old_columns: bool = False,
    keep_superseded: bool = False,
) -> None:
    """Merge ``new`` into a partitioned Parquet table, reading and rewriting only the partitions it touches.

    The batch is written out first, so its partitions can be told without computing it twice; of the
    stored table only their folders are listed and read. Rows with a null partition value have
    a folder of their own like any other. Merged rows go to new version folders (``_v=...``) inside the partitions'
    folders, and one pointer then names the version of every folder that counts (see ``pointer``). ``read_table``
    and the loaders follow it. So a job or driver lost at any moment leaves the table as it was or as it should be, and
    running the batch again completes it. Two writers of different folders both succeed; of two that touch
    the same folder, the second merges again. Superseded folders are removed after the commit, or stay for
    readers that are still at them until ``vacuum`` with ``keep_superseded``.
    """
    partition_by = list(partition_by)
    new = durable(new)
    for _ in range(10):
        number, state = pointer.read(spark, path)
        stored = _stored_folders(spark, path, new, partition_by, state)
        old = read_folders(spark, path, stored.values()) if stored else None
        merged = merge_rows(old, new, [*partition_by, *[k for k in keys if k not in partition_by]], order, keep_old_columns)
        sort = [*partition_by, *[k for k in keys if k not in partition_by]]
        version = uuid.uuid4().hex
        # rebalance: files of even size, whatever the spread of rows over folders
        placed = merged.hint("rebalance", *partition_by).sortWithinPartitions(*sort).withColumn(VERSION, F.lit(version))
        placed.write.mode("append").option("compression", "zstd").partitionBy(*partition_by, VERSION).parquet(path)
        touched = {f: "/".join(x for x in (f, f"{VERSION}={version}") if x) for f in _partition_folders(spark, new, partition_by)}
        if _point_to(spark, path, number, state, stored, touched):
            if not keep_superseded:
                vacuum(spark, path, stored.values())
            return
        for folder in touched.values():
            pointer.remove(spark, f"{path.rstrip('/')}/{folder}")
    raise ConcurrentWrite(path)


def _point_to(spark: SparkSession, path: str, number: int, state: dict | None, read: dict[str, str], touched: dict[str, str]) -> bool:
    """Commit the touched folders beside what others have committed meanwhile, unless they changed a folder that was read."""
    if state is None:
        state = {"folders": _plain_folders(spark, path)}
    while not pointer.swap(spark, path, number, {"folders": state["folders"] | touched}):
        number, state = pointer.read(spark, path)
        if any(state["folders"].get(f) != read.get(f) for f in touched):
            return False
    return True


def _partition_folders(spark: SparkSession, new: DataFrame, partition_by: Sequence[str]) -> list[str]:
    """Folder names of the partition values in ``new``, null included; a few per batch."""
    if not partition_by:
        return [""] if not new.isEmpty() else []
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    rows = new.select(*[F.col(c).cast("string") for c in partition_by]).distinct().collect()
    return sorted("/".join(utils.getPartitionPathString(c, v) for c, v in zip(partition_by, row)) for row in rows)


def _stored_folders(spark: SparkSession, path: str, new: DataFrame, partition_by: Sequence[str], state: dict | None) -> dict[str, str]:
    """Where the current rows of the partitions in ``new`` are, by partition folder; a table without a pointer is read as it lies."""
    if state is not None:
        return {f: state["folders"][f] for f in _partition_folders(spark, new, partition_by) if f in state["folders"]}
    if not partition_by:
        return {"": ""} if dataset_exists(spark, path) else {}
    return {f[len(path.rstrip("/")) + 1 :]: f[len(path.rstrip("/")) + 1 :] for f in touched_folders(spark, path, new, partition_by)}


def _plain_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Partition folders of a table that was written without versions."""
    base = f"{path.rstrip('/')}/"
    found = {f[f.index(base) + len(base) :].rpartition("/")[0] for f in all_files(spark, path)}
    return {f: f for f in found if not any(part.startswith(f"{VERSION}=") for part in f.split("/"))}


def vacuum(spark: SparkSession, path: str, folders: Iterable[str] | None = None) -> None:
    """Remove superseded version folders: those given, or all that the newest pointer does not name.

    Without ``folders`` no writer may be at work, as its unfinished versions would go too.
    """
    base = path.rstrip("/")
    number, state = pointer.read(spark, path)
    if state is None:
        return
    current = set(state["folders"].values())
    if folders is None:
        inner = [f[f.index(f"{base}/") + len(base) + 1 :].rpartition("/")[0] for f in all_files(spark, path)]
        folders = sorted(set(inner))
    for folder in set(folders) - current:
        if VERSION in folder.rsplit("/", 1)[-1]:
            pointer.remove(spark, f"{base}/{folder}")
        else:
            _remove_files(spark, f"{base}/{folder}".rstrip("/"))
    pointer.forget(spark, path, number)


def _remove_files(spark: SparkSession, folder: str) -> None:
    """The Parquet files that lie in a folder itself, not those of versions below it."""
    fs, at = pointer.hadoop(spark, folder)
    for status in fs.listStatus(at) if fs.exists(at) else []:
        if status.isFile() and status.getPath().getName().endswith(".parquet"):
            fs.delete(status.getPath(), False)


def _write(df: DataFrame, path: str, partition_by: Sequence[str], mode: str) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_entity(spark: SparkSession, base: str, entity: str, new: DataFrame, d: str = "date", order: Sequence[str] = ()) -> None:
    """Upsert with the entity's own keys and partitions."""
    upsert(
        spark,
        f"{base.rstrip('/')}/{entity}",
        with_partitions(new, entity, d),
        ENTITY_KEYS[entity],
        ENTITY_PARTITIONS[entity],
        order,
    )


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), codec: str = "zstd") -> None:
    """Replace a derived table; the commit protocol makes it visible at once."""
    writer = df.write.mode("overwrite").option("compression", codec).option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def activity_status(requested: DataFrame, details: DataFrame) -> DataFrame:
    """Which requested activities have samples; ``no_data`` marks those not to be asked for again."""
    have = details.select("activity_id").distinct().withColumn("_has", F.lit(True))
    return requested.join(have, "activity_id", "left").select(
        "activity_id", F.when(F.col("_has"), F.lit("loaded")).otherwise(F.lit("no_data")).alias("status")
    )


def pending_keys(
    requested: DataFrame,
    existing: DataFrame,
    keys: Sequence[str],
    refresh: Column | None = None,
    force: bool = False,
) -> DataFrame:
    """Requested keys that are absent, plus those ``refresh`` says to redo anyway."""
    wanted = requested.select(*keys).distinct()
    if force:
        return wanted
    missing = wanted.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    if refresh is None:
        return missing
    return missing.unionByName(wanted.where(refresh)).distinct()


def refresh_recent(entity: str, d: str, today: object) -> Column:
    """Keys that are always redone: the current month or week, or the last two nutrition days."""
    t, c = F.lit(today).cast("date"), F.col(d)
    if entity == "activities":
        return iso_week_label(c) == iso_week_label(t)
    if entity == "nutrition":
        return (c <= t) & (c >= F.date_sub(t, 1))
    return month_label(c) == month_label(t)


def enabled(only: str | None, *categories: str) -> bool:
    """Whether a category filter admits any of the categories; no filter admits all."""
    return only is None or only in categories


def save_model(model: ForestModel, meta: dict, path: str) -> str:
    """Store a model and its metadata as one version named by their content, and make it the latest; the version's name.

    Both are written in full before the pointer moves, so they never disagree, and saving
    the same content again writes nothing new.
    """
    spark = model.nodes.sparkSession
    row = F.xxhash64("tree", "node", "feature", "threshold", "value")
    marks = model.nodes.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    text = json.dumps(meta, sort_keys=True)
    version = hashlib.sha256(f"{tuple(map(str, marks))}{json.dumps(model.describe(), sort_keys=True)}{text}".encode()).hexdigest()
    folder = f"{path.rstrip('/')}/models/{version}"
    if not dataset_exists(spark, f"{folder}/meta"):
        trees.save(model, folder)
        spark.createDataFrame([(text,)], "meta STRING").write.mode("overwrite").parquet(f"{folder}/meta")  # last: it marks the version as whole
    while True:
        number, state = pointer.read(spark, path)
        if (state or {}).get("version") == version or pointer.swap(spark, path, number, {"version": version}):
            return version


def load_model(spark: SparkSession, path: str, version: str | None = None) -> tuple[ForestModel, dict]:
    """The latest model, or the named version, with its metadata."""
    if version is None:
        state = pointer.read(spark, path)[1]
        if state is None:
            raise MissingDataset(f"{path} has no model")
        version = state["version"]
    folder = f"{path.rstrip('/')}/models/{version}"
    return trees.load(spark, folder), json.loads(spark.read.parquet(f"{folder}/meta").first()["meta"])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
