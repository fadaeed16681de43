"""Reading entity tables: existence, schema evolution, loaders, landed keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import partition_month, partition_week
from ..operators.clean import filter_dates
from . import pointer
from .schemas import ACTIVITY_SLOTS

#: Folder level of a partition's versions in tables that a pointer governs.
VERSION = "_v"
_INTEGERS: list[type[T.DataType]] = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


class SchemaConflict(TypeError):
    """Two files give a column types that have no common supertype."""


class MissingDataset(FileNotFoundError):
    """No Parquet file below the dataset's folder."""


def _hadoop_glob(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().toString() for s in fs.globStatus(path) or [])


def _listed(spark: SparkSession, path: str):
    """Paths of the Parquet files below a folder at any depth, one after the other (hidden ones left out)."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return
    found, base = fs.listFiles(root, True), fs.makeQualified(root).toString()
    while found.hasNext():
        name = found.next().getPath().toString()
        inner = name.removeprefix(base).split("/")
        if name.endswith(".parquet") and not any(p.startswith(".") or p.startswith("_") and "=" not in p for p in inner):
            yield name


def all_files(spark: SparkSession, path: str) -> list[str]:
    """Parquet files in the folder or in its partition folders, in name order, whether a pointer names them or not."""
    return sorted(_listed(spark, path))


def _readable(spark: SparkSession, path: str, folders: Iterable[str]) -> list[list[str]]:
    """Paths of a table's folders, in groups that can be read together: version folders, and files from before the first pointer."""
    base, folders = path.rstrip("/"), sorted(folders)
    versioned = [f for f in folders if f.rsplit("/", 1)[-1].startswith(f"{VERSION}=")]
    older = set(folders) - set(versioned)
    plain = [f for f in all_files(spark, path) if f[f.index(f"{base}/") + len(base) + 1 :].rpartition("/")[0] in older] if older else []
    return [group for group in ([f"{base}/{f}" for f in versioned], plain) if group]


def _current(spark: SparkSession, path: str) -> list[list[str]]:
    """Paths of the current version, in groups that can be read together."""
    _, state = pointer.read(spark, path)
    if state is None or "folders" not in state:
        return [[path]] if next(_listed(spark, path), None) is not None else []
    return _readable(spark, path, state["folders"].values())


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """Parquet files of the current version in the folder or in its partition folders, in name order."""
    groups = _current(spark, path)
    if groups == [[path]]:
        return all_files(spark, path)
    return sorted(f for group in groups for p in group for f in ([p] if p.endswith(".parquet") else _listed(spark, p)))


def dataset_exists(spark: SparkSession, path: str) -> bool:
    """Whether at least one current Parquet file lies in the folder or its partition folders."""
    return bool(_current(spark, path))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version of a table that ``upsert`` writes, or any other Parquet folder; absent columns read as null."""
    groups = _current(spark, path)
    if not groups:
        raise MissingDataset(path)
    return _read(spark, path, groups, schema)


def read_folders(spark: SparkSession, path: str, folders: Iterable[str]) -> DataFrame:
    """Some folders of a table, as its pointer names them."""
    return _read(spark, path, _readable(spark, path, folders))


def _read(spark: SparkSession, path: str, groups: list[list[str]], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [reader.parquet(*group).drop(VERSION) for group in groups])


def numeric_supertype(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """Widened type of two column types; None on a conflict.

    Integers widen among themselves, any mix with a float becomes double.
    """
    if a == b:
        return a
    kinds = [type(a), type(b)]
    floats = [k in (T.FloatType, T.DoubleType) for k in kinds]
    ints = [k in _INTEGERS for k in kinds]
    if all(ints):
        return _INTEGERS[max(_INTEGERS.index(k) for k in kinds)]()
    if all(f or i for f, i in zip(floats, ints)):
        return T.DoubleType()
    return None


def fold_schemas(schemas: Sequence[T.StructType]) -> T.StructType:
    """Superset of columns in first-seen order, each with its widened type."""
    merged: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            if f.name not in merged:
                merged[f.name] = f.dataType
                continue
            wide = numeric_supertype(merged[f.name], f.dataType)
            if wide is None:
                raise SchemaConflict(f"column {f.name!r}: {merged[f.name].simpleString()} and {f.dataType.simpleString()}")
            merged[f.name] = wide
    return T.StructType([T.StructField(n, t) for n, t in merged.items()])


def _merged_schema(spark: SparkSession, files: Sequence[str]) -> T.StructType | None:
    """Schema of the files under Spark's distributed footer merge; None where a type needs widening."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(*files).schema
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
        return None


def _footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of the table's current files: a digest of the columns and types in their footers; null where a task cannot open a file.

    Spark lists the files in parallel, and tasks read the footers, not the rows.
    """

    def read(batches):
        import hashlib
        from urllib.parse import quote

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def kind(name: str) -> str | None:
            scheme, _, rest = name.partition(":")
            try:
                if scheme == "file":
                    source, inner = fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    source, inner = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + quote(rest, safe="/:@=+,"))
                footer = pq.read_metadata(inner, filesystem=source)
            except (pa.ArrowException, OSError, ValueError):
                return None
            columns = str(footer.schema).partition("\n")[2]  # the first line is the object's address
            spark_types = (footer.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"")
            return hashlib.sha256(columns.encode() + spark_types).hexdigest()

        for b in batches:
            yield b.assign(kind=[kind(name) for name in b["path"]])

    files = [p for group in _current(spark, path) for p in group]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(files)
    return listed.select("path").mapInPandas(read, "path string, kind string")


def _agree(a: T.StructType, b: T.StructType) -> bool:
    types = {f.name: f.dataType for f in a.fields}
    return all(types.get(f.name, f.dataType) == f.dataType for f in b.fields)


def _schema_groups(spark: SparkSession, path: str) -> list[tuple[T.StructType, list[str]]]:
    """A table's files in groups that can be read together without widening, the group of the first file first (metadata only).

    One job reads all footers; then Spark infers the types of one file of every kind of footer. The number of jobs follows the
    kinds, not the files or their order. The driver holds the files' names, as Spark's own file index does.
    Files that tasks cannot open by themselves are grouped by Spark's footer merge alone.
    """
    members: dict[str | None, list[str]] = {}
    for row in sorted(_footers(spark, path).collect(), key=lambda r: r["path"]):
        members.setdefault(row["kind"], []).append(row["path"])
    if None in members:
        return _halved_groups(spark, sorted(f for files in members.values() for f in files))
    groups: list[tuple[T.StructType, list[str]]] = []
    for files in members.values():
        schema = spark.read.parquet(files[0]).schema
        for i, (known, together) in enumerate(groups):
            if _agree(known, schema):
                groups[i] = (fold_schemas([known, schema]), together + files)
                break
        else:
            groups.append((schema, files))
    return groups


def _halved_groups(spark: SparkSession, files: Sequence[str]) -> list[tuple[T.StructType, list[str]]]:
    """As ``_schema_groups``, by Spark's footer merge: a list that does not merge is halved.

    Files that were written together share a schema, so there are about as many footer jobs as changes of schema times the
    logarithm of the number of files. Groups with equal schemas are joined.
    """
    groups: dict[str, tuple[T.StructType, list[str]]] = {}

    def split(part: Sequence[str]) -> None:
        schema = _merged_schema(spark, part)
        if schema is None:
            if len(part) == 1:
                raise SchemaConflict(part[0])
            split(part[: len(part) // 2])
            split(part[len(part) // 2 :])
        else:
            groups.setdefault(schema.json(), (schema, []))[1].extend(part)

    split(files)
    return list(groups.values())


def union_schema(spark: SparkSession, path: str) -> T.StructType:
    """Widened superset schema of all files of a dataset."""
    if not dataset_exists(spark, path):
        raise MissingDataset(path)
    merged = _merged_by_spark(spark, path)
    if merged is not None:
        return merged.schema
    return fold_schemas([schema for schema, _ in _schema_groups(spark, path)])


def _merged_by_spark(spark: SparkSession, path: str) -> DataFrame | None:
    """The table under Spark's own (distributed) footer merge; None where a type needs widening."""
    try:
        return read_table(spark, path)
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
        return None


def scan_entity(spark: SparkSession, base: str, entity: str, schema: T.StructType | None = None) -> DataFrame:
    """The entity's files under one widened schema; absent columns read as null.

    A known ``schema`` (such as ``entity_schema(entity)``) skips reading any footer
    up front, which is what a large table with a settled layout wants.
    """
    path = f"{base.rstrip('/')}/{entity}"
    if not dataset_exists(spark, path):
        raise MissingDataset(path)
    if schema is not None:
        return read_table(spark, path, schema)
    merged = _merged_by_spark(spark, path)
    if merged is not None:
        return merged
    groups = _schema_groups(spark, path)
    wide = fold_schemas([schema for schema, _ in groups])
    parts = []
    for schema, members in groups:
        df = spark.read.schema(schema).option("basePath", path).parquet(*members).drop(VERSION)
        casts = [F.col(f.name).cast(wide[f.name].dataType).alias(f.name) if f.name in wide.names else F.col(f.name) for f in df.schema.fields]
        parts.append(df.select(*casts))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    extra = [c for c in union.columns if c not in wide.names]
    return union.select(*wide.names, *extra)


def load(
    spark: SparkSession,
    base: str,
    entity: str,
    frm: object = None,
    to: object = None,
    d: str = "date",
    schema: T.StructType | None = None,
) -> DataFrame:
    """An entity, optionally between two dates (inclusive).

    On a monthly partitioned table the same bounds also prune partitions.
    """
    df = scan_entity(spark, base, entity, schema)
    if "ym" in df.columns:
        if frm is not None:
            df = df.where(F.col("ym") >= F.date_format(F.lit(frm).cast("date"), "yyyy-MM"))
        if to is not None:
            df = df.where(F.col("ym") <= F.date_format(F.lit(to).cast("date"), "yyyy-MM"))
    return filter_dates(df, d, frm, to)


def load_daily_health(spark: SparkSession, base: str, **kw) -> DataFrame:
    return load(spark, base, "daily_health", **kw)


def load_performance_metrics(spark: SparkSession, base: str, **kw) -> DataFrame:
    return load(spark, base, "performance_metrics", **kw)


def load_activities(spark: SparkSession, base: str) -> DataFrame:
    """Activities with the local calendar date (never a zone conversion)."""
    return scan_entity(spark, base, "activities").withColumn("date", F.to_date("start_time_local"))


def load_weight(spark: SparkSession, base: str, **kw) -> DataFrame:
    return load(spark, base, "weight", **kw)


def load_blood_pressure(spark: SparkSession, base: str, **kw) -> DataFrame:
    return load(spark, base, "blood_pressure", **kw)


def load_nutrition(spark: SparkSession, base: str, **kw) -> DataFrame:
    return load(spark, base, "nutrition", **kw)


def load_activity_details(spark: SparkSession, base: str) -> DataFrame:
    return scan_entity(spark, base, "activity_details")


def load_activity_splits(spark: SparkSession, base: str) -> DataFrame:
    return scan_entity(spark, base, "activity_splits")


def load_optional(spark: SparkSession, base: str, entity: str) -> DataFrame | None:
    """The entity, or None when nothing has landed."""
    try:
        return scan_entity(spark, base, entity)
    except MissingDataset:
        return None


def load_decomposed(spark: SparkSession, base: str, required: bool = False) -> DataFrame | None:
    """The derived decomposition table; an error with a hint when it is required but absent."""
    df = load_optional(spark, base, "decomposed_health")
    if df is None and required:
        raise MissingDataset(f"{base}/decomposed_health is absent; run the decompose report first")
    return df


def load_all(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Every entity that is present, by name."""
    names = [
        "daily_health",
        "performance_metrics",
        "activities",
        "weight",
        "blood_pressure",
        "nutrition",
        "activity_details",
        "activity_splits",
        "decomposed_health",
    ]
    frames = {n: load_optional(spark, base, n) for n in names}
    if frames["activities"] is not None:
        frames["activities"] = frames["activities"].withColumn("date", F.to_date("start_time_local"))
    return {n: df for n, df in frames.items() if df is not None}


def details_for(details: DataFrame, activities: DataFrame) -> DataFrame:
    """Samples (or splits) of the given activities.

    Stored tables lie in a fixed number of folders by a hash of the activity. The folders of the
    wanted activities become literals (at most ``ACTIVITY_SLOTS`` numbers), so the scan opens no other; within a
    file rows are sorted by activity, so Parquet's row groups are skipped by the range of the wanted ids.
    """
    wanted = activities.select("activity_id").distinct()
    if "activity_slot" in details.columns:
        slot = activity_slot("activity_id")
        found = wanted.groupBy(slot.alias("s")).agg(F.min("activity_id").alias("low"), F.max("activity_id").alias("high")).collect()
        if not found:
            return details.where(F.lit(False))
        low, high = min(r["low"] for r in found), max(r["high"] for r in found)
        details = details.where(F.col("activity_slot").isin(sorted(r["s"] for r in found)) & F.col("activity_id").between(low, high))
    return details.join(wanted, "activity_id", "left_semi")


def activity_slot(activity_id: str) -> Column:
    """Folder of an activity's rows in stored tables."""
    return F.pmod(F.xxhash64(F.col(activity_id).cast("bigint")), F.lit(ACTIVITY_SLOTS)).cast("int")


def existing_keys(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.select(*keys).distinct()


def landed_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Month and week partitions already on storage, from file and folder names only."""
    root = path.rstrip("/")
    folders = [p.rsplit("=", 1)[-1] for p in _hadoop_glob(spark, f"{root}/*=*") if not p.rsplit("/", 1)[-1].startswith(f"{VERSION}=")]
    files = [p.rsplit("/", 1)[-1] for p in _hadoop_glob(spark, f"{root}/*.parquet")]
    df = spark.createDataFrame([(n,) for n in folders + files], "name STRING")
    return df.select(partition_month("name").alias("month"), partition_week("name").alias("week")).distinct()
