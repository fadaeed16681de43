"""A numbered pointer beside a table: which of its written versions count.

A version is written in full before anything points to it. Committing is one rename of a small
file to the next number, which fails if another writer has taken that number; so readers see
the state before or after, whatever is lost in between, and of two writers one has to look again. It is
as atomic as the file system's rename to a name that must not exist.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_pointer"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a name in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def read(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the newest pointer; (0, None) before the first."""
    fs, at = hadoop(spark, f"{path.rstrip('/')}/{FOLDER}")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return 0, None
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(at, f"{max(numbers):012d}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return max(numbers), json.loads(text)


def swap(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Point to ``content``, if ``number`` is still the newest; whether it was."""
    folder = f"{path.rstrip('/')}/{FOLDER}"
    classes = spark._jvm.org.apache.hadoop.fs
    fs, draft = hadoop(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    context = classes.FileContext.getFileContext(draft.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(classes, "Options$Rename"), 0)
    try:
        context.rename(draft, classes.Path(f"{folder}/{number + 1:012d}"), no_overwrite)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    return True


def forget(spark: SparkSession, path: str, before: int) -> None:
    """Drop pointers with numbers below ``before``."""
    fs, at = hadoop(spark, f"{path.rstrip('/')}/{FOLDER}")
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.isdigit() and int(name) < before:
            fs.delete(status.getPath(), False)


def remove(spark: SparkSession, folder: str) -> None:
    fs, at = hadoop(spark, folder)
    fs.delete(at, True)
