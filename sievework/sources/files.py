"""Tables that readers see whole: written aside, then renamed into place through Hadoop's file systems."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_STAGED = "_staged-"  # a name that Spark's readers skip


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what is published in a folder; none where the folder isn't there."""
    where, fs = _path(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in found if not n.startswith(("_", ".")))


def publish(spark: SparkSession, folder: str, name: str, write: Callable[[str], None]) -> bool:
    """Has `write` fill a folder aside and renames it to folder/name; False, with nothing changed, if that is there already.

    Readers see all of it or nothing: a writer that dies leaves a staged folder that nobody reads, and of two
    writers of one name the first to finish wins.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final, fs = _path(spark, f"{folder}/{name}")
    if fs.exists(final):
        return False
    staged, _ = _path(spark, f"{folder}/{_STAGED}{uuid.uuid4().hex}")
    try:
        write(str(staged))
        none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), conf)
        context.rename(fs.makeQualified(staged), fs.makeQualified(final), none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        fs.delete(staged, True)


def write_batch(df: DataFrame, folder: str, batch: int) -> bool:
    """Adds a batch to a table of batches, once: the same number again changes nothing and gives False."""
    return publish(df.sparkSession, folder, f"batch={batch:012d}", lambda path: df.write.parquet(path))


def read_batches(spark: SparkSession, folder: str, schema: str, last_only: bool = False) -> DataFrame:
    """All batches that are there, or the newest one alone; an empty table without any."""
    there = [n for n in names(spark, folder) if re.fullmatch(r"batch=\d{12}", n)]
    there = there[-1:] if last_only else there
    return spark.read.schema(schema).parquet(*(f"{folder}/{n}" for n in there)) if there else spark.createDataFrame([], schema)


def replace_table(df: DataFrame, folder: str) -> None:
    """Makes df what `read_batches(..., last_only=True)` reads from folder; older versions stay for those that read them still."""
    version = 0
    while not write_batch(df, folder, version):
        last = [n for n in names(df.sparkSession, folder) if re.fullmatch(r"batch=\d{12}", n)][-1]
        version = int(last.removeprefix("batch=")) + 1
