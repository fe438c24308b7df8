"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local sessions have one of their own."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return given or _own_folder()


#: With this, Spark removes the shuffle files of an action when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_PATHS: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def _on_disk(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage and survives lost executors.

    The shuffle files that it took go with the action that wrote it, as nothing after it reads them. The
    table itself goes when the session ends, or earlier by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    folder, at = _on_disk(spark, path)
    folder.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that `stored` returned and that nothing will read again."""
    folder, at = _on_disk(df.sparkSession, _PATHS.pop(df))
    folder.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def row_key(text: Column) -> Column:
    """With the id, tells rows apart that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
