"""What the corpus operators share: reading, shared storage, global order, safe column handling."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to ask for
    _libc = None
_made: list[str] = []
_marked: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has; Spark's names have no case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """A column by its very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    """Spark's own file system for a path, and the path as it takes it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir; it goes when the driver
    ends. Where the setting is missing, a local folder takes its place if driver and executors are one process; on a
    cluster that is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}/termini-shared-{os.getpid()}"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    own = f"{folder.rstrip('/')}/{context.applicationId}"
    if own not in _marked:
        files, path = _file_system(spark, own)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(own)
    return own


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> int:
    """How many paths fresh_path has given so far."""
    return len(_made)


def clear(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes what was written to the paths that fresh_path gave after the first `since`, but for those to keep."""
    for path in _made[since:]:
        if path not in keep:
            delete(spark, path)
    _made[since:] = keep


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage through Spark's own file system layer."""
    files, path = _file_system(spark, path)
    files.delete(path, True)


def chained(keys: DataFrame, order: list[str], carry: str | None = None) -> DataFrame:
    """keys with its successor in the ascending order of the order columns (nulls first; the last row's successor is the
    first row) as struct `succ`, and with `before`, the sum of the column carry over all earlier rows.

    The global order comes from a range partition; only one row per partition meets in one task, so nothing grows with
    the rows. The partition numbers are stored, since a range partition may fall differently when computed again."""
    spark = keys.sparkSession
    ranged = keys.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).withColumn("_pid", F.spark_partition_id())
    ranged = stored(ranged, "order")
    row = F.struct(*order, *[c for c in keys.columns if c not in order])
    amount = F.col(carry).cast("long") if carry else F.lit(0).cast("long")
    ends = ranged.groupBy("_pid").agg(F.min(row).alias("_first"), F.sum(amount).alias("_sum"))
    along = W.orderBy("_pid")
    ends = ends.select(
        "_pid",
        F.coalesce(F.lead("_first").over(along), F.min("_first").over(along)).alias("_next"),
        (F.sum("_sum").over(along) - F.col("_sum")).alias("_base"),
    )  # a row per partition: bounded by the number of shuffle partitions
    inside = W.partitionBy("_pid").orderBy(*[F.asc_nulls_first(c) for c in order])
    return (
        ranged.select(
            "*",
            F.lead(row).over(inside).alias("_lead"),
            F.coalesce(F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_within"),
        )
        .join(F.broadcast(ends), "_pid")
        .select(*keys.columns, F.coalesce("_lead", "_next").alias("succ"), (F.col("_base") + F.col("_within")).alias("before"))
    )


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def give_back() -> None:
    """Returns memory that a Python worker no longer uses to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)
