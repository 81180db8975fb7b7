"""Intermediate tables that survive the loss of an executor, and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}


def use_local_folder(spark: SparkSession) -> None:
    """Name a temporary folder where ``spark.checkpoint.dir`` is unset: tests, bench, entry.

    Only for a driver that is its own executor; anywhere else the setting is required.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or not re.fullmatch(
            r"local(\[[^]]*\])?", context.master):
        return
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="plotweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    folder = _LOCAL_FOLDERS.get(spark.sparkContext.applicationId)
    if folder is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_folder(spark)}/plotweave/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results not yet read are lost with
    them, stored catalogues are not."""
    discard(spark, scratch_folder(spark))


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as a Parquet table in the shared folder; the table and its path.

    The copy cuts the lineage, prunes columns for every later reader and carries file sizes,
    from which Catalyst decides whether a side is small enough to broadcast.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """As :func:`stage_at`, for a table that lives as long as the application."""
    return stage_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing will read again."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input that comes in fewer pieces than there are cores.

    One large unsplittable file or a small table would otherwise keep one task busy. An input
    with enough partitions is returned as it is, so big tables are not shuffled for this. Only
    for scans: counting the partitions of a plan with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


class Pinned(NamedTuple):
    """A result held as a local relation, with the driver's copy of its rows."""

    df: DataFrame
    table: pa.Table

    @property
    def rows(self) -> int:
        return self.table.num_rows

    def values(self, column: str) -> list:
        """Distinct values of a column."""
        return self.table[column].unique().to_pylist()


def pin_if_small(df: DataFrame, max_rows: int, max_bytes: int) -> Pinned | None:
    """``df`` as a local relation, or None above either bound."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return None
    return Pinned(df.sparkSession.createDataFrame(table, schema=df.schema), table)
