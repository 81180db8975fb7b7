"""Top-k per key with a total order."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PARALLELISM_FOR_SALTS = 64


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
    rank: str = "rank", salts: int | None = None,
) -> DataFrame:
    """First ``k`` rows per key in ``order``, numbered from 1 in column ``rank``.

    Catalyst turns the rank filter into a group limit before the shuffle, so a map task sends at
    most ``k`` rows per key. On a large cluster even that is many rows for one hot key, so the
    map tasks are first merged in ``salts`` groups, and one task sees ``salts * k`` rows.
    """
    if salts is None:
        width = df.sparkSession.sparkContext.defaultParallelism
        salts = isqrt(width) if width > _PARALLELISM_FOR_SALTS else 1
    if salts > 1:
        partial = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.spark_partition_id() % salts)
            .withColumn(rank, F.row_number().over(partial))
            .filter(F.col(rank) <= k)
            .drop("_salt", rank)
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)
