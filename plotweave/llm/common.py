"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.scratch import scratch_path

#: A run of anything but the ASCII white space characters (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read again, and where it lies.

    The file outlives lost executors, cuts the lineage and is pruned by column.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` bears it in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def remainder(doc_id: Column, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def in_chunks(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of about ``most`` characters, each with its first index.

    A longer text is a run of its own, so no text is ever cut.
    """
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def code_points(texts: list[str], gap: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts as code points with one ``gap`` before each and after the last.

    The second array holds where each text's gap stands, and last the final gap's position.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = gap + gap.join(texts) + gap
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(sizes)))
