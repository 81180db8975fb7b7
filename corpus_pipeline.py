"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import language_id, mixing, packing, quality_rules, simhash
from plotweave.llm.common import remainder, staged, table
from plotweave.scratch import use_local_folder
from plotweave.ship import ship_package

#: Language identification learns from trained weights; SQL cannot express it.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    use_local_folder(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep (operator 2)."""
    _ready(spark)
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told (operator 9)."""
    _ready(spark)
    return language_id.keep_documents(docs, remainder(F.col("doc_id"), 4) != 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class (operator 4)."""
    _ready(spark)
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens come as near to the source, language and topic weights as its size
    allows (operator 3); ``mixing.shares`` says how near."""
    _ready(spark)
    return mixing.sample_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and the sequences they are in (operator 1)."""
    _ready(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
