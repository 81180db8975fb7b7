"""Catalogue build: sources to a stored, indexed catalogue."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plotweave import settings as S
from plotweave.functions import text as X
from plotweave.operators.embed import Embedder, embed, hashed_words
from plotweave.operators.merge import KEY, merge_entities, merge_plots_in_parts, with_keys
from plotweave.operators.prepare import canonicalise, newest_n, quality_gate, union_sources
from plotweave.scratch import discard, spread, stage_at
from plotweave.sources import catalogue as C
from plotweave.sources.specs import SourceSpec, read_numbered

COLUMNS = ("id", "title", "release_year", "genre", "plot", "cast", "director", "keywords")


@dataclass(frozen=True)
class SourceReport:
    name: str
    rows: int
    dropped: int
    kept: int


@dataclass(frozen=True)
class BuildReport:
    rows: int
    ann: bool
    fulltext: bool
    sources: tuple[SourceReport, ...]
    ann_error: str | None = None
    fulltext_error: str | None = None


def stage_source(
    spark: SparkSession, spec: SourceSpec, src_rank: int, min_plot_chars: int,
    table: DataFrame | None = None, done_with: list[str] | None = None,
) -> tuple[DataFrame, SourceReport]:
    """Scan, map and gate one source into a staged Parquet table, then cut it to the newest N.

    Where that table lies is added to ``done_with``, for a caller who deletes it after use.

    The text file is parsed once; the cut reads only two narrow columns of the staged copy.
    """
    raw = read_numbered(spark, spec) if table is None else table
    seen = Observation(f"gate-{src_rank}")
    rows = canonicalise(raw, spec, src_rank)
    if table is None:
        rows = spread(rows, "src_ord")
    staged, path = stage_at(quality_gate(rows, min_plot_chars, seen), "source")
    if done_with is not None:
        done_with.append(path)
    counts = seen.get
    passed = counts["rows"] - counts["dropped"]
    kept = passed
    if spec.limit_newest is not None:
        staged = newest_n(staged, spec.limit_newest)
        kept = min(passed, max(0, spec.limit_newest))
    return staged, SourceReport(spec.name, counts["rows"], counts["dropped"], kept)


def entity_texts(merged: DataFrame, max_plot_chars: int = S.EMBED_PLOT_CHARS,
                 more: Sequence[str] = ()) -> DataFrame:
    """Merged entities with their searchable text, and ``more`` of their columns."""
    text = X.combined_text(
        *[F.col(c) for c in ("title", "release_year", "genre", "cast", "director", "keywords",
                             "plot")],
        max_plot_chars=max_plot_chars)
    return merged.select(
        *COLUMNS, text.alias("combined_text"), *[c for c in more if c not in COLUMNS])


def build_catalogue(
    spark: SparkSession, sources: list[SourceSpec], path: str,
    embedder: Embedder | None = None, threshold: float = S.DUPLICATE_THRESHOLD,
    min_plot_chars: int = S.MIN_PLOT_CHARS, fulltext: bool = S.FULLTEXT,
    sub_vectors: int | None = None, cells: int | None = None,
    tables: dict[str, DataFrame] | None = None, max_plot_chars: int = S.EMBED_PLOT_CHARS,
    max_terms: int = S.MAX_TERMS, index_min_rows: int = S.INDEX_MIN_ROWS,
    require_indexes: bool = False,
) -> BuildReport:
    """Build or rebuild the catalogue at ``path``.

    A vector index is built from ``index_min_rows`` entities on. An index that cannot be built is
    left out: the reason is warned of, stored and reported, and searches find the same without it
    (by a flat scan in place of the vector index, from the texts in place of the full-text index).
    With ``require_indexes`` the build fails instead.

    ``tables`` gives ready DataFrames for sources by name in place of their CSV files. A build
    writes a version of its own and publishes it when it is finished: until then, and if it
    fails, the version before is opened.
    """
    embedder = embedder or hashed_words()
    catalogue, path = path.rstrip("/"), C.new_version(path.rstrip("/"))
    try:
        report = _build_version(
            spark, sources, path, embedder, threshold, min_plot_chars, fulltext, sub_vectors,
            cells, tables, max_plot_chars, max_terms, index_min_rows, require_indexes)
    except BaseException:
        discard(spark, path)
        raise
    C.publish(spark, catalogue, path)
    return report


def _build_version(spark, sources, path, embedder, threshold, min_plot_chars, fulltext,
                   sub_vectors, cells, tables, max_plot_chars, max_terms, index_min_rows,
                   require_indexes) -> BuildReport:

    tables = tables or {}
    done_with: list[str] = []
    staged = [
        stage_source(spark, spec, rank, min_plot_chars, tables.get(spec.name), done_with)
        for rank, spec in enumerate(sources)
    ]
    rows = with_keys(union_sources([table for table, _ in staged]))
    plots, parts = merge_plots_in_parts(rows, embedder, threshold)
    merged = merge_entities(rows, embedder, max_terms=max_terms, plots=plots)
    texts, texts_path = stage_at(entity_texts(merged, max_plot_chars, KEY), "entities")
    total = texts.count()
    shards = C.shard_count(total)
    stored = texts.drop("title_key").withColumn("text_digest", X.digest(F.col("combined_text")))
    C.write_entities(embed(spread(stored, "id"), "combined_text", embedder), path, shards)
    if parts is not None:
        texts.select("id", *KEY).join(parts, KEY).select("id", "part", "plot").repartitionByRange(
            "id", "part").sortWithinPartitions("id", "part").write.parquet(f"{path}/plot_parts")

    for staged_path in (*done_with, texts_path):
        discard(spark, staged_path)

    entities = spark.read.parquet(f"{path}/entities")
    title_buckets = C.write_titles(entities, path, total)
    ann, ann_error = _best_effort(lambda: C.write_cells(
        entities, path, embedder, sub_vectors or C.default_sub_vectors(embedder.dim), cells,
        index_min_rows), "vector index", require_indexes)
    text_meta, text_error = _best_effort(
        lambda: C.write_fulltext(entities, path, total) if fulltext else None,
        "full-text index", require_indexes)
    C.write_meta(spark, path, {
        "embedder": embedder.name, "dim": embedder.dim, "rows": total, "shards": shards,
        "ann": bool(ann), "fulltext": text_meta is not None, "title_buckets": title_buckets,
        "plot_parts": parts is not None, "ann_error": ann_error, "fulltext_error": text_error, **(text_meta or {}),
    })
    return BuildReport(total, bool(ann), text_meta is not None,
                       tuple(report for _, report in staged), ann_error, text_error)


def _best_effort(build, name: str, required: bool):
    """What ``build`` returns and no reason, or nothing and the reason why it failed, which is also
    warned of; where the index is ``required``, its failure is that of the caller."""
    try:
        return build(), None
    except Exception as error:  # whatever hinders an index, the catalogue answers without it
        if required:
            raise
        reason = f"{type(error).__name__}: {error}"[:2000]
        warnings.warn(f"the {name} could not be built: {reason}", RuntimeWarning, stacklevel=2)
        return None, reason
