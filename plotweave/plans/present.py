"""Result cards and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave import settings as S
from plotweave.functions.scores import percent_value


def result_cards(results: DataFrame) -> DataFrame:
    """Card texts for rows of a search or a similar result."""
    shown = next((c for c in ("Confidence", "Similarity") if c in results.columns), None)
    match = F.coalesce(F.col(shown) if shown else F.lit(""), F.lit(""))
    title = F.coalesce(F.col("Title"), F.lit(S.UNKNOWN))
    year = F.coalesce(F.col("`Release Year`"), F.lit(S.UNKNOWN))
    plot = F.coalesce(F.col("Plot"), F.lit(""))
    genre = F.coalesce(F.col("Genre"), F.lit(S.UNKNOWN))
    meta = F.concat_ws(
        "  ·  ",
        F.when(~genre.isin("", S.UNKNOWN), F.concat(F.lit("Genre: "), genre)),
        F.when(match != "", F.concat(F.lit("Match: "), match)),
    )
    preview = F.when(
        F.length(plot) > S.PREVIEW_CHARS,
        F.concat(F.substring(plot, 1, S.PREVIEW_CHARS), F.lit("…"))).otherwise(plot)
    keep = [c for c in ("query_id", "result_rank", "id") if c in results.columns]
    return results.select(
        *keep, title.alias("title"), year.alias("year"), plot.alias("plot"),
        genre.alias("genre"), match.alias("confidence"), percent_value(match).alias("sim"),
        F.concat(title, F.lit(" ("), year, F.lit(")")).alias("label"),
        preview.alias("preview"),
        F.when(meta != "", meta).otherwise(F.concat(F.lit("Year: "), year)).alias("meta"),
        F.when(plot != "", plot).otherwise("No plot available.").alias("body"),
    )


def paged(results: DataFrame, page: int | None = None, page_size: int = S.PAGE_SIZE,
          max_pages: int = S.MAX_PAGES) -> DataFrame:
    """Add ``page`` (from 0) to ranked results, at most ``max_pages`` of ``page_size``; or keep one
    page."""
    number = F.floor((F.col("result_rank") - 1) / page_size).cast("int")
    shown = results.filter(F.col("result_rank") <= page_size * max_pages).withColumn("page", number)
    return shown if page is None else shown.filter(F.col("page") == page)


def page_counts(queries: DataFrame, results: DataFrame, page_size: int = S.PAGE_SIZE,
                max_pages: int = S.MAX_PAGES) -> DataFrame:
    """Pages per query: at least one, at most ``max_pages``."""
    counted = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    pages = F.greatest(
        F.lit(1), F.least(F.lit(max_pages), F.ceil(F.coalesce("n", F.lit(0)) / page_size)))
    return queries.select("query_id").join(counted, "query_id", "left").select(
        "query_id", pages.cast("int").alias("pages"))
