"""Search: hybrid retrieval, filters, re-ranking. Any number of queries is one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave import settings as S
from plotweave.functions import scores as P
from plotweave.functions import text as X
from plotweave.operators.embed import Embedder, embed
from plotweave.operators.lexical import (
    PIN_TERM_BYTES, PIN_TERMS, bm25_top_k, bm25_without_index, query_terms)
from plotweave.operators.rank import top_k
from plotweave.operators.vector_search import (
    DEFAULT_PROBES, ann_search, exact_knn, exact_knn_by_cells)
from plotweave.scratch import pin_if_small, stage
from plotweave.sources.catalogue import Catalogue, only_folders

Scorer = Callable[[Column, Column], Column]

# Batches within both bounds are pinned as a local relation and may be broadcast; larger ones
# are staged as a table and joined by shuffles.
PIN_ROWS = 20_000
PIN_BYTES = 32 << 20
# A pinned batch has at most rows * 2 * limit candidates, each a handful of numbers; the list is
# broadcast only while that product stays within this bound.
BROADCAST_CANDIDATES = 1_000_000

VECTOR_ARM, TEXT_ARM = 0, 1
OPTIONAL = {"min_year": "bigint", "max_year": "bigint", "genre": "string"}


def query_batch(queries: DataFrame) -> DataFrame:
    """Normalise a batch to (query_id, query, min_year, max_year, genre); blanks are dropped."""
    for name, kind in OPTIONAL.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    return queries.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        X.strip(F.col("query")).alias("query"),
        *[F.col(c).cast(t).alias(c) for c, t in OPTIONAL.items()],
    ).filter(F.col("query") != "")


def lexical_scorer(query: Column, passage: Column) -> Column:
    """Default pair scorer: a logit from the share of query terms found and Jaccard overlap."""

    def logit(pair: Column) -> Column:
        shared = F.size(F.array_intersect(pair["q"], pair["p"]))
        coverage = shared / F.greatest(F.size(pair["q"]), F.lit(1))
        jaccard = shared / F.greatest(F.size(F.array_union(pair["q"], pair["p"])), F.lit(1))
        return coverage * 6 + jaccard * 6 - 4

    terms = F.struct(
        F.array_distinct(X.tokens(query)).alias("q"),
        F.array_distinct(X.tokens(passage)).alias("p"))
    return X.bind(terms, logit)


def unite_arms(vector_hits: DataFrame, text_hits: DataFrame | None) -> DataFrame:
    """Candidates of both arms, (query_id, id, arm, rank); an id found twice keeps arm 0."""
    arms = vector_hits.select("query_id", "id", F.lit(VECTOR_ARM).alias("arm"), "rank")
    if text_hits is not None:
        arms = arms.unionByName(
            text_hits.select("query_id", "id", F.lit(TEXT_ARM).alias("arm"), "rank"))
    return arms


def attach_entities(hits: DataFrame, entities: DataFrame, broadcast: bool,
                    keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Look the candidates up. Only a candidate list of proven size is broadcast."""
    side = F.broadcast(hits) if broadcast else hits
    return entities.join(side, list(keys))


def first_per_text(candidates: DataFrame) -> DataFrame:
    """One candidate per query and text, told by its digest: vector arm first, then the better
    rank. The candidates are pairs of ids with a digest; their texts are looked up afterwards."""
    order = [F.asc("arm"), F.asc("rank")]
    return top_k(candidates, ["query_id", "text_digest"], order, 1, rank="_n").drop(
        "_n", "text_digest")


def apply_filters(candidates: DataFrame, batch: DataFrame) -> DataFrame:
    """Year range and genre pattern of each query, applied to what was retrieved.

    A bound excludes entities without a numeric year. The genre is a regular expression,
    searched without regard to case; empty means no filter.
    """
    year = F.col("release_year").try_cast("double")
    low, high, genre = F.col("min_year"), F.col("max_year"), F.col("q_genre")
    in_years = (
        (low.isNull() | (year >= low))
        & (high.isNull() | (year <= high))
        & ((low.isNull() & high.isNull()) | year.isNotNull())
    )
    bounds = batch.select(
        "query_id", "query", "min_year", "max_year",
        F.coalesce("genre", F.lit("")).alias("q_genre"))
    within = candidates.join(bounds, "query_id").filter(in_years)
    return with_matches(within).filter((genre == "") | F.col("matches")).drop(
        "min_year", "max_year", "q_genre", "matches")


def with_matches(candidates: DataFrame) -> DataFrame:
    """Add ``matches``: whether the pattern ``q_genre`` is found in ``genre``; null without one.

    Each different pair of a pattern and a genre is tried once, however many candidates share it.
    """
    tried = candidates.where("q_genre <> ''").select("q_genre", "genre").distinct().select(
        F.col("q_genre").alias("_pattern"), F.col("genre").alias("_genre"),
        F.regexp_like(F.col("genre"), F.concat(F.lit("(?i)"), F.col("q_genre"))).alias("matches"))
    return candidates.join(
        tried, (F.col("q_genre") == F.col("_pattern")) & (F.col("genre") == F.col("_genre")),
        "left").drop("_pattern", "_genre")


def rerank(candidates: DataFrame, scorer: Scorer = lexical_scorer,
           max_chars: int = S.RERANK_CHARS) -> DataFrame:
    """Score (query, capped passage) pairs and add ``confidence`` in (0, 1)."""
    passage = F.substring("combined_text", 1, max_chars)
    logit = scorer(F.col("query"), passage)
    return candidates.withColumn("confidence", P.quantise(P.sigmoid(logit)))


def best_results(ranked: DataFrame, num_results: int = S.NUM_RESULTS) -> DataFrame:
    order = [F.desc("confidence"), F.asc("id")]
    return top_k(ranked, ["query_id"], order, num_results)


def present_results(best: DataFrame) -> DataFrame:
    return best.select(
        "query_id", F.col("rank").alias("result_rank"), "id",
        F.col("title").alias("Title"), F.col("release_year").alias("Release Year"),
        F.col("genre").alias("Genre"), F.col("plot").alias("Plot"),
        P.percent_text(F.col("confidence")).alias("Confidence"), "confidence_score",
    )


def finish(candidates: DataFrame, batch: DataFrame, num_results: int,
           scorer: Scorer = lexical_scorer, rerank_chars: int = S.RERANK_CHARS) -> DataFrame:
    """Filters, re-ranking, top results, formatting."""
    ranked = rerank(apply_filters(candidates, batch), scorer, rerank_chars)
    best = best_results(ranked, num_results)
    return present_results(best.withColumn("confidence_score", F.col("confidence")))


def retrieve(
    batch: DataFrame, entities: DataFrame, embedder: Embedder, limit: int = S.RETRIEVAL_LIMIT,
    fulltext: bool = S.FULLTEXT, rows: int | None = None,
) -> DataFrame:
    """Hybrid candidates straight from a table of entities with vectors, without any index.

    ``rows`` is the size of a pinned batch, None for an unbounded one.
    """
    asked = embed(batch.select("query_id", "query"), "query", embedder, is_query=True)
    vector_hits = exact_knn(asked, entities, limit, embedder.dim)
    text_hits = bm25_without_index(
        batch, entities, limit, small_batch=rows is not None) if fulltext else None
    found = unite_arms(vector_hits, text_hits)
    digest = F.col("text_digest") if "text_digest" in entities.columns else X.digest(
        F.col("combined_text"))
    few = broadcastable(rows, limit)
    first = first_per_text(attach_entities(
        found, entities.select("id", digest.alias("text_digest")), few))
    wide = entities.select("id", "title", "release_year", "genre", "plot", "combined_text")
    return attach_entities(first, wide, few)


def pin(queries: DataFrame) -> tuple[DataFrame, int | None]:
    """The normalised batch held once, with its row count when it is small.

    Genre patterns are tried here, so that a faulty one is named before anything runs.
    """
    batch = query_batch(queries)
    pinned = pin_if_small(batch, PIN_ROWS, PIN_BYTES)
    held, rows = (stage(batch, "queries"), None) if pinned is None else (pinned.df, pinned.rows)
    check_patterns(held)
    return held, rows


def check_patterns(batch: DataFrame) -> None:
    """Raise a ValueError with the query and the pattern that is no regular expression. Patterns
    are compiled in tasks, each different one once; only a faulty one reaches the driver."""
    patterns = batch.filter("genre <> ''").groupBy("genre").agg(
        F.min("query_id").alias("query_id"))
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("genre"))
    wrong = patterns.where(compiled.isNull()).limit(1).collect()
    if wrong:
        raise ValueError(f"query {wrong[0]['query_id']}: genre {wrong[0]['genre']!r} is no regular "
                         "expression")


def broadcastable(rows: int | None, limit: int) -> bool:
    return rows is not None and rows * 2 * limit <= BROADCAST_CANDIDATES


def search(
    queries: DataFrame, catalogue: Catalogue, num_results: int = S.NUM_RESULTS,
    limit: int = S.RETRIEVAL_LIMIT, fulltext: bool = S.FULLTEXT, scorer: Scorer = lexical_scorer,
    probes: int = DEFAULT_PROBES, use_codes: bool = False, use_ann: bool = True,
    rerank_chars: int = S.RERANK_CHARS, by_cells: bool = False,
) -> DataFrame:
    """Answer a batch of queries (query_id, query[, min_year, max_year, genre]).

    The vector arm uses the cell index, if there is one, unless ``use_ann`` is off; ``by_cells``
    then finds the exact neighbours with its help instead of by a flat scan. Where the full-text
    index could not be built, the text arm reads the texts.

    Both arms run before the filters, which cut only what was retrieved; a narrow filter can
    therefore return fewer than ``num_results`` rows.
    """
    batch, rows = pin(queries)
    asked = embed(
        batch.select("query_id", "query"), "query", catalogue.embedder, is_query=True)
    if rows is None:
        asked = stage(asked.select("query_id", "vector"), "query-vectors")
    if use_ann and catalogue.cells is not None:
        vector_hits = ann_search(
            asked, catalogue.cells, limit, probes=probes, use_codes=use_codes)
    elif by_cells and catalogue.cells is not None:
        vector_hits = exact_knn_by_cells(asked, catalogue.cells, limit)
    else:
        vector_hits = exact_knn(asked, catalogue.entities, limit, catalogue.embedder.dim)

    text_hits = None
    if fulltext and catalogue.meta["fulltext"]:
        text_hits = _stored_text_hits(batch, catalogue, limit, rows is not None)
    elif fulltext and catalogue.meta["fulltext_error"]:  # asked for, but without an index
        text_hits = bm25_without_index(
            batch, catalogue.entities, limit, small_batch=rows is not None)
    found = unite_arms(vector_hits, text_hits).withColumn(
        "shard", catalogue.shard_of(F.col("id")))
    bound = rows * 2 * limit if broadcastable(rows, limit) else None
    first = first_per_text(look_up(found, catalogue, ("id", "text_digest"), bound))
    candidates = look_up(
        first, catalogue, ("id", "title", "release_year", "genre", "plot", "combined_text"), bound)
    return finish(candidates, batch, num_results, scorer, rerank_chars)


def _stored_text_hits(batch: DataFrame, catalogue: Catalogue, limit: int, small: bool):
    asked = query_terms(batch).withColumn("bucket", catalogue.bucket_of(F.col("term")))
    index = catalogue.lexical
    pinned = pin_if_small(asked, PIN_TERMS, PIN_TERM_BYTES) if small else None
    if pinned is not None:
        asked, buckets = pinned.df, pinned.values("bucket")
        index = replace(index, **{name: only_folders(getattr(index, name), "bucket", buckets)
                                  for name in ("postings", "terms", "bounds")})
    return bm25_top_k(asked, index, limit, small_batch=pinned is not None)


def look_up(hits: DataFrame, catalogue: Catalogue, columns: tuple[str, ...],
            max_rows: int | None, keys: tuple[str, ...] = ("shard", "id")) -> DataFrame:
    """Stored columns of the hits, which carry the ``keys``.

    A list with a proven bound is pinned first: then only its shards are read, and it is
    broadcast to them. Without a bound this is an ordinary join.
    """
    stored = catalogue.entities.select("shard", *columns)
    pinned = None if max_rows is None else pin_if_small(hits, max_rows, PIN_BYTES * 2)
    if pinned is None:
        return attach_entities(hits, stored, False, keys)
    stored = only_folders(stored, "shard", pinned.values("shard"))
    return attach_entities(pinned.df, stored, True, keys)
