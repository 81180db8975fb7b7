"""Inverted index and BM25 scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave import settings as S
from plotweave.functions import text as X
from plotweave.functions.scores import quantise
from plotweave.operators.rank import top_k
from plotweave.operators.vector_search import (
    HITS, MAX_BROADCAST_BYTES, BestHits, held_hits, hits_of, in_chunks, ranked_hits, state_of,
    through_chunks, with_hits)
from plotweave.scratch import discard, pin_if_small, stage, stage_at

# Asked terms (a query and a term each) that are pinned and broadcast, and their bytes.
PIN_TERMS = 500_000
PIN_TERM_BYTES = 32 << 20
# Documents of a range, for which the largest contribution of a term is known; ranges at most.
SPAN_DOCS = 32
MAX_SPANS = 1 << 20
# Rarest terms are scored first until their documents are so many times those asked for.
LEAD = 16
# Scores are rounded to six places: what a bound must be short by to be below another.
MARGIN = 2e-6
# Pairs of a document and a query scored at once, and contributions (of a posting to a query).
DENSE_PAIRS = 2_000_000
CONTRIBUTIONS = 500_000
# Queries and documents that are scored together when a batch is too large to be pinned; terms
# that are summed by a matrix product; pairs that are summed again at once; bytes of a posting.
PASS_QUERIES = 4_096
DOCUMENT_ROWS = 2_048
FREQUENT_TERMS = 256
PAIRS_AGAIN = 100_000
POSTING_BYTES = 12


def _counted(tokens: pa.Array) -> pa.Array:
    """Token count and distinct tokens with their counts, for arrays of tokens.

    The tokens of an Arrow batch are numbered once, and pairs of row and number counted.
    """
    sizes = np.diff(np.asarray(tokens.offsets))
    coded = tokens.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    rows = np.repeat(np.arange(len(tokens)), sizes)
    pairs, counts = np.unique(rows * width + np.asarray(coded.indices), return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(tokens) + 1) * width).astype(np.int32)
    terms = pa.StructArray.from_arrays(
        [coded.dictionary.take(pa.array(pairs % width)), pa.array(counts)], ["term", "tf"])
    return pa.StructArray.from_arrays(
        [pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), terms)],
        ["doc_len", "terms"])


def postings(docs: DataFrame, text: str = "combined_text") -> DataFrame:
    """(term, id, doc_len, tf) for documents (id, ``text``).

    The document length rides along, so scoring needs no join with a length table. All tokens of a
    document are in its row and are counted there: nothing is shuffled.
    """
    # explode_outer and a filter on its output: a plain explode makes Catalyst add a filter below
    # it that tokenises every text a second time.
    count = F.arrow_udf(_counted, "struct<doc_len:int,terms:array<struct<term:string,tf:bigint>>>")
    counted = docs.select("id", count(X.tokens(F.col(text))).alias("c"))
    return counted.select(
        "id", "c.doc_len", F.explode_outer("c.terms").alias("t")).filter(
        F.col("t").isNotNull()).select("t.term", "id", "doc_len", "t.tf")


def part_of_tf(avg_len: Column, k1: float = S.BM25_K1, b: float = S.BM25_B) -> Column:
    """What a posting contributes to a score for each unit of its term's weight."""
    tf = F.col("tf").cast("double")
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("doc_len") / avg_len))


def asked_postings(
    docs: DataFrame, asked: DataFrame, text: str = "combined_text", small_batch: bool = False
) -> DataFrame:
    """Postings of only the terms in ``asked``, and for each document a row without a term that
    carries its length: one pass over the texts gives both."""
    count = F.arrow_udf(_counted, "struct<doc_len:int,terms:array<struct<term:string,tf:bigint>>>")
    counted = docs.select("id", F.when(
        F.col(text).isNotNull(), count(X.tokens(F.col(text)))).alias("c"))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("term"),
                              F.lit(0).cast("bigint").alias("tf")))
    rows = counted.select("id", F.col("c.doc_len").alias("doc_len"), F.explode(
        F.concat(marker, F.coalesce("c.terms", F.array().cast(
            "array<struct<term:string,tf:bigint>>")))).alias("t")).select(
        "t.term", "id", "doc_len", "t.tf")
    wanted = asked.select("term").distinct().withColumn("wanted", F.lit(True))
    if small_batch:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "term", "left").where(
        F.col("term").isNull() | F.col("wanted")).drop("wanted")


def term_stats(index: DataFrame, avg_len: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Documents that hold a term, and the largest contribution of one of its postings for each
    unit of weight; per term, or per term and ``keys``."""
    return index.groupBy("term", *keys).agg(
        F.count(F.lit(1)).alias("df"), F.max(part_of_tf(avg_len)).alias("most"))


def span_of(ident: Column, spans: int) -> Column:
    """The range of documents that one belongs to."""
    return F.pmod(F.xxhash64(ident), F.lit(spans)).cast("int")


def span_count(docs: int) -> int:
    return max(1, min(MAX_SPANS, docs // SPAN_DOCS))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query of (query_id, query)."""
    return queries.select(
        "query_id", F.explode_outer(F.array_distinct(X.tokens(F.col("query")))).alias("term")
    ).filter(F.col("term").isNotNull())


@dataclass(frozen=True)
class LexicalIndex:
    """``postings`` (term, id, doc_len, tf) and ``terms`` (term, df, most) of ``docs`` documents;
    ``partition`` names a column derived from the term by which both are laid out. ``bounds``
    (term, span, most) holds the largest contribution within each range of documents, for frequent
    terms; a term without a row there has its own largest one."""

    postings: DataFrame
    terms: DataFrame
    docs: Column
    avg_len: Column
    bounds: DataFrame | None = None
    spans: int = 1
    partition: str | None = None


def _held(df: DataFrame, small: bool, name: str) -> DataFrame:
    """A table used several times: as a local relation to broadcast where that is certain."""
    pinned = pin_if_small(df, PIN_TERMS, PIN_TERM_BYTES) if small else None
    return stage(df, name) if pinned is None else F.broadcast(pinned.df)


def _partial_scores(index: LexicalIndex, asked: DataFrame, more: list[str]) -> DataFrame:
    """Sum of the contributions of the given (query, term) rows for each query and document;
    ``more`` are columns that only depend on the query."""
    on = ["term"] if index.partition is None else [index.partition, "term"]
    part = F.col("idf") * part_of_tf(index.avg_len)
    return index.postings.join(asked, on).groupBy("query_id", "id").agg(
        F.sum(part).alias("partial"), *[F.first(c).alias(c) for c in more])


def weighted_terms(asked: DataFrame, index: LexicalIndex, k: int, salts: int | None = None,
                   small_batch: bool = False) -> DataFrame:
    """(query_id, term, idf, optional, rest, floor) for the asked terms.

    The rarest terms of a query are scored first, as many as bring a few times ``k`` documents.
    The k-th best of these partial scores, ``floor``, is one that no document of the result can be
    below. Terms whose largest contributions together (``rest``) stay below it are ``optional``:
    a document with none of the others is not in the result.
    """
    on = ["term"] if index.partition is None else [index.partition, "term"]
    df = F.col("df")
    idf = F.log1p((index.docs - df + 0.5) / (df + 0.5))
    side = F.broadcast(asked) if small_batch else asked
    weighted = _held(index.terms.join(side, on).select(
        "query_id", *on, "df", idf.alias("idf"), (idf * F.col("most")).alias("top")),
        small_batch, "asked-terms")
    rarer = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(
        Window.unboundedPreceding, -1)
    lead = weighted.withColumn("before", F.coalesce(F.sum("df").over(rarer), F.lit(0))).where(
        F.col("before") < LEAD * k).select("query_id", *on, "idf")
    best = top_k(_partial_scores(index, F.broadcast(lead) if small_batch else lead, []),
                 ["query_id"], [F.desc("partial"), F.asc("id")], k, salts=salts)
    floors = best.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("partial") - MARGIN).alias("floor"))
    weaker = Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(
        Window.unboundedPreceding, 0)
    own = Window.partitionBy("query_id")
    return _held(
        weighted.join(floors, "query_id", "left").withColumn(
            "optional", F.coalesce(F.sum("top").over(weaker) < F.col("floor"), F.lit(False)))
        .withColumn("rest", F.sum(F.when(F.col("optional"), F.col("top")).otherwise(0.0)).over(own))
        .select("query_id", *on, "idf", "top", "optional", "rest", "floor"),
        small_batch, "weighted-terms")


def candidates(weighted: DataFrame, index: LexicalIndex, k: int,
               salts: int | None = None) -> DataFrame:
    """(query_id, id, partial): documents that can be among the best ``k``, with the sum of their
    contributions from the terms that are not optional.

    What the optional terms can add is bounded by their largest contributions in the document's
    own range. The k-th best sum of the others is a second, higher floor.
    """
    found = _partial_scores(index, weighted.where("not optional"), ["rest", "floor"])
    rest = F.col("rest")
    if index.bounds is not None:
        on = ["term"] if index.partition is None else [index.partition, "term"]
        asked = weighted.where("optional").select("query_id", *on, "idf", "top")
        # how much less than its largest anywhere a term can add in a range
        less = index.bounds.join(asked, on).groupBy("query_id", "span").agg(
            F.sum(F.col("top") - F.col("idf") * F.col("most")).alias("less"))
        found = found.withColumn("span", span_of(F.col("id"), index.spans)).join(
            less, ["query_id", "span"], "left")
        rest = rest - F.coalesce("less", F.lit(0.0))
    reach = F.col("partial") + rest
    # used twice: Spark reuses the shuffle of the sums
    kept = found.where(F.col("floor").isNull() | (reach >= F.col("floor"))).select(
        "query_id", "id", "partial", reach.alias("reach"))
    best = top_k(kept, ["query_id"], [F.desc("partial"), F.asc("id")], k, salts=salts)
    floors = best.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("partial") - MARGIN).alias("floor"))
    return kept.join(floors, "query_id").where(
        F.col("floor").isNull() | (F.col("reach") >= F.col("floor"))).select(
        "query_id", "id", "partial")


@dataclass(frozen=True)
class _Weights:
    """The asked terms of a bounded batch by term: from ``starts[t]`` up to ``starts[t + 1]`` the
    queries that ask for it and its weight there; once for needed and once for optional terms."""

    query_ids: np.ndarray
    floor: np.ndarray
    rest: np.ndarray
    terms: dict[str, int]
    needed: tuple[np.ndarray, np.ndarray, np.ndarray]
    optional: tuple[np.ndarray, np.ndarray, np.ndarray]


def _weights_of(table: pa.Table) -> _Weights:
    query_ids, query = np.unique(np.asarray(table["query_id"]), return_inverse=True)
    names = table["term"].combine_chunks().dictionary_encode()
    terms = {t: i for i, t in enumerate(names.dictionary.to_pylist())}
    code, idf = np.asarray(names.indices), np.asarray(table["idf"])
    optional = np.asarray(table["optional"])
    floor, rest = np.full(len(query_ids), -np.inf), np.zeros(len(query_ids))
    floor[query] = np.asarray(table["floor"].fill_null(float("-inf")))
    rest[query] = np.asarray(table["rest"])

    def by_term(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(code[mine], kind="stable")
        starts = np.searchsorted(code[mine][order], np.arange(len(terms) + 1))
        return starts, query[mine][order], idf[mine][order]

    return _Weights(query_ids, floor, rest, terms, by_term(~optional), by_term(optional))


def _score_rows(shared, k: int):
    """Kernel: postings (term, id, part), those of a document together, to the best hits of the
    task. Documents are scored with the needed terms first; only pairs that can still reach the
    floor get the optional terms too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        best, width = BestHits(len(w.query_ids), k), max(1, len(w.query_ids))
        most = max(1, DENSE_PAIRS // width)

        def contributions(which, code, document, part):
            starts, query, idf = which
            times = starts[code + 1] - starts[code]
            row = np.repeat(np.arange(len(code)), times)
            at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + starts[code][row]
            return document[row] * width + query[at], part[row] * idf[at]

        def score(code, ids, part) -> None:
            own, document = np.unique(ids, return_inverse=True)
            cell, value = contributions(w.needed, code, document, part)
            total = np.bincount(cell, value, len(own) * width).reshape(-1, width)
            found = (total > 0) & (total + w.rest >= w.floor)
            cell, value = contributions(w.optional, code, document, part)
            kept = found.reshape(-1)[cell]
            total += np.bincount(cell[kept], value[kept], len(own) * width).reshape(-1, width)
            total = np.round(total, S.SCORE_PLACES)
            rows, cols = np.nonzero(found & (total >= best.floor))
            best.add(cols, own[rows], total[rows, cols])
            if best.waiting > DENSE_PAIRS:
                best.settle()

        times = sum(np.diff(which[0]) for which in (w.needed, w.optional))

        def score_blocks(held, documents: np.ndarray) -> None:
            """Documents that begin at all places but the last, as many at once as are bounded."""
            sums = np.append(0, np.cumsum(times[held[0]]))[documents]
            first, last = 0, len(documents) - 1
            while first < last:
                end = int(np.searchsorted(sums, sums[first] + CONTRIBUTIONS, "right")) - 1
                end = min(max(end, first + 1), first + most, last)
                score(*(c[documents[first]:documents[end]] for c in held))
                first = end

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch["term"].dictionary_encode()
            known = np.array([w.terms.get(t, -1) for t in names.dictionary.to_pylist()], np.int64)
            new = (known[np.asarray(names.indices)], np.asarray(batch["id"]),
                   np.asarray(batch["part"]))
            held = new if held is None else tuple(map(np.concatenate, zip(held, new)))
            starts = np.flatnonzero(np.append(True, held[1][1:] != held[1][:-1]))
            score_blocks(held, starts)  # the last document may go on in the next batch
            held = tuple(c[starts[-1]:] for c in held)
        if held is not None:
            score_blocks(held, np.array([0, len(held[0])]))
        yield hits_of(w.query_ids, best)

    return run


def bm25_top_k(
    asked: DataFrame, index: LexicalIndex, k: int, salts: int | None = None,
    small_batch: bool = False,
) -> DataFrame:
    """Best ``k`` documents per query: (query_id, id, score, rank); ``asked`` is (query_id, term).

    Only documents that can reach the k-th best score are scored in full, which loses none (see
    :func:`weighted_terms`). With ``small_batch``, which says that the size of the batch was
    checked, its weights are broadcast, postings of the asked terms move once, by document, and
    documents are scored where they are. Otherwise postings of frequent terms are read only to
    complete candidates.
    """
    order = [F.desc("score"), F.asc("id")]
    on = ["term"] if index.partition is None else [index.partition, "term"]
    weighted = weighted_terms(asked, index, k, salts, small_batch)
    if small_batch:
        table = weighted.select("query_id", "term", "idf", "optional", "rest", "floor").toArrow()
        shared = asked.sparkSession.sparkContext.broadcast(_weights_of(table))
        rows = index.postings.join(
            F.broadcast(weighted.select(*on).distinct()), on, "left_semi").select(
            "term", "id", part_of_tf(index.avg_len).alias("part"))
        hits = rows.repartition("id").sortWithinPartitions("id").mapInArrow(
            _score_rows(shared, k), HITS)
        return top_k(hits, ["query_id"], order, k, salts=salts)
    found = candidates(weighted, index, k, salts)
    wanted = weighted.where("optional").select("query_id", *on, "idf")
    frequent = index.postings.join(wanted.select(*on).distinct(), on, "left_semi")
    added = found.join(wanted, "query_id", "left").join(
        frequent.select(*on, "id", part_of_tf(index.avg_len).alias("part")), [*on, "id"], "left")
    scored = added.groupBy("query_id", "id").agg(quantise(
        F.first("partial") + F.coalesce(F.sum(F.col("idf") * F.col("part")), F.lit(0.0))
    ).alias("score"))
    return top_k(scored, ["query_id"], order, k, salts=salts)


def index_of(docs: DataFrame, asked: DataFrame, text: str = "combined_text",
             small_batch: bool = False) -> LexicalIndex:
    """Postings and statistics of the asked terms alone, from one pass over the documents; bounds
    by range pay for an index that is stored."""
    held = stage(asked_postings(docs, asked, text, small_batch), "asked-postings")
    counts = held.where(F.col("term").isNull()).agg(
        F.count(F.lit(1)).alias("docs"), F.avg("doc_len").alias("avg_len")).first()
    docs_n, avg_len = F.lit(counts["docs"]), F.lit(counts["avg_len"] or 0.0)
    index = held.where(F.col("term").isNotNull())
    return LexicalIndex(index, term_stats(index, avg_len), docs_n, avg_len)


def bm25_without_index(
    queries: DataFrame, docs: DataFrame, k: int, text: str = "combined_text",
    salts: int | None = None, small_batch: bool = False,
) -> DataFrame:
    """BM25 straight from the documents, counting only the terms that are asked for.

    The terms of a ``small_batch`` are broadcast only after their own number and size were checked;
    any other batch, and one of more than ``PASS_QUERIES`` queries, meets the documents chunk by
    chunk.
    """
    asked = query_terms(queries)
    held = pin_if_small(asked, PIN_TERMS, PIN_TERM_BYTES) if small_batch else None
    if held is None or len(held.values("query_id")) > PASS_QUERIES:
        return _in_passes(asked, docs, k, text)
    return bm25_top_k(held.df, index_of(docs, held.df, text, True), k, salts, True)


def _in_passes(asked: DataFrame, docs: DataFrame, k: int, text: str) -> DataFrame:
    """A large batch: its queries lie in pieces over the tasks, and chunks of the documents, as
    numbered terms with what each adds per unit of weight, are broadcast to them one after the
    other. No pair of a document and a query is shuffled; a query keeps its best hits."""
    spark = asked.sparkSession
    asked, asked_path = stage_at(asked, "asked")
    terms = pin_if_small(asked.select("term").distinct(), PIN_TERMS, PIN_TERM_BYTES)
    rows, rows_path = stage_at(asked_postings(
        docs, asked if terms is None else terms.df, text, terms is not None), "asked-postings")
    counts = rows.where(F.col("term").isNull()).agg(
        F.count(F.lit(1)).alias("docs"), F.avg("doc_len").alias("avg_len")).first()
    rows = rows.where(F.col("term").isNotNull())
    numbered, numbered_path, total = _numbered(rows, asked, counts["docs"])
    side = F.broadcast(numbered) if terms is not None else numbered
    part = part_of_tf(F.lit(counts["avg_len"] or 0.0))
    chunks = max(1, -(-total * POSTING_BYTES // MAX_BROADCAST_BYTES))
    whole, whole_path = in_chunks(rows.join(side, "term").groupBy("id").agg(F.sort_array(
        F.collect_list(F.struct("code", part.alias("part")))).alias("t")).select(
        "id", F.col("t.code").alias("codes"), F.col("t.part").alias("parts")), chunks)
    frequent = np.array([r["code"] for r in numbered.orderBy(
        F.desc("cost"), "code").limit(FREQUENT_TERMS).collect()], np.int64)
    queries = asked.join(side, "term").groupBy("query_id").agg(
        F.collect_list(F.struct("code", "idf")).alias("t")).select(
        "query_id", F.col("t.code").alias("codes"), F.col("t.idf").alias("weights"))
    state = through_chunks(
        state_of(queries, asked.select("query_id").distinct().count()), whole, chunks,
        _documents_of, lambda shared: _meet_documents(shared, k, frequent))
    for done in (asked_path, rows_path, numbered_path, whole_path):
        discard(spark, done)
    return ranked_hits(state, k)


def _numbered(rows: DataFrame, asked: DataFrame, docs: int) -> tuple[DataFrame, str, int]:
    """(term, idf, cost, code) of the asked terms that postings have, where they are staged, and the
    number of postings. Codes count up from 0; ``cost`` is how many pairs share the term."""
    spark = rows.sparkSession
    df = F.col("df")
    terms, path = stage_at(
        rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(
            asked.groupBy("term").agg(F.count(F.lit(1)).alias("queries")), "term").select(
            "term", "df", F.log1p((F.lit(docs) - df + 0.5) / (df + 0.5)).alias("idf"),
            (df * F.col("queries")).alias("cost"), F.monotonically_increasing_id().alias("at")),
        "numbered-terms")
    piece = F.shiftright("at", 33)
    pieces = terms.groupBy(piece.alias("piece")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("df").alias("df")).orderBy("piece").toArrow()
    before = np.cumsum(np.asarray(pieces["n"])) - np.asarray(pieces["n"])
    first = spark.createDataFrame(
        pa.table({"piece": pieces["piece"], "before": pa.array(before.astype(np.int64))}))
    code = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
    held = terms.withColumn("piece", piece).join(F.broadcast(first), "piece").select(
        "term", "idf", "cost", code.alias("code"))
    return held, path, int(np.asarray(pieces["df"]).sum())


@dataclass(frozen=True)
class _Documents:
    """Documents that are broadcast at once: from ``starts[i]`` up to ``starts[i + 1]`` the codes of
    the terms of document i, upwards and each once, and their parts."""

    ids: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    parts: np.ndarray


def _documents_of(table: pa.Table) -> _Documents:
    codes = table["codes"].combine_chunks()
    starts = np.append(0, np.cumsum(np.asarray(codes.value_lengths()))).astype(np.int64)
    code = np.asarray(codes.flatten())
    part = np.asarray(table["parts"].combine_chunks().flatten())
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))[:len(code)]
    if not first.all():  # an id that comes twice has its terms twice
        part = np.add.reduceat(part, np.flatnonzero(first))
        code, row = code[first], row[first]
        starts = np.searchsorted(row, np.arange(len(starts)))
    return _Documents(np.asarray(table["id"]), starts, code, part)


def _meet_documents(shared, k: int, frequent: np.ndarray):
    """Kernel: pieces of the state to the same with the hits of one more chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = held_hits(batch, k)
                sizes = np.asarray(batch["codes"].value_lengths())
                query = np.repeat(np.arange(len(sizes)), sizes)
                code = np.asarray(batch["codes"].flatten())
                weight = np.asarray(batch["weights"].flatten())
                for first in range(0, len(sizes), PASS_QUERIES):
                    mine = (query >= first) & (query < first + PASS_QUERIES)
                    _score_chunk(best, shared.value, frequent, query[mine], code[mine],
                                 weight[mine], first, min(PASS_QUERIES, len(sizes) - first))
                yield with_hits(batch, best)

    return run


def _score_chunk(best: BestHits, docs: _Documents, frequent: np.ndarray, query: np.ndarray,
                 code: np.ndarray, weight: np.ndarray, base: int, width: int) -> None:
    """Offer the documents to the ``width`` queries from place ``base`` on.

    Sums are made in single precision: for frequent terms by a matrix product, for the others from
    the postings of the asked terms. What can reach a query's floor within the error of that is
    summed again in double.
    """
    span = int(max(docs.codes.max(initial=0), code.max(initial=0), frequent.max(initial=0))) + 1
    slot = np.full(span, -1, np.int32)  # the place of a frequent term among them
    slot[frequent] = np.arange(len(frequent))
    own = query - base
    common = slot[code] >= 0
    asked = np.zeros((width, max(1, len(frequent))), np.float32)
    np.add.at(asked, (own[common], slot[code[common]]), weight[common].astype(np.float32))
    order = np.argsort(code[~common], kind="stable")
    rare, rare_query = code[~common][order], own[~common][order]
    rare_weight = weight[~common][order].astype(np.float32)
    names, starts = np.unique(rare, return_index=True)
    starts = np.append(starts, len(rare))
    named = np.full(span, -1, np.int32)
    named[names] = np.arange(len(names))

    terms = np.argsort(own, kind="stable")  # the terms of each query, for sums in double
    ends = np.cumsum(np.bincount(own, minlength=width))
    begins = np.append(0, ends)[:-1]
    number = ends - begins
    # no part is above k1 + 1, and none of the weights is below 0
    most = np.bincount(own, weight, width) * (S.BM25_K1 + 1)
    slack = (number + 8) * float(np.finfo(np.float32).eps) * most + 1e-6

    rows = max(1, min(DOCUMENT_ROWS, DENSE_PAIRS // width))
    first = 0
    while first < len(docs.ids):
        last = min(first + rows, len(docs.ids))
        # fewer documents where these have very many terms
        bound = docs.starts[first] + CONTRIBUTIONS
        last = max(first + 1, min(last, int(np.searchsorted(docs.starts, bound, "right")) - 1))
        begin, end = docs.starts[first], docs.starts[last]
        codes, parts = docs.codes[begin:end], docs.parts[begin:end]
        document = np.repeat(np.arange(last - first), np.diff(docs.starts[first : last + 1]))
        held = np.zeros((asked.shape[1], last - first), np.float32)
        at = slot[codes]
        held[at[at >= 0], document[at >= 0]] = parts[at >= 0]
        scores = asked @ held
        flat = scores.reshape(-1)
        at = named[codes]
        met = np.flatnonzero(at >= 0)
        at = at[met]
        times = starts[at + 1] - starts[at]
        ahead = np.append(0, np.cumsum(times))
        low = 0
        while low < len(met):  # contributions that are bounded
            high = max(low + 1, int(np.searchsorted(ahead, ahead[low] + CONTRIBUTIONS, "right")) - 1)
            n = times[low:high]
            posting = np.repeat(np.arange(low, high), n)
            place = np.arange(len(posting)) + np.repeat(starts[at[low:high]] - ahead[low:high] + ahead[low], n)
            np.add.at(flat, rare_query[place] * (last - first) + document[met[posting]],
                      rare_weight[place] * parts[met[posting]].astype(np.float32))
            low = high
        floor = best.floor[base : base + width]
        if np.isneginf(floor).any() and last - first > best.k:
            local = np.partition(scores, last - first - best.k, axis=1)[:, last - first - best.k]
            floor = np.fmax(floor, local - slack)
        tried = np.maximum(floor - slack, np.finfo(np.float32).tiny).astype(np.float32)
        cells = np.flatnonzero(scores >= tried[:, None])
        for i in range(0, len(cells), PAIRS_AGAIN):
            one, row = np.divmod(cells[i : i + PAIRS_AGAIN], last - first)
            exact = _sums_again(one, row, begins, number, terms, code, weight, codes, document,
                                parts, span)
            kept = exact >= best.floor[base + one]
            best.add(base + one[kept], docs.ids[first + row[kept]], exact[kept])
        first = last


def _sums_again(one, row, begins, number, terms, code, weight, codes, document, parts, span):
    """Scores of pairs of a query and a document in double, rounded, from the query's terms."""
    n = number[one]
    pair = np.repeat(np.arange(len(one)), n)
    place = terms[np.arange(len(pair)) + np.repeat(begins[one] - np.cumsum(n) + n, n)]
    keys = document * span + codes
    wanted = row[pair] * span + code[place]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    value = np.where(keys[at] == wanted, parts[at] * weight[place], 0.0)
    return np.round(np.bincount(pair, value, len(one)), S.SCORE_PLACES)
