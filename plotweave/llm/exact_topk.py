"""Exact top-k inner products by a three-phase uniform threshold.

A vector's score is the sum of its scores over ``lists`` slices of the components. Whoever
reaches a total of t has at least t / lists in one slice: a uniform threshold for every list.

1. Every task ranks each slice's scores and sends the totals of each list's leaders. The k-th best
   total met so far is a cutoff that no answer lies below.
2. The cutoffs go back to all tasks; each collects the entries at or above cutoff / lists in some
   slice and drops those whose upper bound is below the cutoff.
3. The missing slices of what remains are scored exactly, and entries at or above the cutoff are
   sent and ranked.

Queries come in chunks of bounded size, each broadcast; the candidates are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from plotweave.llm.common import staged

#: Scores held at once by a task: queries of a chunk times candidates of a block.
BLOCK_SCORES = 1 << 21


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null for a null vector or one with a component that
    is null or not finite. What passes 31 bits is held there, beyond what top_k accepts."""
    most = 2.0 ** 31
    wide = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(
        F.lit(most), F.lit(float(scale)) * x.cast("double")))))
    fits = F.forall(vector, lambda x: x.isNotNull() & (
        F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(fits, wide)


def _padded(vectors: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of equal width; a shorter vector goes on with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), np.int64)
    if len(values) == out.size:
        out[:] = values.reshape(out.shape)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row, np.arange(len(values)) - first] = values
    return out.astype(kind)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, kind: str, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield (part["vec_id"].to_numpy(zero_copy_only=False),
                   _padded(part["vector"], width, kind))


def _sent(query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int32()), pa.array(ids, pa.int64()),
         pa.array(scores.astype(np.int64), pa.int64())], ["query", "vec_id", "score"])


def _best(total: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int):
    """Row and column of the k best allowed entries of each row, ties to the smaller id."""
    rows, cols = np.nonzero(allowed)
    if not len(rows):
        return rows, cols
    order = np.lexsort((ids[cols], -total[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


class _Chunk:
    """A chunk of queries as every task sees it."""

    def __init__(self, ids, vectors, cuts, k: int, lists: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.slices = [s for s in np.array_split(np.arange(vectors.shape[1]), lists) if len(s)]
        self.cuts = cuts

    def leaders(self, ids, block):
        """Phase 1: totals of the k leaders of every list."""
        other = self.ids[:, None] != ids[None, :]
        total = np.zeros(other.shape, self.vectors.dtype)
        led = np.zeros(other.shape, bool)
        for s in self.slices:
            part = self.vectors[:, s] @ block[:, s].T
            total += part
            ranked = np.where(other, part, part.min() - 1)
            k = min(self.k, ranked.shape[1])
            top = np.argpartition(ranked, -k, axis=1)[:, -k:]
            np.put_along_axis(led, top, True, axis=1)
        if not self.slices:
            led[:, :] = True
        return total, *_best(total, ids, led & other, self.k)

    def answers(self, ids, block):
        """Phases 2 and 3: entries that may reach the cutoff, resolved exactly."""
        other = self.ids[:, None] != ids[None, :]
        m = max(1, len(self.slices))
        uniform = -((-self.cuts) // m)  # an entry below it in all lists is below the cutoff
        met = np.zeros(other.shape, bool)
        upper = np.zeros(other.shape, self.vectors.dtype)
        parts = []
        for s in self.slices:
            part = self.vectors[:, s] @ block[:, s].T
            over = part >= uniform[:, None]
            met |= over
            upper += np.where(over, part, uniform[:, None])
            parts.append(part)
        if not self.slices:
            met[:, :] = True
        rows, cols = np.nonzero(met & other & (upper >= self.cuts[:, None]))
        exact = sum((p[rows, cols] for p in parts), np.zeros(len(rows), self.vectors.dtype))
        enough = exact >= self.cuts[rows]
        rows, cols, exact = rows[enough], cols[enough], exact[enough]
        total = np.full(other.shape, 0, self.vectors.dtype)
        total[rows, cols] = exact
        allowed = np.zeros(other.shape, bool)
        allowed[rows, cols] = True
        return total, *_best(total, ids, allowed, self.k)


class _Running:
    """The k best entries of each query among the blocks a task has seen."""

    def __init__(self, k: int):
        self.k, self.kept, self.size = k, [], 0

    def add(self, rows, ids, scores) -> None:
        self.kept.append((rows, ids, scores))
        self.size += len(rows)
        if self.size > 1 << 20:
            self.trim()

    def trim(self):
        rows, ids, scores = (np.concatenate(c) for c in zip(*self.kept)) if self.kept else (
            np.zeros(0, np.int64),) * 3
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < self.k
        self.kept = [(rows[keep], ids[keep], scores[keep])]
        self.size = int(keep.sum())
        return self.kept[0]


_ENTRY = "query int, vec_id long, score long"


def _scan(candidates: DataFrame, chunk, width: int, kind: str, phase: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk.value
        running = _Running(own.k)
        rows = max(1, BLOCK_SCORES // max(1, len(own.ids)))
        for ids, block in _blocks(batches, width, kind, rows):
            total, r, c = getattr(own, phase)(ids, block)
            running.add(r, ids[c], total[r, c].astype(np.int64))
        yield _sent(*running.trim())

    return candidates.mapInArrow(run, _ENTRY)


def top_k(vectors: DataFrame, is_query: Column, k: int, lists: int = 2, chunk_rows: int = 4096,
          chunk_bytes: int = 16 << 20, scale: float = 64.0,
          vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best inner products.

    Components are floored after scaling, so scores are integers and exact. ``is_query`` is a
    condition on the rows of ``vectors``; a query meets every row with another id, ties go to the
    smaller id. All its hits are returned if there are fewer than k.

    Rows with a null id or vector, or a component that is null or not finite, take no part; one that
    passes 31 bits after scaling raises a ValueError. A shorter vector counts as one that goes on with zeros. A repeated row
    is a row of its own: as a candidate it takes a rank of its own, as a query it is answered again.
    An empty table, or one without queries, gives an empty result. A score that could pass 63 bits
    raises a ValueError.

    Of the queries ``chunk_rows`` at most, and no more than ``chunk_bytes``, are broadcast at a
    time; each chunk reads the candidates twice and shuffles at most k entries a query and task.
    """
    spark = vectors.sparkSession
    plain = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        quantised(F.col(f"`{vector}`"), scale).alias("vector"),
        is_query.alias("is_query")).where("vec_id is not null and vector is not null")
    whole, _ = staged(plain, "topk-vectors")
    width, largest, asked = whole.select(
        F.max(F.size("vector")),
        F.max(F.array_max(F.transform("vector", F.abs))),
        F.sum(F.col("is_query").cast("int"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not asked:
        return spark.createDataFrame([], schema)
    bound = int(width) * int(largest or 0) ** 2
    if bound >= 1 << 62:
        raise ValueError("scores may pass 63 bits: use a smaller scale")
    kind = "float32" if bound < 1 << 23 else "float64" if bound < 1 << 52 else "int64"
    rows = max(1, min(chunk_rows, chunk_bytes // (8 * max(1, int(width)))))
    chunks = -(-int(asked) // rows)
    # Dealt at random: a chunk has about ``rows`` queries, hot ids and ties included.
    queries, _ = staged(
        whole.where("is_query").select("vec_id", "vector").withColumn("chunk", F.floor(
            F.rand(7) * chunks).cast("int")).repartition("chunk"), "topk-queries")
    candidates = whole.select("vec_id", "vector")
    results = []
    for number in range(chunks):
        asked_now = queries.where(F.col("chunk") == number).select("vec_id", "vector").toArrow()
        if not asked_now.num_rows:
            continue
        ids = asked_now["vec_id"].to_numpy()
        held = _padded(asked_now["vector"].combine_chunks(), int(width), kind)
        results.append(_answer(spark, candidates, ids, held, k, lists, int(width), kind))
    return spark.read.schema(schema).parquet(*results)


def _answer(spark, candidates, ids, held, k, lists, width, kind) -> str:
    """One chunk through the three phases; where its ranked hits are staged."""
    first = spark.sparkContext.broadcast(_Chunk(ids, held, None, k, lists))
    heads = _scan(candidates, first, width, kind, "leaders")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = heads.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    # A query with fewer than k other rows has no k-th total: nothing is cut for it.
    found = kth.select("query", "score").toArrow()
    floor = np.iinfo(np.int64).min // 4 if kind == "int64" else -(2.0 ** 52)
    cuts = np.full(len(ids), floor, np.int64 if kind == "int64" else np.float64)
    cuts[found["query"].to_numpy()] = found["score"].to_numpy()
    second = spark.sparkContext.broadcast(_Chunk(ids, held, cuts, k, lists))
    hits = _scan(candidates, second, width, kind, "answers")
    names = spark.createDataFrame(pa.table({
        "query": pa.array(np.arange(len(ids)), pa.int32()), "query_id": pa.array(ids)}))
    ranked = hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    _, path = staged(ranked.join(F.broadcast(names), "query").select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score"), "topk-hits")
    first.unpersist()
    second.unpersist()
    return path
