"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import WORD, staged


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths in tokens and what a sequence of each costs.

    The cost of a length is overhead + length + length² / attention: a fixed part for each
    sequence, a linear one, and that of attending to all of it. ``block`` is the number of pieces
    that are packed together; ``separator`` tokens follow each piece.
    """

    sizes: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    overhead: float = 32.0
    attention: float = 65536.0
    separator: int = 1
    block: int = 50_000

    def cost(self, size: int) -> float:
        return self.overhead + size + size * size / self.attention


def best_fit(sizes: np.ndarray, lengths: Lengths, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """A bin for every piece, and the capacity at which each bin was opened.

    Pieces come from large to small. Each goes to the open bin with the least room that still
    holds it. If none does, a bin is opened: of the permitted lengths up to ``largest`` (or the
    least that holds the piece) that with the least cost per token it can still be filled with.

    Open bins lie in stacks by room, and the set bits of one integer say which stacks hold any.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    capacities: list[int] = []
    stacks: dict[int, list[int]] = {}
    rooms = 0
    left = int(sizes.sum())
    permitted = sorted(lengths.sizes)
    costs = {s: lengths.cost(s) for s in permitted}
    for i in order.tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            able = [s for s in permitted if s >= size]
            able = [s for s in able if s <= largest] or able[:1]
            room = min(able, key=lambda s: (costs[s] / min(s, left), s))
            own = len(capacities)
            capacities.append(room)
        bins[i] = own
        left -= size
        room -= size
        if room:
            stacks.setdefault(room, []).append(own)
            rooms |= 1 << room
    return bins, np.array(capacities, np.int64)


def pack(sizes: np.ndarray, lengths: Lengths) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, final length of each bin).

    Packs once with every permitted length as the largest to open, lets each bin shrink to the
    least permitted length that holds its contents, and takes the packing with the least total
    cost (of equals the one with longer sequences).
    """
    permitted = np.array(sorted(lengths.sizes))
    costs = np.array([lengths.cost(int(s)) for s in permitted])
    best = None
    for largest in permitted[::-1].tolist():
        bins, opened = best_fit(sizes, lengths, largest)
        filled = np.bincount(bins, weights=sizes, minlength=len(opened)).astype(np.int64)
        fits = np.searchsorted(permitted, filled)
        cost = float(costs[fits].sum())
        if best is None or cost < best[0] - 1e-9:
            best = cost, bins, permitted[fits]
    return best[1], best[2]


def words(text: Column) -> Column:
    """Token count of the default: words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


#: Copies of one row that are numbered by one task at a time.
COPIES_A_RUN = 10_000

PACKED = ("doc_id", "part", "n_parts", "first_token", "n_tokens", "bin_id", "bin_length",
          "bin_tokens", "place")


def _numbered(alike: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says, numbered from 0 in ``copy``.

    Rows with many copies are first cut into runs, which are dealt out to all tasks.
    """
    size = F.lit(COPIES_A_RUN).cast("long")
    few = alike.where(F.col("copies") <= size).withColumn("run", F.lit(0).cast("long"))
    many = alike.where(F.col("copies") > size).withColumn("run", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / size)))).repartition(
        "doc_id", "mark", "run")
    first = F.col("run") * size
    return few.unionByName(many).withColumn("copy", F.explode(F.sequence(
        first, F.least(F.col("copies"), first + size) - 1)))


def pack_documents(docs: DataFrame, tokens: Column | None = None, lengths: Lengths = Lengths(),
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces with the sequence they are in.

    Returns doc_id, part (from 0) of n_parts, first_token and n_tokens of the piece, bin_id,
    bin_length (a permitted length), bin_tokens (its contents, separators included) and place
    (from 0) within the bin. ``tokens`` counts a document's tokens, by default its words.

    A document longer than the largest length less separator is cut into pieces of that many
    tokens and a rest: nothing is dropped. A document without tokens (also a null text) has one
    row of 0 tokens and no bin. Null ids are packed like others, repeated rows each for itself; an
    empty table gives an empty one. Other columns take no part.

    Ids and sizes alone are shuffled. Pieces are dealt to blocks of about ``lengths.block`` by a
    hash of the id, the text's hash, the part and, among rows equal in these, a running number. So
    the block of a piece and with it the packing do not depend on partitions, and repeated rows,
    however many, are spread over all blocks; every block is one bounded group, with its own bins.
    """
    most = max(lengths.sizes) - lengths.separator
    if most < 1 or min(lengths.sizes) < 1:
        raise ValueError("lengths must exceed the separator")
    count = words(F.col(f"`{text}`")) if tokens is None else tokens
    counted, _ = staged(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), count.cast("long").alias("total"),
        F.xxhash64(F.col(f"`{text}`")).alias("mark")), "pack-sizes")
    alike, _ = staged(counted.where("total > 0").groupBy("doc_id", "mark", "total").agg(
        F.count(F.lit(1)).alias("copies")).withColumn(
        "n_parts", F.ceil(F.col("total") / most).cast("int")), "pack-rows")
    n = alike.agg(F.sum(F.col("n_parts") * F.col("copies"))).first()[0] or 0
    blocks = max(1, -(-int(n) // lengths.block))
    cut = _numbered(alike).select("doc_id", "mark", "total", "n_parts", "copy", F.explode(
        F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part")).select(
        "doc_id", "mark", "part", "n_parts", (F.col("part").cast("long") * most).alias("first_token"),
        F.least(F.lit(most), F.col("total") - F.col("part").cast("long") * most).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "mark", "part", "copy"), F.lit(blocks)).cast("int").alias(
            "block"))
    kinds = dict(counted.dtypes)["doc_id"]

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("mark", "ascending"),
                               ("part", "ascending")])
        sizes = table["n_tokens"].to_numpy() + lengths.separator
        bins, length = pack(sizes, lengths)
        order = np.argsort(bins, kind="stable")
        place = np.empty(len(bins), np.int64)
        ranked = bins[order]
        place[order] = np.arange(len(bins)) - np.searchsorted(ranked, ranked)
        filled = np.bincount(bins, weights=sizes, minlength=len(length)).astype(np.int64)
        block = table["block"][0].as_py()
        return pa.table({
            **{c: table[c] for c in ("doc_id", "part", "n_parts", "first_token", "n_tokens")},
            "bin_id": pa.array([f"{block}-{b}" for b in bins.tolist()]),
            "bin_length": pa.array(length[bins].astype(np.int32)),
            "bin_tokens": pa.array(filled[bins]), "place": pa.array(place.astype(np.int32))})

    filled = cut.groupBy("block").applyInArrow(packed, (
        f"doc_id {kinds}, part int, n_parts int, first_token long, n_tokens long, bin_id string, "
        "bin_length int, bin_tokens long, place int"))
    empty = counted.where("total <= 0 or total is null").select(
        "doc_id", F.lit(0).alias("part"), F.lit(1).alias("n_parts"),
        F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"),
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"),
        F.lit(None).cast("long").alias("bin_tokens"), F.lit(None).cast("int").alias("place"))
    return filled.unionByName(empty)
