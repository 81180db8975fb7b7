"""Near-duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import free_name, staged
from plotweave.llm.components import connected

SEED = 42
BITS = 64


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Bit majority of the XXH64 hashes of all word shingles; A-Z are lower-cased."""
    words = text.lower().split()  # of bytes: ASCII white space and letters only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - width + 1].tolist()
    stops = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long; zero for null and wordless texts."""
    @F.arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.fromiter(
                (fingerprint_of(t.as_py().encode() if t.is_valid else b"", shingle)
                 for t in batch), np.uint64, len(batch))
            yield pa.array(values.view(np.int64))

    return made(text)


def _block_masks(distance: int, blocks: int) -> list[int]:
    """One mask of bits for every choice of ``blocks - distance`` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    spans = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(spans, blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _far_apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def close_links(prints: DataFrame, distance: int = 2, blocks: int = 4,
                crowded: int = 32) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs within ``distance`` bits.

    ``prints`` has one column, print, of different fingerprints. Cut into ``blocks`` blocks, two
    fingerprints within the distance agree in blocks - distance of them; they meet in a join on
    every choice of that many blocks, and the Hamming distance is checked inside the join.

    A key that more than ``crowded`` fingerprints share is not joined with itself, whose pairs
    grow with the square of their number. Its members are tied by what lies between them: two
    fingerprints at most 2 bits apart share a neighbour at most 1 bit from each, and all that
    share one are at most 2 bits apart. So each member names itself and its neighbours in the
    bits outside the key, and each neighbour's smallest member is tied to the others: no link is
    lost, none is added, and the rows grow in proportion. This form is for distances up to 2.
    """
    if distance > 2 or distance < 0 or blocks <= distance:
        raise ValueError("distances of 0 to 2 bits and more blocks than that")
    masks = _block_masks(distance, blocks)
    keyed = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(masks)])).alias("at")).select("print", "at.block", "at.key")
    shared = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met, _ = staged(keyed.join(shared, ["block", "key"]), "simhash-blocks")

    few = met.where(F.col("n") <= crowded)
    pairs = few.select("block", "key", F.col("print").alias("a")).join(
        few.select("block", "key", F.col("print").alias("b")), ["block", "key"]).where(
        (F.col("a") > F.col("b")) & (_far_apart("a", "b") <= distance)).select("a", "b")
    if distance == 0:
        return pairs
    bits = [[_signed(1 << b) for b in range(BITS) if not m >> b & 1] for m in masks]
    if distance == 1:  # they differ in one bit: with it set they are equal
        bits = [[F.lit(b) for b in row] for row in bits]
        between, group = F.col("print").bitwiseOR(F.col("flip")), ["block", "flip", "between"]
    else:
        bits = [[F.lit(b).cast("long") for b in (0, *row)] for row in bits]
        between, group = F.col("print").bitwiseXOR(F.col("flip")), ["block", "between"]
    around = met.where(F.col("n") > crowded).select("print", "block", F.explode(F.element_at(
        F.array(*[F.array(*row) for row in bits]), F.col("block") + 1)).alias("flip")).select(
        "print", "block", "flip", between.alias("between"))
    least = around.groupBy(*group).agg(
        F.min("print").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = around.join(least, group).where("print > b").select(F.col("print").alias("a"), "b")
    return pairs.unionByName(ties)


def near_duplicate_classes(docs: DataFrame, distance: int = 2, blocks: int = 4,
                           shingle: int = 3, doc_id: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """doc_id, print (signed long) and component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``distance`` differing
    bits, the row's own included. Null, empty and wordless texts share the fingerprint zero and
    are linked like any other. A null doc_id stays null and names no component; where no member
    has an id, component_id is null. Repeated rows stay repeated. An empty table gives an empty
    one. Other columns take no part.

    Only ids and fingerprints are staged and shuffled. Equal fingerprints are one node, so exact
    copies, however many, are one row before any join.
    """
    prints, _ = staged(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        fingerprints(F.col(f"`{text}`"), shingle).alias("print")), "simhash-prints")
    nodes, _ = staged(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    links = close_links(nodes.select("print"), distance, blocks)
    linked = connected(links).withColumnsRenamed({"node": "print"})
    joined = nodes.join(linked, "print")
    firsts = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(firsts, "component").select("print", "component_id")
    classes, _ = staged(nodes.join(named, "print", "left").select(
        "print", F.coalesce("component_id", "first").alias("component_id")), "simhash-classes")
    return prints.join(classes, "print").select("doc_id", "print", "component_id")


def print_text(signed: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(signed)), 16, "0")


def drop_near_duplicates(docs: DataFrame, distance: int = 2, blocks: int = 4, shingle: int = 3,
                         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate class: that with the smallest doc_id, columns unchanged.

    Repeated rows of that id are one document and one of them stays. Of a class without any id
    all rows are copies of each other and one stays.
    """
    classes, _ = staged(near_duplicate_classes(docs, distance, blocks, shingle, doc_id, text),
                        "simhash-members")
    key, own_print = F.col(f"`{doc_id}`"), free_name(docs, "_print")
    losers = classes.where("doc_id is not null and doc_id <> component_id").select(
        F.col("doc_id").alias("loser")).distinct()
    repeated = classes.where("doc_id = component_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    kept = docs.where(key.isNotNull())
    kept = kept.join(losers, kept[doc_id] == losers["loser"], "left_anti")
    again = kept[doc_id] == repeated["again"]
    once = kept.join(repeated, again, "left_anti").unionByName(
        kept.join(repeated, again, "left_semi").dropDuplicates([doc_id]))
    alone = classes.where("component_id is null").select("print").distinct()
    own = docs.where(key.isNull()).withColumn(
        own_print, fingerprints(F.col(f"`{text}`"), shingle))
    return once.unionByName(own.join(alone, own[own_print] == alone["print"], "left_semi")
                            .dropDuplicates([own_print]).drop(own_print))
