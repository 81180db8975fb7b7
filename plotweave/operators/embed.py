"""Text embedding through a pluggable encoder, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave import settings as S

Encode = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Embedder:
    """A named encoder.

    ``load`` runs once per task and returns a function from texts to a matrix with ``dim``
    columns. ``query_prefix`` is put before queries only.
    """

    name: str
    dim: int
    load: Callable[[], Encode]
    query_prefix: str = ""
    batch_size: int = S.ENCODE_BATCH


_BETWEEN_WORDS = r"[^\pL\pN]+"


def hashed_words(dim: int = 256) -> Embedder:
    """Default encoder: counts of hashed words, needing no model files.

    A word's bucket is the first 32 bits of its MD5 modulo ``dim``. A batch is split in Arrow,
    each of its different words is looked up once, and all texts are counted together.
    """

    def load() -> Encode:
        @lru_cache(maxsize=500_000)
        def bucket(word: str) -> int:
            digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
            return int(digest[:8], 16) % dim if word else -1

        def encode(texts: list[str]) -> np.ndarray:
            words = pc.split_pattern_regex(
                pc.utf8_lower(pa.array(texts, pa.string())), _BETWEEN_WORDS)
            rows = np.repeat(np.arange(len(texts)), np.diff(np.asarray(words.offsets)))
            coded = words.flatten().dictionary_encode()
            buckets = np.fromiter(
                map(bucket, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            hits = buckets[np.asarray(coded.indices)]
            cells = (rows * dim + hits)[hits >= 0]
            return np.bincount(cells, minlength=len(texts) * dim).reshape(-1, dim)

        return encode

    return Embedder(name=f"hashed-words-{dim}", dim=dim, load=load, batch_size=1024)


def with_query_instruction(embedder: Embedder, text: str = S.QUERY_INSTRUCTION) -> Embedder:
    """``embedder`` for models trained with an instruction before queries (not before passages)."""
    return replace(embedder, query_prefix=text)


def unit_vectors(encode: Encode, texts: list[str], embedder: Embedder) -> np.ndarray:
    """Encode in batches and scale every row to length 1 (zero rows stay zero)."""
    out = np.zeros((len(texts), embedder.dim), dtype=np.float32)
    for start in range(0, len(texts), embedder.batch_size):
        chunk = texts[start : start + embedder.batch_size]
        raw = np.asarray(encode(chunk), dtype=np.float64)
        norms = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        out[start : start + len(chunk)] = raw / np.where(norms > 0, norms, 1.0)
    return out


def to_list_array(matrix: np.ndarray) -> pa.ListArray:
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int64) * dim, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))


def embed(
    df: DataFrame, text: str, embedder: Embedder, out: str = "vector", is_query: bool = False
) -> DataFrame:
    """Add the unit vector of column ``text`` as ``array<float>``; null counts as empty."""

    @F.arrow_udf("array<float>")
    def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = embedder.load()
        for batch in batches:
            yield to_list_array(unit_vectors(encode, batch.to_pylist(), embedder))

    source = F.coalesce(F.col(text), F.lit(""))
    if is_query and embedder.query_prefix:
        source = F.concat(F.lit(embedder.query_prefix), source)
    return df.withColumn(out, encode_batches(source))
