"""Alignment of two tokenizers' tokens over the bytes they share."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import staged, texts_of

FOLDER = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabulary's tokenizer cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of ids whose counts are broadcast: the most frequent ones, so many at most.
HEAD_PAIRS = 1 << 20

_SHIFT = 20
_KNOWN_SEGMENTS = 1_000_000
_KNOWN_IDS = 8_000_000
_LONG_SEGMENT = 64
_JOINED = 500
_ODD_SPACE = re.compile(r"\s ")
_SEGMENT_END = re.compile(r"(?<=\S)(?= )")
_LONG_SPACE = re.compile(r"\s{500}")


# --- Tokens ------------------------------------------------------------------------------------


def byte_characters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte, and the byte: itself if it
    is printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Both tokenizers, from the bytes of their files.

    A text is cut before each space that follows something else than white space. No token of
    either vocabulary reaches over such a place, so the tokens of a text are those of its
    segments, and a segment met before need not be encoded again.
    """

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken

        held = json.loads(byte_level)
        special = {t["content"] for t in held.get("added_tokens", ())}
        of_char = byte_characters()
        ranks = {bytes(of_char[c] for c in token): i for token, i in held["model"]["vocab"].items()
                 if token not in special}
        pairs = ("".join(m if isinstance(m, list) else m.split(" "))
                 for m in held["model"]["merges"])
        merged = [ranks[bytes(of_char[c] for c in pair)] for pair in pairs]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids of the byte-level vocabulary must follow the order of its merges")
        self.json = byte_level
        self.a = tiktoken.Encoding(
            "byte-level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self._forget()

    @cached_property
    def _slow(self):
        """The same vocabulary in another library, for white space too long for the first."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.json.decode())
        made.encode_special_tokens = True
        return made

    def _encode_a(self, text: str) -> list[int]:
        if len(text) > 500 and _LONG_SPACE.search(text):
            return self._slow.encode(text, add_special_tokens=False).ids
        return self.a.encode_ordinary(text)

    def _store(self, segments: list[str], a: list[int], b: list[int], cut_a, cut_b, right) -> None:
        """Keep the ids of new segments; ``cut_a`` and ``cut_b`` say where each one's end."""
        first = len(self.known)
        self.known.update(zip(segments, range(first, first + len(segments))))
        self.cuts_a.extend((np.asarray(cut_a, np.int64) + len(self.ids_a)).tolist())
        self.cuts_b.extend((np.asarray(cut_b, np.int64) + len(self.ids_b)).tolist())
        self.right.extend([right] * len(segments))
        self.ids_a.extend(a)
        self.ids_b.extend(b)

    def _fits(self, own: bytes, a: list[int], b: list[int]) -> bool:
        return (b"".join([self.bytes_a[i] for i in a]) == own
                and b"".join([self.bytes_b[i] for i in b]) == own)

    def _learn(self, segments: list[str]) -> None:
        """Encode segments (their first space left out) not met before.

        Many short ones go in one call, joined by the spaces they begin with, and are told apart
        by where their bytes end.
        """
        plain, rest = [], []
        for s in segments:
            (plain if s and len(s) <= _LONG_SEGMENT and not s[-1].isspace() else rest).append(s)
        for first in range(0, len(plain), _JOINED):
            part = plain[first:first + _JOINED]
            text = " ".join(part)
            a, b = self._encode_a(" " + text), self.b.encode(text)
            if not self._fits((" " + text).encode(), a, b):
                rest += part
                continue
            ends = np.cumsum([len(s.encode()) + 1 for s in part])
            self._store(part, a, b, np.searchsorted(np.cumsum(self.length_a[a]), ends) + 1,
                        np.searchsorted(np.cumsum(self.length_b[b]), ends) + 1, True)
        space = [self.b.piece_to_id("▁")]
        for s in rest:
            a, b = self._encode_a(" " + s), self.b.encode(s) if s else space
            self._store([s], a, b, [len(a)], [len(b)], self._fits((" " + s).encode(), a, b))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids_a, self.ids_b = array("i"), array("i")
        self.cuts_a, self.cuts_b = array("q", [0]), array("q", [0])
        self.right = array("b")

    def segments(self, text: str) -> list[str]:
        """Segments of a space and the text, without the space they begin with."""
        spaced = " " + text
        if _ODD_SPACE.search(spaced):
            return [s[1:] for s in _SEGMENT_END.split(spaced)]
        return text.split(" ")

    def tokens(self, texts: list[str]) -> Tokens:
        """Tokens of both vocabularies for each text; none for an empty text or one whose bytes
        are not those of its tokens."""
        if len(self.known) > _KNOWN_SEGMENTS or len(self.ids_a) > _KNOWN_IDS:
            self._forget()
        cut = [self.segments(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        every = list(chain.from_iterable(cut))
        self._learn([s for s in dict.fromkeys(every) if s not in self.known])
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        text = np.repeat(np.arange(len(texts)), sizes)
        wrong = np.frombuffer(self.right, np.int8)[at] == 0
        if wrong.any():
            bad = np.zeros(len(texts), bool)
            bad[text[wrong]] = True
            at, text = at[~bad[text]], text[~bad[text]]
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        return Tokens(*_spread(self.ids_a, self.cuts_a, at, bounds),
                      *_spread(self.ids_b, self.cuts_b, at, bounds))


@dataclass
class Tokens:
    """Ids of both vocabularies for several texts, and where each text begins (and the end)."""

    a: np.ndarray
    starts_a: np.ndarray
    b: np.ndarray
    starts_b: np.ndarray


def _spread(ids: array, cuts: array, at: np.ndarray, bounds: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the segments ``at`` one after the other, and where each text's part begins."""
    flat, ends = np.array(ids, np.int64), np.array(cuts, np.int64)
    begin, count = ends[at], ends[at + 1] - ends[at]
    total = np.concatenate(([0], np.cumsum(count)))
    where = np.arange(total[-1]) + np.repeat(begin - total[:-1], count)
    return flat[where], total[bounds]


# --- Alignment ---------------------------------------------------------------------------------


@dataclass
class Alignment:
    """Groups of tokens that cover the same bytes.

    ``last_a`` and ``last_b`` are the last tokens of each group, in order; ``links_a`` and
    ``links_b`` all pairs of tokens whose bytes overlap.
    """

    last_a: np.ndarray
    last_b: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Align two rising arrays of byte ends with the same last entry.

    While the ends agree at the current shift between the indices, the stretch that agrees is
    probed at doubling lengths and its end found by halving, whole slices at a time: one-to-one
    tokens are jumped over. Where they disagree, the token that ends first gives way to the next
    until both end together; that resolves the irregular group and sets the new shift.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    size = len(a)
    run_a, run_b, run_n = [], [], []
    walk_a, walk_b, last_a, last_b = [], [], [], []
    i = j = 0
    while i < size:
        x, y = a[i], b[j]
        if x == y:
            run_a.append(i)
            run_b.append(j)
            i += 1
            j += 1
            step = 1
            while i < size and a[i:i + step] == b[j:j + step]:
                i += step
                j += step
                step += step
            if i >= size:
                i = size
                run_n.append(i - run_a[-1])
                break
            while step > 1:
                step >>= 1
                if a[i:i + step] == b[j:j + step]:
                    i += step
                    j += step
            run_n.append(i - run_a[-1])
            continue
        while True:
            walk_a.append(i)
            walk_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            elif y < x:
                j += 1
                y = b[j]
            else:
                break
        last_a.append(i)
        last_b.append(j)
        i += 1
        j += 1
    run_n = np.array(run_n, np.int64)
    inside = np.arange(int(run_n.sum())) - np.repeat(np.cumsum(run_n) - run_n, run_n)
    one_a = inside + np.repeat(np.array(run_a, np.int64), run_n)
    one_b = inside + np.repeat(np.array(run_b, np.int64), run_n)
    return Alignment(np.sort(np.concatenate((one_a, np.array(last_a, np.int64))), kind="stable"),
                     np.sort(np.concatenate((one_b, np.array(last_b, np.int64))), kind="stable"),
                     np.concatenate((one_a, np.array(walk_a, np.int64))),
                     np.concatenate((one_b, np.array(walk_b, np.int64))))


@dataclass
class Aligned:
    """Tokens of several texts with their groups and links (sorted by text), and where each
    text's begin (and the end)."""

    tokens: Tokens
    groups: Alignment
    group_starts: np.ndarray
    link_starts: np.ndarray


def align_texts(texts: list[str], codec: Codec) -> Aligned:
    """Tokens and groups of all texts. Both tokenizers end a token where a text ends, so the texts
    are aligned as one."""
    t = codec.tokens(texts)
    found = align(np.cumsum(codec.length_a[t.a]), np.cumsum(codec.length_b[t.b]))
    order = np.argsort(found.links_a, kind="stable")
    links_a, links_b = found.links_a[order], found.links_b[order]
    return Aligned(t, Alignment(found.last_a, found.last_b, links_a, links_b),
                   np.searchsorted(found.last_a, t.starts_a),
                   np.searchsorted(links_a, t.starts_a))


def group_texts(aligned: Aligned, size_a: int, size_b: int) -> list[bytes]:
    """The groups of each text written as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    t, g = aligned.tokens, aligned.groups
    ends_a, ends_b = np.zeros(len(t.a), bool), np.zeros(len(t.b), bool)
    ends_a[g.last_a] = True
    ends_b[g.last_b] = True
    before_a = np.cumsum(ends_a) - ends_a
    before_b = np.cumsum(ends_b) - ends_b
    written = np.empty(len(t.a) + len(t.b), np.int64)
    written[np.arange(len(t.a)) + np.concatenate(([0], g.last_b + 1))[before_a]] = (
        2 * t.a + ends_a)
    written[np.arange(len(t.b)) + np.append(g.last_a + 1, 0)[before_b]] = (
        2 * size_a + 2 * t.b + ends_b)
    marks = _written(size_a, size_b)[written]
    starts = t.starts_a + t.starts_b
    return [marks[p:q].tobytes().replace(b"\x00", b"")[:-1] for p, q in zip(starts, starts[1:])]


@lru_cache(maxsize=2)
def _written(size_a: int, size_b: int) -> np.ndarray:
    """Every id with the mark that follows it inside a group and at its side's end."""
    return np.array([f"{i}{mark}" for i in range(size_a) for mark in ",|"]
                    + [f"{i}{mark}" for i in range(size_b) for mark in ",;"], "S")


# --- Tables ------------------------------------------------------------------------------------


def files(spark: SparkSession, folder: str = FOLDER, byte_level: str = "byte_bpe_50k.json",
          pieces: str = "piece_bpe_32k.model") -> Callable[[], Codec]:
    """What makes the codec in a task. The two files are read by the driver and broadcast; a
    vocabulary is a few megabytes, whatever the input."""
    held = []
    for name in (byte_level, pieces):
        with open(f"{folder}/{name}", "rb") as file:
            held.append(file.read())
    shared = spark.sparkContext.broadcast(tuple(held))
    return lambda: Codec(*shared.value)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)),
                                    pa.array(values.astype(np.int32)))


def align_documents(docs: DataFrame, codec: Callable[[], Codec], text: str = "text",
                    name: str = "alignment") -> DataFrame:
    """``docs`` with ``alignment``: ids of both tokenizers (a, b) and the index after the last
    token of each group on either side (ends_a, ends_b).

    Null and empty texts, and texts whose bytes are not those of their tokens, have no tokens.
    Texts are read whole; a row is done in its scan's own task.
    """
    kind = "struct<a:array<int>,b:array<int>,ends_a:array<int>,ends_b:array<int>>"

    @F.arrow_udf(kind)
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec()
        for batch in batches:
            x = align_texts(texts_of(batch), own)
            groups = np.diff(x.group_starts)
            yield pa.StructArray.from_arrays(
                [_lists(x.tokens.a, x.tokens.starts_a), _lists(x.tokens.b, x.tokens.starts_b),
                 _lists(x.groups.last_a + 1 - np.repeat(x.tokens.starts_a[:-1], groups),
                        x.group_starts),
                 _lists(x.groups.last_b + 1 - np.repeat(x.tokens.starts_b[:-1], groups),
                        x.group_starts)], ["a", "b", "ends_a", "ends_b"])

    return docs.withColumn(name, aligned(F.col(f"`{text}`")))


_FACTS = ("struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,"
          "a:array<int>,b:array<int>,times:array<int>>")


def _facts(codec: Callable[[], Codec]):
    """Per text: sizes, the digest of its groups, and its different linked pairs of ids with how
    often each occurs."""

    @F.arrow_udf(_FACTS)
    def facts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec()
        sizes = len(own.bytes_a), len(own.bytes_b)
        for batch in batches:
            x = align_texts(texts_of(batch), own)
            t, g = x.tokens, x.groups
            digests = [hashlib.sha256(w).hexdigest() if w else ""
                       for w in group_texts(x, *sizes)]
            links = np.diff(x.link_starts)
            pairs = (t.a[g.links_a] << _SHIFT) | t.b[g.links_b]
            text = np.repeat(np.arange(len(batch)), links)
            order = np.lexsort((pairs, text))
            pairs = pairs[order]
            fresh = np.ones(len(pairs), bool)
            fresh[1:] = (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(fresh)
            starts = np.searchsorted(first, x.link_starts)
            yield pa.StructArray.from_arrays(
                [pa.array(np.diff(t.starts_a)), pa.array(np.diff(t.starts_b)),
                 pa.array(np.diff(x.group_starts)), pa.array(links),
                 pa.array(digests, pa.string()),
                 _lists(pairs[first] >> _SHIFT, starts),
                 _lists(pairs[first] & ((1 << _SHIFT) - 1), starts),
                 _lists(np.diff(np.append(first, len(pairs))), starts)],
                ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])

    return facts


def _codes(a: pa.Array, b: pa.Array) -> np.ndarray:
    return ((np.asarray(a.flatten()).astype(np.int64) << _SHIFT)
            | np.asarray(b.flatten()).astype(np.int64))


def pair_counts(facts: DataFrame) -> DataFrame:
    """(a, b, n): how many texts hold the two ids linked.

    Texts are counted in each task before the shuffle, in arrays of bounded size.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, pending = (np.empty(0, np.int64), np.empty(0, np.int64)), 0, []

        def settle() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([held[0], *(k for k, _ in pending)])
            counts = np.concatenate([held[1], *(n for _, n in pending)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]) if len(keys) else [])
            return keys[first], np.add.reduceat(counts, first) if len(first) else counts

        def rows(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            keys, counts = pair
            return pa.RecordBatch.from_arrays(
                [pa.array((keys >> _SHIFT).astype(np.int32)),
                 pa.array((keys & ((1 << _SHIFT) - 1)).astype(np.int32)), pa.array(counts)],
                ["a", "b", "n"])

        for batch in batches:
            pending.append(np.unique(_codes(batch.column(0), batch.column(1)),
                                     return_counts=True))
            waiting += len(pending[-1][0])
            if waiting > 2_000_000:
                held, waiting, pending = settle(), 0, []
                if len(held[0]) > 4_000_000:
                    yield rows(held)
                    held = (np.empty(0, np.int64), np.empty(0, np.int64))
        yield rows(settle())

    return facts.select("a", "b").mapInArrow(counted, "a int, b int, n bigint").groupBy(
        "a", "b").agg(F.sum("n").alias("n"))


def _head_bound(counts: DataFrame, most: int) -> tuple[int, bool]:
    """The least count from which on at most ``most`` pairs have it, and whether all have it.

    Pairs are counted by size class (eight to each doubling), so a few hundred rows reach the
    driver.
    """
    width = F.floor(F.log2("n") * 8).cast("int")
    classes = counts.groupBy(width.alias("class")).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(
        F.desc("class")).collect()
    taken, bound = 0, 1 << 62
    for row in classes:
        taken += row["pairs"]
        if taken > most:
            return bound, False
        bound = row["least"]
    return bound, True


def alignment_counts(docs: DataFrame, codec: Callable[[], Codec], text: str = "text",
                     doc_id: str = "doc_id", head: int = HEAD_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256.

    A pair of ids counts as often as rows hold it linked; repeated rows are rows of their own,
    null ids too. Null and empty texts, and texts whose tokens do not give back their bytes, have
    zeros and an empty digest. Other columns take no part. An empty table gives an empty one.

    Texts are tokenized once; their different pairs are staged as two columns of small ids. The
    counts of the most frequent pairs, ``head`` at most, are broadcast and looked up where the
    rows lie, which also takes away all hot keys. The rest meet their counts in a join by pair.
    """
    facts, _ = staged(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        _facts(codec)("text").alias("f")).select("doc_id", "row", "f.*"), "token-links")
    counted, _ = staged(pair_counts(facts), "pair-counts")
    # one row per id of the first vocabulary
    highest = counted.groupBy("a").agg(F.max("n").alias("top"))
    counts = counted.join(F.broadcast(highest), "a").select(
        "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    bound, whole = _head_bound(counted, head)
    frequent = counts.where(F.col("n") >= bound).toArrow().combine_chunks()
    keys = (np.asarray(frequent["a"]).astype(np.int64) << _SHIFT) | np.asarray(frequent["b"])
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast(
        (keys[order], np.asarray(frequent["n"])[order], np.asarray(frequent["best"])[order]))

    def looked_up(a: pa.Array, b: pa.Array):
        keys, n, best = shared.value
        pairs = _codes(a, b)
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        return at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool), n, best

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
    def resolved(a: pa.Array, b: pa.Array, times: pa.Array) -> pa.Array:
        at, hit, n, best = looked_up(a, b)
        often = np.asarray(times.flatten()).astype(np.int64)
        starts = np.asarray(times.offsets) - times.offsets[0].as_py()
        sums = []
        for value in (best, n):
            own = np.where(hit, value[at] * often, 0) if len(value) else np.zeros(len(at), int)
            sums.append(np.diff(np.concatenate(([0], np.cumsum(own)))[starts]))
        return pa.StructArray.from_arrays([pa.array(s) for s in sums], ["n_best", "count_sum"])

    sizes = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    near = facts.select(*sizes, "row", "groups_sha256",
                        resolved("a", "b", "times").alias("s")).select(
        *sizes, "row", "groups_sha256", "s.*")
    if not whole:
        near = _with_rare(near, facts, counts.where(F.col("n") < bound), looked_up)
    return near.select(*sizes, "n_best", "count_sum", "groups_sha256")


def _with_rare(near: DataFrame, facts: DataFrame, rare: DataFrame, looked_up) -> DataFrame:
    """``near`` with the sums of the pairs that are not among the broadcast ones."""
    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b, times = (batch.column(i) for i in range(4))
            _, hit, _, _ = looked_up(a, b)
            rows = np.repeat(np.asarray(row), np.diff(np.asarray(a.offsets)))
            open_at = pa.array(~hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows).filter(open_at), *(x.flatten().filter(open_at)
                                                   for x in (a, b, times))],
                ["row", "a", "b", "times"])

    met = facts.select("row", "a", "b", "times").mapInArrow(
        left, "row bigint, a int, b int, times int").join(rare, ["a", "b"])
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("more_best"),
        F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    zero = F.lit(0).cast("bigint")
    return near.join(sums, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", zero),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero)})
