"""Quality rules with cutoffs that labelled holdouts certify."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import free_name, staged

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_caps_words")


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts in percent and its cutoffs from lax to strict.

    A text fails where ``100 * numerator`` is over (``above``) or under cutoff * denominator.
    """

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[int, ...]
    above: bool = True

    def failed(self, cutoff: Column) -> Column:
        """Null where there is no cutoff."""
        part = 100 * F.col(self.numerator)
        whole = cutoff * F.col(self.denominator)
        return part > whole if self.above else part < whole


RULES = (
    Rule("symbols", "n_symbols", "n_words", (200, 100, 50, 30, 20, 10, 5)),
    Rule("repeats", "n_repeat_words", "n_words", (60, 40, 30, 20, 10)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (60, 40, 30, 20)),
    Rule("capitals", "n_caps_words", "n_words", (80, 60, 50, 40, 30, 20)),
    Rule("long_words", "word_chars", "n_words", (1200, 1100, 1000, 900, 800)),
)
#: Parameters of the base rules: fewest words, most percent of repeated words.
MIN_WORDS, MAX_REPEATED = 20, 30


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window that the text holds twice or more.

    Windows are compared exactly: numbers for words, then for pairs of numbers, doubling until
    the window is reached (which must be a power of two). It ends as soon as nothing repeats.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    kinds, span = len(numbers), 1
    while span < window:
        if kinds == len(ids):
            return 0
        pairs = ids[:-span] * kinds + ids[span:]
        distinct, ids, times = np.unique(pairs, return_inverse=True, return_counts=True)
        kinds, span = len(distinct), 2 * span
    starts = np.flatnonzero(times[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8. White space, capitals and symbols are ASCII."""
    words = text.split()
    if not words:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0, 0)
    squeezed = b"".join(words)
    chars = len(squeezed) if squeezed.isascii() else len(squeezed.decode())
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeated_words(words),
            sum(map(bytes.isupper, words)))


def text_counts(text: Column) -> Column:
    """A struct of COUNTS (long) for a text column; null counts as empty."""
    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [counts_of(t.as_py().encode() if t.is_valid else b"") for t in batch]
            values = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
            yield pa.StructArray.from_arrays(
                [pa.array(values[:, i]) for i in range(len(COUNTS))], list(COUNTS))

    return counted(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p): the regularised incomplete beta I(1-p; n-k, k+1).

    Lentz's continued fraction, whose length does not follow n.
    """
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1.0 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, p
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    fraction = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            fraction *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    return 1.0 - front * fraction if flip else front * fraction


@dataclass(frozen=True)
class Risk:
    """Of the good texts of a stratum at most ``share`` may be rejected by all rules together,
    in every stratum at once with probability 1 - ``doubt`` at least. Strata with too few labels
    for that count as one."""

    share: float = 0.05
    doubt: float = 0.05


def steps_of(rules: tuple[Rule, ...]) -> int:
    return max(len(r.cutoffs) for r in rules)


def cutoff_at(rule: Rule, step: int) -> int:
    """A rule's cutoff in the joint step; a rule with fewer cutoffs stays at its strictest."""
    return rule.cutoffs[min(step, len(rule.cutoffs) - 1)]


def certified_cutoffs(holdout: DataFrame, rules: tuple[Rule, ...] = RULES,
                      risk: Risk = Risk()) -> DataFrame:
    """stratum and a cutoff for each rule: the strictest joint step that the holdout certifies
    (nulls if none is).

    ``holdout`` has a row with stratum and COUNTS for each labelled good text. In step i every
    rule has its i-th cutoff, so the texts that some rule rejects grow from step to step. A step
    holds if the exact upper confidence bound (Clopper-Pearson) of all rejections together is not
    above the risk's share: if so few rejections would have a probability of at most the level.
    Steps are tested in fixed order up to the first that fails, which needs no correction; the
    level is doubt / strata, by Bonferroni. Strata too small to certify anything, even without a
    rejection, are joined to one, for which the bound then holds as a whole.

    One pre-aggregated pass counts rejections for all steps; only counts go to Python.
    """
    steps = range(steps_of(rules))
    rejected = [reduce(or_, (F.coalesce(r.failed(F.lit(cutoff_at(r, i))), F.lit(False))
                             for r in rules)) for i in steps]
    counted, _ = staged(holdout.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(x.cast("long")).alias(f"k_{i}") for i, x in enumerate(rejected)]),
        "quality-counts")
    level = risk.doubt / max(1, counted.count())
    small = F.pow(F.lit(1 - risk.share), "n") > level
    grouped = counted.withColumn("pool", F.when(small, "joint").otherwise(
        F.concat(F.lit("own "), "stratum")))

    @F.arrow_udf("boolean")
    def holds(hits: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array([binomial_cdf(k, n, risk.share) <= level
                         for k, n in zip(hits.to_pylist(), rows.to_pylist())], pa.bool_())

    tested = grouped.groupBy("pool").agg(F.sum("n").alias("n"), F.array(
        *[F.struct(F.lit(i).alias("step"), F.sum(f"k_{i}").alias("k")) for i in steps]
    ).alias("tests")).select("pool", "n", F.explode("tests").alias("t")).select(
        "pool", F.col("t.step").alias("step"), holds("t.k", "n").alias("holds"))
    best = tested.groupBy("pool").agg(
        F.coalesce(F.min(F.when(~F.col("holds"), F.col("step"))), F.lit(len(steps))).alias("first"))
    chosen = F.col("first") - 1
    return grouped.join(best, "pool").select("stratum", *[
        F.when(chosen >= 0, F.element_at(
            F.array(*[F.lit(cutoff_at(r, i)) for i in steps]), F.greatest(chosen, F.lit(0)) + 1)
        ).alias(f"cut_{r.name}") for r in rules])


def stratum_of(column: Column) -> Column:
    """The stratum's name; null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


#: Most strata whose cutoffs are broadcast (a row each); beyond it Spark plans the join.
BROADCAST_STRATA = 10_000


def judge(counted: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES,
          risk: Risk = Risk(), doc_id: str = "doc_id") -> DataFrame:
    """``counted`` (doc_id, stratum and COUNTS per text) with base_failed, failed_rules, kept.

    The holdout is every labelled good text (quality 1) that the base rules keep. A document with
    several labels is good if one says so; labels without id or quality take no part.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    based = counted.withColumn("base_failed", base_failed())
    holdout = based.where("not base_failed").join(
        good, based[doc_id] == good["doc_id"], "left_semi")
    cutoffs, _ = staged(certified_cutoffs(holdout, rules, risk), "quality-cutoffs")
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    failed = F.array_compact(F.array(*[
        F.when(r.failed(F.col(f"cut_{r.name}")), F.lit(r.name)) for r in rules]))
    return based.join(cutoffs, "stratum", "left").withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(
        *[f"cut_{r.name}" for r in rules])


def score_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang",
                    rules: tuple[Rule, ...] = RULES, risk: Risk = Risk(),
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, stratum, COUNTS, base_failed, failed_rules and kept for every row of ``docs``.

    Null, empty and wordless texts have counts of zero and fail the base rules. A null stratum is
    one of its own; where even the strata with few labels together certify nothing, only the base
    rules reject, and so in all strata without labels. A null id is judged like any
    other. Repeated rows stay repeated; other columns take no part; empty tables give empty ones.

    One pass over the whole texts; only counts are staged, joined and shuffled.
    """
    counted, _ = staged(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), stratum_of(F.col(f"`{stratum}`")).alias("stratum"),
        text_counts(F.col(f"`{text}`")).alias("counts")).select("doc_id", "stratum", "counts.*"),
        "quality-features")
    return judge(counted, labels, rules, risk)


def keep_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang",
                   rules: tuple[Rule, ...] = RULES, risk: Risk = Risk(),
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged; cases as in
    :func:`score_documents`.

    The texts are staged once beside their counts: they are not read twice by Python, and not
    shuffled.
    """
    whole = free_name(docs, "_row")
    carried, _ = staged(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole),
        F.col(f"`{doc_id}`").alias("doc_id"), stratum_of(F.col(f"`{stratum}`")).alias("stratum"),
        text_counts(F.col(f"`{text}`")).alias("counts")).select(
        whole, "doc_id", "stratum", "counts.*"), "quality-rows")
    return judge(carried, labels, rules, risk).where("kept").select(f"{whole}.*")
