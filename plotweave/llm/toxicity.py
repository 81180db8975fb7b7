"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A few toxic words in a long text hardly move the mean of all of its subwords. So the bags are the
passages of a text (runs of a few words), the softmax judges each of them, and a text is as toxic
as its worst passage.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import code_points, free_name, in_chunks, staged, texts_of
from plotweave.llm.quality_nb import sigmoid_scale
from plotweave.scratch import discard

_CHUNK = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Features and training. ``buckets`` is a power of two; a passage has ``window`` words.
    ``per_class`` bounds the labelled texts fitted on: about so many ids of each class by a hash
    of the id, one text each; a fifth of them sets the scale of the scores. ``warm`` passes over
    whole texts are followed by ``rounds`` over the worst ``hardest`` passages of each text.
    Scores are scaled as if the part ``prior`` of all texts were toxic: more than is, as a toxic
    text missed does more harm than a clean one doubted."""

    sizes: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 18
    dim: int = 8
    window: int = 5
    per_class: int = 4000
    warm: int = 2
    rounds: int = 8
    hardest: int = 3
    rate: float = 0.5
    prior: float = 0.25
    seed: int = 0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased letter or digit for each code point of the basic plane, a space for others."""
    table = np.full(1 << 16, 32, np.uint32)
    for point in range(1 << 16):
        char = chr(point)
        if char.isalnum():
            table[point] = ord(char.lower()[0])
    return table


def _bucket(values: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    out = (values + np.uint64(kind)) * _MIX
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(65 - buckets.bit_length())).astype(np.int32)


@dataclass
class Bags:
    """Subwords of several texts. Each run holds the buckets of all pieces of one size, in the
    order of the words, and where the pieces of each word begin (and the end). ``texts`` says
    where the words of each text begin (and the end)."""

    runs: list[tuple[np.ndarray, np.ndarray]]
    texts: np.ndarray

    def between(self, first: int, last: int) -> np.ndarray:
        """Buckets of the words from ``first`` up to ``last``, repeats included."""
        return np.concatenate([b[at[first]:at[last]] for b, at in self.runs])

    def summed(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running totals over the words: of the table's entries, and of the number of pieces."""
        total, count = 0.0, 0
        for buckets, at in self.runs:
            so_far = np.concatenate(([0.0], np.cumsum(table.take(buckets), dtype=np.float64)))
            total, count = total + so_far[at], count + at
        return total, count


def bags_of(texts: list[str], settings: Settings) -> Bags:
    """The subwords of each text.

    A word is a run of letters and digits, in lower case, with a boundary mark on either side.
    Its subwords are its pieces of the given sizes, marks included, and the whole of it; so a
    word never seen shares pieces with those it is spelt like.
    """
    points, gaps = code_points(texts, "\x00")
    low = _letters()[np.minimum(points, (1 << 16) - 1)]
    if int(points.max()) >> 16:
        low = np.where(points >> 16, points, low)
    keep = low != 32
    keep[1:] |= low[:-1] != 32
    keep[gaps] = True
    starts = np.concatenate(([0], np.cumsum(keep)))[gaps]
    low = low[keep].astype(np.uint64)
    mark = low == 32
    begin = np.flatnonzero(~mark[1:] & mark[:-1]) + 1
    marks = np.concatenate(([0], np.cumsum(mark)))
    runs, grown = [], np.zeros(len(low), np.uint64)
    for size in range(1, max(settings.sizes) + 1):
        grown = grown[:max(0, len(low) - size + 1)] * np.uint64(0x100000001B3) + low[size - 1:]
        if size not in settings.sizes or not len(grown):
            continue
        # no mark but at its ends
        first = np.flatnonzero(marks[size - 1:len(low)] == marks[1:len(low) - size + 2])
        runs.append((_bucket(grown[first], size, settings.buckets),
                     np.append(np.searchsorted(first, begin - 1), len(first)).astype(np.int32)))
    if len(begin):
        place = np.arange(begin[0], len(low)) - np.repeat(
            begin, np.diff(np.append(begin, len(low))))
        term = (low[begin[0]:] + np.uint64(1)) * _MIX
        term ^= term >> np.uint64(31)
        term *= (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)) * np.uint64(
            0x94D049BB133111EB)
        term[mark[begin[0]:]] = 0
        words = np.add.reduceat(term, begin - begin[0])
    else:
        words = np.zeros(0, np.uint64)
    runs.append((_bucket(words, 0, settings.buckets), np.arange(len(begin) + 1, dtype=np.int32)))
    return Bags(runs, np.searchsorted(begin, starts))


def passages(count: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of each passage of a text of ``count`` words: every run of
    ``window`` words, or all of them if there are fewer."""
    first = np.arange(max(1, count - window + 1))
    return first, np.minimum(first + window, count)


class Learner:
    """Embeddings and a softmax over two classes, learnt together by adaptive gradient steps.

    A bag is the mean of the embeddings of its subwords, each counted as often as it occurs. Each
    subword and each weight has a rate of its own, so rare subwords move as far as frequent ones.
    """

    def __init__(self, settings: Settings):
        random = np.random.default_rng(settings.seed)
        self.vectors = (random.random((settings.buckets, settings.dim), np.float32) - 0.5
                        ) / settings.dim
        self.weights = random.random((2, settings.dim), np.float32) - 0.5
        self.bias = np.zeros(2)
        self.speed = np.full(settings.buckets, 1e-8, np.float32)
        self.weight_speed = np.full((2, settings.dim), 1e-8)

    def learn(self, rows: np.ndarray, shares: np.ndarray, label: int, rate: float) -> None:
        own = self.vectors[rows]
        mean = shares @ own
        logits = self.weights @ mean + self.bias
        chance = np.exp(logits - logits.max())
        error = chance / chance.sum()
        error[label] -= 1.0
        back = (error @ self.weights).astype(np.float32)
        step = np.outer(error, mean)
        self.weight_speed += step * step
        self.weights -= (rate * step / np.sqrt(self.weight_speed)).astype(np.float32)
        self.bias -= 0.1 * rate * error
        self.speed[rows] += shares * shares * float(back @ back)
        self.vectors[rows] = own - np.outer(rate * shares / np.sqrt(self.speed[rows]), back)

    def table(self) -> tuple[np.ndarray, float]:
        """For each bucket the part of its embedding that speaks for toxic; the bias."""
        return ((self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32),
                float(self.bias[1] - self.bias[0]))


def _shares(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, counts = np.unique(bag, return_counts=True)
    return rows, (counts / max(1, len(bag))).astype(np.float32)


def passage_logits(total: np.ndarray, count: np.ndarray, first: np.ndarray, last: np.ndarray,
                   bias: float) -> np.ndarray:
    return (total[last] - total[first]) / np.maximum(1, count[last] - count[first]) + bias


def _hard_passages(bags: Bags, learner: Learner, settings: Settings
                   ) -> list[list[tuple[int, int]]]:
    """The ``hardest`` passages of each text, the worst first, none of which overlap."""
    table, bias = learner.table()
    total, count = bags.summed(table)
    found = []
    for begin, end in zip(bags.texts, bags.texts[1:]):
        first, last = passages(int(end - begin), settings.window)
        first, last = first + begin, last + begin
        logits = passage_logits(total, count, first, last, bias)
        mine = []
        for _ in range(settings.hardest):
            worst = int(logits.argmax())
            if logits[worst] == -np.inf:
                break
            mine.append((int(first[worst]), int(last[worst])))
            logits[max(0, worst - settings.window + 1):worst + settings.window] = -np.inf
        found.append(mine)
    return found


def train_rows(texts: list[str], labels: np.ndarray, settings: Settings) -> Learner:
    """Learn whole texts first, then the passages that are worst under what was learnt so far:
    of a toxic text the worst one has to be toxic, of another one none of them may be."""
    learner, random = Learner(settings), np.random.default_rng(settings.seed)
    parts = [(first, bags_of(part, settings)) for first, part in in_chunks(texts, _CHUNK)]
    for _ in range(settings.warm):
        for k in random.permutation(len(parts)):
            first, bags = parts[k]
            for i in random.permutation(len(bags.texts) - 1):
                learner.learn(*_shares(bags.between(bags.texts[i], bags.texts[i + 1])),
                              labels[first + i], settings.rate)
    for turn in range(settings.rounds):
        chosen = []
        for first, bags in parts:
            for i, hard in enumerate(_hard_passages(bags, learner, settings), first):
                for a, b in hard[:1] if labels[i] else hard:
                    chosen.append((*_shares(bags.between(a, b)), labels[i]))
        rate = settings.rate * (1 - turn / settings.rounds)
        for i in random.permutation(len(chosen)):
            learner.learn(*chosen[i], rate)
    return learner


@dataclass
class Model:
    """One number per bucket, the bias, and slope and shift from the worst passage's logit to
    that of the text."""

    table: np.ndarray
    bias: float
    scale: tuple[float, float]
    settings: Settings

    def worst(self, texts: list[str]) -> np.ndarray:
        """The largest logit of a passage of each text."""
        out = np.empty(len(texts))
        window = self.settings.window
        for at, part in in_chunks(texts, _CHUNK):
            bags = bags_of(part, self.settings)
            total, count = bags.summed(self.table)
            begin, end = bags.texts[:-1], bags.texts[1:]
            number = np.maximum(1, end - begin - window + 1)
            offset = np.concatenate(([0], np.cumsum(number)))
            first = np.arange(offset[-1]) + np.repeat(begin - offset[:-1], number)
            last = np.minimum(first + window, np.repeat(end, number))
            out[at:at + len(part)] = np.maximum.reduceat(
                passage_logits(total, count, first, last, self.bias), offset[:-1])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        slope, shift = self.scale
        return 1 / (1 + np.exp(-np.clip(slope * self.worst(texts) + shift, -500, 500)))


def fit_rows(rows: list[tuple[int, str, int]], settings: Settings) -> Model:
    """Train on (order, text, label) rows."""
    rows = sorted(rows)
    labels = np.array([label for *_, label in rows])
    texts = [text for _, text, _ in rows]
    fold = np.arange(len(rows)) % 5 == 4
    used = np.flatnonzero(~fold)
    aside = np.flatnonzero(fold) if fold.any() else used
    table, bias = train_rows([texts[i] for i in used], labels[used], settings).table()
    model = Model(table, bias, (1.0, 0.0), settings)
    model.scale = sigmoid_scale(
        model.worst([texts[i] for i in aside]), labels[aside] == 1, settings.prior)
    return model


def train(docs: DataFrame, labels: DataFrame, learnable: Column, text: str = "text",
          doc_id: str = "doc_id", label: str = "toxic", settings: Settings = Settings()
          ) -> Model | None:
    """A model learnt from the labelled rows where ``learnable`` (a condition on ``doc_id``) holds.

    None if they hold no label or only one kind. Labels other than 0 and 1, and those without id,
    take no part; an id with several labels is toxic if one says so, and of several texts with
    one id the smallest is read. So the fit, in one task, never reads more than about
    ``per_class`` whole texts of each class, however often rows are repeated.
    """
    spark = docs.sparkSession
    marks, marks_path = staged(labels.select(
        F.col("doc_id"), F.col(f"`{label}`").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(
        F.max("label").alias("label")).where(learnable), "toxic-labels")
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    order = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1 << 30))
    limits = {q: int(min(1.0, settings.per_class / n) * (1 << 30)) for q, n in sizes.items()}
    few = marks.withColumn("ord", order).where(
        F.col("ord") < F.when(F.col("label") == 1, limits[1]).otherwise(limits[0]))
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # about 2 * per_class rows of three numbers
    sample, path = staged(plain.join(F.broadcast(few), "doc_id").groupBy(
        "doc_id", "label", "ord").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(
        "text", "label", "ord"), "toxic-sample")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, t, q) for b in batches for t, q, o in zip(
            *(b.column(i).to_pylist() for i in range(3)))]
        if len({q for *_, q in rows}) < 2:
            return
        model = fit_rows(rows, settings)
        raw = io.BytesIO()
        np.save(raw, model.table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([raw.getvalue()], pa.binary()), pa.array([model.bias]),
             pa.array([model.scale[0]]), pa.array([model.scale[1]])],
            ["table", "bias", "slope", "shift"])

    got = sample.repartition(1).mapInArrow(
        fitted, "table binary, bias double, slope double, shift double").collect()
    for done in (marks_path, path):
        discard(spark, done)
    if not got:
        return None
    return Model(np.load(io.BytesIO(bytes(got[0]["table"]))), got[0]["bias"],
                 (got[0]["slope"], got[0]["shift"]), settings)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5, text: str = "text",
          name: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with the probability of toxic and whether it reaches the threshold.

    Null and empty texts are one passage without subwords. Without a model every score is 0.
    Whole texts are read in the scan's own tasks; the model, a table of fixed size, is broadcast.
    Columns of these two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for batch in batches:
            yield pa.array(own.scores(texts_of(batch)) if own else np.zeros(len(batch)))

    made = free_name(docs, "_score")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (name, predicted)]
    return docs.withColumn(made, scored(F.col(f"`{text}`"))).select(
        *kept, F.col(made).alias(name), (F.col(made) >= threshold).cast("int").alias(predicted))


def classify(docs: DataFrame, labels: DataFrame, learnable: Column, threshold: float = 0.5,
             text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
             settings: Settings = Settings()) -> DataFrame:
    """``docs`` with score and predicted, by a model learnt from the labels where ``learnable``
    holds. Repeated rows stay repeated; an empty table gives an empty one."""
    return score(docs, train(docs, labels, learnable, text, doc_id, label, settings), threshold,
                 text)
