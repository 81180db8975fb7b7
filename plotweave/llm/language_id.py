"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import code_points, free_name, in_chunks, staged, texts_of

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 400_000
_TF_SCALE = 100.0


@dataclass(frozen=True)
class Settings:
    """Features and training. ``buckets`` is a power of two. ``per_language`` bounds the labelled texts fitted on (about so many
    of each language, chosen by a hash of the id); a fifth of them sets the temperature."""

    sizes: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 16
    per_language: int = 800
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    most_languages: int = 1000


def has_letter(text: str) -> bool:
    """Whether a character is a letter; digits, fractions and number forms are none."""
    found = _LETTER.search(text)
    return found is not None and (found.group().isalpha() or any(map(str.isalpha, text)))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased letter for each code point of the basic plane, a space for the others."""
    space = ord(" ")
    table = np.full(1 << 16, space, np.uint32)
    for point in range(1 << 16):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


def grams_of(texts: list[str], settings: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the character n-grams of the texts, an array for each size, and where each text
    begins in all of them (and the end).

    Runs of anything but letters are one space, also around the text, so n-grams know where words
    begin and end. Where no n-gram of a size begins the bucket is ``settings.buckets``.
    """
    points, gaps = code_points(texts, "\x00")
    low = _letters()[np.minimum(points, (1 << 16) - 1)]
    if int(points.max()) >> 16:
        low = np.where(points >> 16, points, low)
    keep = low != 32
    keep[1:] |= low[:-1] != 32
    keep[gaps] = True
    starts = np.concatenate(([0], np.cumsum(keep)))[gaps]
    low = low[keep]
    end = int(starts[-1])
    shift = np.uint32(33 - settings.buckets.bit_length())
    found, value = [], np.zeros(len(low), np.uint32)
    for size in range(1, max(settings.sizes) + 1):
        value = value[:len(low) - size + 1] * np.uint32(0x01000193)
        value += low[size - 1:]
        if size not in settings.sizes:
            continue
        mixed = value ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(0xC2B2AE35)
        buckets = np.full(end, settings.buckets, np.int64)
        size_now = min(end, len(mixed))
        buckets[:size_now] = mixed[:size_now] >> shift
        for back in range(1, size - 1):  # the next text's space may end an n-gram, not stand in it
            over = starts[1:] - back
            buckets[over[over >= 0]] = settings.buckets
        found.append(buckets)
    return found, starts


def document_frequencies(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(bucket, n): how many texts hold an n-gram of the bucket; bucket -1 counts the texts.

    Counted in each task before the shuffle: at most a row per bucket and task.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(settings.buckets, np.int64), 0
        met = np.zeros(settings.buckets + 1, bool)
        for batch in batches:
            texts = texts_of(batch.column(0))
            total += len(texts)
            for _, part in in_chunks(texts, _CHUNK):
                sizes, starts = grams_of(part, settings)
                for a, b in zip(starts, starts[1:]):
                    for buckets in sizes:
                        met[buckets[a:b]] = True
                    n += met[:-1]
                    met[:] = False
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(n[some], total))], ["bucket", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(counted, "bucket long, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n"))


def inverse_frequencies(frequencies: DataFrame, settings: Settings) -> np.ndarray:
    """ln((1 + texts) / (1 + n)) + 1 by bucket; a table of fixed size."""
    rows = frequencies.toArrow()
    buckets, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    total = int(n[buckets == -1].sum())
    counts = np.zeros(settings.buckets)
    counts[buckets[buckets >= 0]] = n[buckets >= 0]
    return (np.log((1 + total) / (1 + counts)) + 1).astype(np.float32)


class Follower:
    """Follow-the-regularised-leader (proximal) for a multinomial logistic loss.

    Each weight keeps its own learning rate; l1 leaves it at zero until its gradients have added
    up to more than that.
    """

    def __init__(self, size: int, classes: int, settings: Settings):
        self.z = np.zeros((size, classes), np.float32)
        self.n = np.zeros((size, classes), np.float32)
        self.s = settings

    def weights(self, rows=slice(None)) -> np.ndarray:
        s, z = self.s, self.z[rows]
        rate = (s.beta + np.sqrt(self.n[rows])) / s.alpha + s.l2
        return np.where(np.abs(z) > s.l1, -(z - np.sign(z) * s.l1) / rate, 0).astype(np.float32)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(rows)
        gradient = softmax(values @ weights)
        gradient[label] -= 1
        step = np.outer(values, gradient).astype(np.float32)
        old = self.n[rows]
        new = old + step * step
        self.z[rows] += step - (np.sqrt(new) - np.sqrt(old)) / self.s.alpha * weights
        self.n[rows] = new


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).sum()

    low, high, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x (buckets, none, bias), with the inverse frequencies inside
    heat: float
    settings: Settings

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.languages)), np.float32)
        for first, part in in_chunks(texts, _CHUNK):
            sizes, starts = grams_of(part, self.settings)
            length = _lengths(sizes, starts, self.settings)
            for c, weights in enumerate(self.weights):
                summed = weights.take(sizes[0])
                for buckets in sizes[1:]:
                    summed += weights.take(buckets)
                out[first:first + len(part), c] = weights[-1] + _TF_SCALE * np.add.reduceat(
                    summed, starts[:-1], dtype=np.float64) / length
        return out


def _lengths(sizes: list[np.ndarray], starts: np.ndarray, settings: Settings) -> np.ndarray:
    """N-grams of each text, one at least."""
    present = sum((b != settings.buckets).astype(np.int64) for b in sizes)
    return np.maximum(1, np.add.reduceat(present, starts[:-1]))


def _features(text: str, idf: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    buckets = np.concatenate(grams_of([text], settings)[0])
    rows, counts = np.unique(buckets[buckets < settings.buckets], return_counts=True)
    values = (_TF_SCALE * counts / max(1, counts.sum()) * idf[rows]).astype(np.float32)
    return np.append(rows, settings.buckets + 1), np.append(values, np.float32(1))


def fit_rows(rows: list[tuple[int, str, str]], languages: list[str], idf: np.ndarray,
             settings: Settings) -> Model:
    """Train on (order, text, language) rows."""
    rows = sorted(rows)
    kept = [(*_features(text, idf, settings), languages.index(lang)) for _, text, lang in rows]
    aside, used = kept[::5], [r for i, r in enumerate(kept) if i % 5]
    if not used:
        used = aside
    learner = Follower(settings.buckets + 2, len(languages), settings)
    shuffle = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for i in shuffle.permutation(len(used)):
            learner.learn(*used[i])
    weights = learner.weights()
    logits = np.array([v @ weights[r] for r, v, _ in aside])
    heat = temperature(logits, np.array([c for *_, c in aside])) if len(languages) > 1 else 1.0
    weights[:-2] *= idf[:, None]
    return Model(languages, np.ascontiguousarray(weights.T), heat, settings)


def train(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang",
          doc_id: str = "doc_id", settings: Settings = Settings()) -> Model | None:
    """A model learnt from the rows where ``learnable`` holds; None if there is no such text.

    Document frequencies count every such text. The regression is fitted on a bounded sample of
    about ``settings.per_language`` texts of each language, whole, in one task; equal rows count
    once there.
    """
    spark = docs.sparkSession
    order = F.pmod(F.xxhash64(F.lit("language"), F.col(f"`{doc_id}`"), F.col(f"`{text}`")),
                   F.lit(1 << 30))
    usable = docs.where(learnable & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()
                        ).select(F.col(f"`{text}`").alias("text"),
                                 F.col(f"`{lang}`").cast("string").alias("lang"),
                                 order.alias("ord"))
    sizes = usable.select("lang", "ord").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "lang").limit(settings.most_languages + 1).collect()
    if not sizes:
        return None
    if len(sizes) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages; see Settings")
    languages = sorted(r["lang"] for r in sizes)
    idf = inverse_frequencies(document_frequencies(usable, "text", settings), settings)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (
        r["lang"], int(min(1.0, settings.per_language / r["n"]) * (1 << 30)))])
    sample, _ = staged(usable.where(F.col("ord") < shares[F.col("lang")]).dropDuplicates(
        ["text", "lang", "ord"]), "language-sample")
    held = spark.sparkContext.broadcast(idf)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, t, l) for b in batches for t, l, o in zip(
            *(b.column(i).to_pylist() for i in range(3)))]
        model = fit_rows(rows, languages, held.value, settings)
        raw = io.BytesIO()
        np.save(raw, model.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([raw.getvalue()], pa.binary()), pa.array([model.heat])], ["weights", "heat"])

    got = sample.repartition(1).mapInArrow(fitted, "weights binary, heat double").first()
    held.unpersist()
    return Model(languages, np.load(io.BytesIO(bytes(got["weights"]))), got["heat"], settings)


def predict(docs: DataFrame, model: Model | None, text: str = "text",
            lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there
    is no model. Whole texts are read in the scan's own tasks; the model, a table of fixed size,
    is broadcast. Columns of these two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for batch in batches:
            texts = texts_of(batch)
            known = [i for i, t in enumerate(texts) if own and has_letter(t)]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if known:
                p = softmax(own.logits([texts[i] for i in known]).astype(np.float64) / own.heat)
                best = p.argmax(axis=1)
                for i, c in zip(known, best):
                    names[i] = own.languages[c]
                scores[known] = p[np.arange(len(known)), best]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    made = free_name(docs, "_language")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (lang_pred, score)]
    return docs.withColumn(made, predicted(F.col(f"`{text}`"))).select(
        *kept, F.col(f"{made}.lang_pred").alias(lang_pred), F.col(f"{made}.score").alias(score))


def identify(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang",
             doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with lang_pred and score, by a model learnt from the rows where ``learnable``
    holds (with text and language). Repeated rows stay repeated; an empty table gives an empty
    one; see :func:`predict` for null and letterless texts. Ids only choose the sample."""
    return predict(docs, train(docs, learnable, text, lang, doc_id, settings), text)


def keep_documents(docs: DataFrame, learnable: Column, least: float = 0.5, text: str = "text",
                   lang: str = "lang", doc_id: str = "doc_id",
                   settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with a determined language of at least that score, columns unchanged."""
    model = train(docs, learnable, text, lang, doc_id, settings)
    row = free_name(docs, "_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row),
                         F.col(f"`{text}`").alias("text"))
    judged = predict(packed, model).where(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return judged.select(f"{row}.*")
