"""Quality classifier: naive Bayes support vectors on n-gram indicators."""

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

_CHUNK = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Features and training. ``buckets`` is a power of two. ``per_class`` bounds the labelled
    texts fitted on (about so many of each class, by a hash of the id); a fifth sets the scale of
    the scores. ``blend`` is the part of the support vectors against their mean size."""

    word_sizes: tuple[int, ...] = (1, 2)
    shape_sizes: tuple[int, ...] = (2, 3, 4)
    mark_sizes: tuple[int, ...] = (1, 2, 4)
    buckets: int = 1 << 17
    per_class: int = 2000
    smoothing: float = 1.0
    cost: float = 1.0
    passes: int = 20
    tolerance: float = 1e-3
    blend: float = 0.75


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points of the basic plane: lower case, and shape (a letter's case, 0 for digits,
    one space for white space, else the character)."""
    lower = np.arange(1 << 16, dtype=np.uint32)
    shape = lower.copy()
    for point in range(1 << 16):
        char = chr(point)
        if char.isalpha():
            lower[point] = ord(char.lower()[0])
            shape[point] = ord("A" if char.isupper() else "a")
        elif char.isdigit():
            shape[point] = ord("0")
        elif char.isspace():
            lower[point] = shape[point] = 32
    return lower, shape


def _mixed(values: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    out = (values + np.uint64(kind)) * _MIX
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _runs(values: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...], kind: int,
          buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """n-grams of a sequence within each text: buckets and bounds, for each size."""
    found, grown = [], np.zeros(len(values), np.uint64)
    for size in range(1, max(sizes, default=0) + 1):
        grown = grown[:max(0, len(values) - size + 1)] * np.uint64(0x100000001B3) + values[size - 1:]
        if size in sizes:
            first = np.minimum(starts[:-1], len(grown))
            last = np.clip(starts[1:] - size + 1, first, len(grown))
            found.append((_mixed(grown, kind + size, buckets), np.stack((first, last))))
    return found


def indicators_of(texts: list[str], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of buckets and of their bounds (first and last position of each text).

    Three sequences give n-grams: the lower-cased words; the shapes of the characters with
    longer runs cut to two, so that letters of any word look alike; and marks for each word that
    say whether it equals the one before. A text has an n-gram or not; how often does not matter.
    """
    points, gaps = code_points(texts, "\x00")
    lower, shape = _tables()
    small = np.minimum(points, (1 << 16) - 1)
    low, form = lower[small], shape[small]
    if int(points.max()) >> 16:
        wide = points >> 16 > 0
        low, form = np.where(wide, points, low), np.where(wide, points, form)
    low[gaps] = form[gaps] = 32

    blank = low == 32
    begins = ~blank
    begins[1:] &= blank[:-1]
    begin = np.flatnonzero(begins)
    if len(begin):
        at = np.arange(len(low))
        place = (at - np.maximum.accumulate(np.where(begins, at, 0))).astype(np.uint64)
        term = (low.astype(np.uint64) + np.uint64(1)) * _MIX
        term ^= term >> np.uint64(31)
        term *= (np.uint64(2) * place + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
        term[blank] = 0
        words = np.add.reduceat(term, begin)
        words ^= words >> np.uint64(32)
    else:
        words = np.zeros(0, np.uint64)
    word_starts = np.searchsorted(begin, gaps)
    same = np.zeros(len(words), np.uint64)
    if len(words) > 1:
        same[1:] = words[1:] == words[:-1]
    same[word_starts[:-1][word_starts[:-1] < len(words)]] = 0

    keep = np.ones(len(form), bool)
    keep[2:] = (form[2:] != form[1:-1]) | (form[2:] != form[:-2])
    keep[gaps] = True
    form_starts = np.concatenate(([0], np.cumsum(keep)))[gaps]
    form = form[keep].astype(np.uint64)
    return (_runs(words, word_starts, settings.word_sizes, 1000, settings.buckets)
            + _runs(form, form_starts, settings.shape_sizes, 2000, settings.buckets)
            + _runs(same, word_starts, settings.mark_sizes, 3000, settings.buckets))


def _each(parts: list[tuple[np.ndarray, np.ndarray]], count: int) -> Iterator[list[np.ndarray]]:
    for i in range(count):
        yield [buckets[bounds[0, i]:bounds[1, i]] for buckets, bounds in parts]


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> np.ndarray:
    """ln of the share of each n-gram among those of good texts over that among the others'."""
    shares = []
    for sign in (True, False):
        counts = np.full(settings.buckets, settings.smoothing)
        for row, label in zip(rows, labels):
            if label == sign:
                counts[row] += 1
        shares.append(counts / counts.sum())
    return np.log(shares[0] / shares[1]).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray,
                            settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias with the least hinge loss plus half their squares.

    One dual variable per text, between 0 and cost; each step solves for one of them exactly and
    moves the weights by its change, until no projected gradient is far from zero. A text's
    features are the ratios of its n-grams, scaled to length one, and a constant one.
    """
    sign = np.where(labels, 1.0, -1.0)
    values = []
    for row in rows:
        own = ratios[row]
        values.append(own / max(1e-9, float(np.sqrt(own @ own))))
    square = np.array([float(v @ v) + 1.0 for v in values])
    dual, weights, bias = np.zeros(len(rows)), np.zeros(len(ratios)), 0.0
    shuffle = np.random.default_rng(0)
    for _ in range(settings.passes):
        worst = 0.0
        for i in shuffle.permutation(len(rows)):
            row, own = rows[i], values[i]
            slope = sign[i] * (float(weights[row] @ own) + bias) - 1.0
            projected = slope
            if dual[i] <= 0:
                projected = min(slope, 0.0)
            elif dual[i] >= settings.cost:
                projected = max(slope, 0.0)
            worst = max(worst, abs(projected))
            if abs(projected) > 1e-12:
                new = min(max(dual[i] - slope / square[i], 0.0), settings.cost)
                step = (new - dual[i]) * sign[i]
                weights[row] += step * own
                bias += step
                dual[i] = new
        if worst < settings.tolerance:
            break
    return weights, bias


def sigmoid_scale(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits the labels, whose good part counts
    with ``share``; Newton's method on smoothed targets."""
    good, bad = int(labels.sum()), int((~labels).sum())
    target = np.where(labels, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(labels, share / max(1, good), (1 - share) / max(1, bad)) * len(labels)
    a, b = 1.0, 0.0

    def loss(a, b):
        z = a * margins + b
        return float(np.sum(weight * (np.logaddexp(0, z) - target * z))) + 1e-6 * (a * a + b * b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        gradient, curve = weight * (p - target), weight * p * (1 - p)
        g = np.array([gradient @ margins + 2e-6 * a, gradient.sum() + 2e-6 * b])
        h = np.array([[curve @ margins ** 2 + 1e-5, curve @ margins], [curve @ margins,
                                                                       curve.sum() + 1e-5]])
        step, now, size = np.linalg.solve(h, g), loss(a, b), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: tuple[float, float]
    settings: Settings

    def margins(self, texts: list[str]) -> np.ndarray:
        """Signed distance of each text: features are scaled to length one as in training."""
        out = np.empty(len(texts))
        met = np.zeros(self.settings.buckets, bool)
        for first, part in in_chunks(texts, _CHUNK):
            parts = indicators_of(part, self.settings)
            for i, own in enumerate(_each(parts, len(part))):
                for buckets in own:
                    met[buckets] = True
                rows = np.flatnonzero(met)
                met[rows] = False
                pair = self.weights[:, rows].sum(axis=1, dtype=np.float64)
                out[first + i] = pair[0] / max(1e-9, np.sqrt(pair[1])) + self.bias
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts) + b, -500, 500)))


def _rows_of(texts: list[str], settings: Settings) -> list[np.ndarray]:
    return [np.unique(np.concatenate(own)) for _, part in in_chunks(texts, _CHUNK)
            for own in _each(indicators_of(part, settings), len(part))]


def fit_rows(rows: list[tuple[int, str, int]], share: float, settings: Settings) -> Model:
    """Train on (order, text, quality) rows; ``share`` is the good part of all labelled texts."""
    rows = sorted(rows)
    labels = np.array([q == 1 for *_, q in rows], bool)
    found = _rows_of([t for _, t, _ in rows], settings)
    fold = np.arange(len(rows)) % 5 == 4
    used = np.flatnonzero(~fold)

    def fitted(which: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        part, marks = [found[i] for i in which], labels[which]
        ratios = log_count_ratios(part, marks, settings)
        weights, bias = dual_coordinate_descent(part, ratios, marks, settings)
        mean = np.abs(weights).mean()
        blended = settings.blend * weights + (1 - settings.blend) * mean
        return np.stack((blended * ratios, ratios.astype(np.float64) ** 2)), bias, ratios

    table, bias, _ = fitted(used)
    aside = np.flatnonzero(fold) if fold.any() else used
    pairs = np.array([table[:, found[i]].sum(axis=1) for i in aside]).reshape(-1, 2)
    margins = pairs[:, 0] / np.maximum(1e-9, np.sqrt(pairs[:, 1])) + bias
    scale = sigmoid_scale(margins, labels[aside], share)
    return Model(table.astype(np.float32), bias, scale, settings)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, text: str = "text",
          doc_id: str = "doc_id", settings: Settings = Settings()) -> Model | None:
    """A model learnt from the labelled rows where ``learnable`` (a condition on ``doc_id``) holds.

    None if they hold no label or only one kind. Labels other than 0 and 1, and those without id,
    take no part; a document with several counts as good if one says so. The fit, ratios
    included, is on a bounded sample of about ``per_class`` whole labelled texts of each class; of
    several texts with one id the smallest is read.
    """
    spark = docs.sparkSession
    marks, _ = staged(labels.select(F.col("doc_id"), F.col("quality")).where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.max("quality").alias("quality")).where(learnable), "quality-labels")
    sizes = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    order = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 30))
    limits = {q: int(min(1.0, settings.per_class / n) * (1 << 30)) for q, n in sizes.items()}
    few = marks.withColumn("ord", order).where(
        F.col("ord") < F.when(F.col("quality") == 1, limits[1]).otherwise(limits[0]))
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # about 2 * per_class rows of two numbers
    sample, _ = staged(plain.join(F.broadcast(few), "doc_id").groupBy(
        "doc_id", "quality", "ord").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(
        "text", "quality", "ord"), "quality-sample")
    share = sizes[1] / (sizes[0] + sizes[1])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, t or "", q) for b in batches for t, q, o in zip(
            *(b.column(i).to_pylist() for i in range(3)))]
        if len({q for *_, q in rows}) < 2:
            return
        model = fit_rows(rows, share, settings)
        raw = io.BytesIO()
        np.save(raw, model.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([raw.getvalue()], pa.binary()), pa.array([model.bias]),
             pa.array([model.scale[0]]), pa.array([model.scale[1]])],
            ["weights", "bias", "slope", "shift"])

    got = sample.repartition(1).mapInArrow(
        fitted, "weights binary, bias double, slope double, shift double").collect()
    if not got:
        return None
    return Model(np.load(io.BytesIO(bytes(got[0]["weights"]))), got[0]["bias"],
                 (got[0]["slope"], got[0]["shift"]), settings)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, text: str = "text",
          name: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with the probability of good quality and whether it reaches the threshold.

    Null and empty texts are texts without n-grams. Without a model every score is 0.5. Whole
    texts are read in the scan's own tasks; the model, two tables of fixed size, is broadcast.
    Columns of these two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for batch in batches:
            yield pa.array(own.scores(texts_of(batch)) if own else np.full(len(batch), 0.5))

    made = free_name(docs, "_score")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (name, predicted)]
    return docs.withColumn(made, scored(F.col(f"`{text}`"))).select(
        *kept, F.col(made).alias(name), (F.col(made) >= threshold).cast("int").alias(predicted))


def classify(docs: DataFrame, labels: DataFrame, learnable: Column, threshold: float = 0.3,
             text: str = "text", doc_id: str = "doc_id",
             settings: Settings = Settings()) -> DataFrame:
    """``docs`` with score and predicted, by a model learnt from the labels where ``learnable``
    holds. Repeated rows stay repeated; an empty table gives an empty one."""
    return score(docs, train(docs, labels, learnable, text, doc_id, settings), threshold, text)
