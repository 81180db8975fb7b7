"""Toxicity: subwords, one training step and passages against plain loops, then held-out labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import toxicity as T
from plotweave.llm.common import remainder, table

SMALL = T.Settings(buckets=1 << 12, per_class=300, warm=1, rounds=4)


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isalnum():
            word += c.lower()[0]
        elif word:
            out, word = [*out, word], ""
    return out


def plain_pieces(word, sizes):
    marked = f" {word} "
    return [marked[i:i + n] for n in sizes for i in range(len(marked) - n + 1)] + [word]


def test_subwords():
    texts = ["", "a", "No way, NO!", "idiot-idiots", "x" * 40, "Éa ñ 42", "\U0001d400b c", "a b c d"]
    bags = T.bags_of(texts, T.Settings())
    seen = {}
    for i, text in enumerate(texts):
        words = plain_words(text)
        begin, end = bags.texts[i], bags.texts[i + 1]
        assert end - begin == len(words)
        for k, word in enumerate(words):
            own = bags.between(begin + k, begin + k + 1)
            pieces = plain_pieces(word, (3, 4, 5))
            assert len(own) == len(pieces), (text, word)
            for piece, bucket in zip(pieces[:-1], own):
                assert seen.setdefault(piece, bucket) == bucket
            assert seen.setdefault(("word", word), own[-1]) == own[-1]
    assert len(set(seen.values())) > 0.99 * len(seen)


def test_one_step_is_that_of_the_plain_gradient():
    learner = T.Learner(SMALL)
    rows, shares = T._shares(np.array([5, 9, 9, 700]))
    vectors, weights = learner.vectors[rows].astype(float), learner.weights.astype(float)
    learner.learn(rows, shares, 1, 0.1)

    def loss(v, w):
        z = w @ (shares @ v)
        return np.log(np.exp(z).sum()) - z[1]

    for place in ((0, 0), (1, 3), (2, 7)):
        moved = vectors.copy()
        moved[place] += 1e-6
        slope = (loss(moved, weights) - loss(vectors, weights)) / 1e-6
        change = learner.vectors[rows][place] - vectors[place]
        assert np.sign(change) == -np.sign(slope) or abs(slope) < 1e-4
    for place in ((0, 2), (1, 6)):
        moved = weights.copy()
        moved[place] += 1e-6
        slope = (loss(vectors, moved) - loss(vectors, weights)) / 1e-6
        assert np.isclose(learner.weights[place] - weights[place], -0.1 * np.sign(slope), atol=0.02)


def test_worst_passage_is_that_of_a_plain_loop():
    rng = np.random.default_rng(3)
    settings = T.Settings(buckets=1 << 12, window=3)
    model = T.Model(rng.normal(size=1 << 12).astype(np.float32), -0.25, (2.0, 0.5), settings)
    texts = ["", "one", "one two", "a b c d e f g", "é " * 50 + "end", "x" * 500]
    expected = []
    for text in texts:
        bags = T.bags_of([text], settings)
        words = int(bags.texts[1])
        best = -np.inf
        for first in range(max(1, words - 2)):
            bag = bags.between(first, min(first + 3, words))
            best = max(best, (model.table[bag].mean() if len(bag) else 0) - 0.25)
        expected.append(best)
    assert np.allclose(model.worst(texts), expected, atol=1e-5)
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-(2 * np.array(expected) + 0.5))))
    assert np.allclose(model.worst(texts), [model.worst([t])[0] for t in texts])


def noisy(rng, words, bad):
    text = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
    if bad:
        for _ in range(max(1, len(text) // 40)):
            text[rng.randrange(len(text))] = bad
    return " ".join(text)


def test_unseen_misspellings_are_caught():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = [(i, noisy(rng, words, rng.choice(["worthless", "pathetic"]) if i % 4 == 0 else None),
             int(i % 4 == 0)) for i in range(600)]
    model = T.fit_rows(rows, SMALL)
    bad = [noisy(rng, words, w) for w in ("worthles", "patheticc", "worthlesss", "pathetik")
           for _ in range(10)]
    good = [noisy(rng, words, None) for _ in range(100)]
    assert (model.scores(bad) >= 0.5).mean() > 0.9
    assert (model.scores(good) >= 0.5).mean() < 0.05


def test_held_out_labels(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    scored = T.classify(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    found = scored.join(labels, "doc_id").where(remainder(F.col("doc_id"), 5) == 0).select(
        "toxic", "predicted", "score").toPandas()
    assert ((found.predicted == found.toxic).mean()) > 0.88
    assert found[found.toxic == 0].predicted.mean() < 0.05
    high, low = found[found.toxic == 1].score, found[found.toxic == 0].score
    assert np.mean([(h > low).mean() for h in high]) > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "bad worthless", 0), (1, "bad worthless", 0), (None, None, 1), (2, "", 2),
         (3, "fine day", 3), (3, "other text", 3), (4, "w " * 300_000, 4)],
        "doc_id bigint, text string, score int").withColumn("Predicted", F.lit("x"))
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (3, 0), (3, None), (None, 1), (2, 7), (2, 0)], "doc_id bigint, toxic int")
    scored = T.classify(docs, labels, F.lit(True), settings=SMALL)
    assert sorted(scored.columns) == ["doc_id", "predicted", "score", "text"]
    rows = scored.collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(None, 0), (1, None)]])
def test_without_both_labels_nothing_is_toxic(spark, marks):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    assert {(r["score"], r["predicted"]) for r in T.classify(
        docs, labels, F.lit(True)).collect()} == {(0.0, 0)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    assert T.classify(docs, labels, F.lit(True)).count() == 0
