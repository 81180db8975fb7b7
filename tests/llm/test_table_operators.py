"""Operators that relate rows: near-duplicates, top-k, mixing, packing, classifiers."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plotweave.llm import (components, exact_topk, language_id, mixing, packing, quality_nb,
                           simhash)
from plotweave.llm.common import remainder

# --- SimHash -----------------------------------------------------------------------------------


def plain_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words, word = [], ""
    for c in (text or "").translate(table) + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance):
    """Smallest index reachable, over all pairs."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t", "A", "a b", "É é É", "A\x85b\xa0c d", "w " * 9]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(40))) for _ in range(60)]
    for text in texts:
        assert simhash.fingerprint_of((text or "").encode()) == plain_fingerprint(text), text


@pytest.mark.parametrize("distance,blocks,crowded", [(2, 4, 32), (2, 4, 2), (2, 3, 1), (1, 3, 2),
                                                     (1, 4, 1), (2, 6, 4), (0, 2, 1)])
def test_links_reach_what_all_pairs_reach(spark, distance, blocks, crowded):
    rng = random.Random(distance * 10 + blocks)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(30)):
            value = centre
            for _ in range(rng.randrange(5)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "print long")
    linked = {r["node"]: r["component"] for r in components.connected(
        simhash.close_links(rows, distance, blocks, crowded)).collect()}
    want = plain_classes(prints, distance)
    got = [linked.get(p, p) for p in signed]
    for i in range(len(prints)):
        for j in range(i):
            assert (want[i] == want[j]) == (got[i] == got[j])


def near_copies():
    rng = random.Random(4)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(i % 3):
            own[rng.randrange(400)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((100 + i, " ".join(own)))
    rows += [(500 + i, " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(30))) for i in range(40)]
    return rows + [(7, None), (8, ""), (9, " \n"), (3, rows[0][1]), (3, rows[0][1])]


def test_classes_match_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, print int")
    ordered = sorted(rows, key=lambda r: r[0])
    prints = [plain_fingerprint(t) for _, t in ordered]
    want = sorted((ordered[i][0], simhash._signed(prints[i]), ordered[c][0])
                  for i, c in enumerate(plain_classes(prints, 2)))
    got = simhash.near_duplicate_classes(docs)
    assert sorted(map(tuple, got.collect())) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in want})


def test_documents_without_ids(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (5, "q r s t u")],
        "doc_id long, text string")
    got = sorted(map(str, (tuple(r)[::2] for r in simhash.near_duplicate_classes(docs).collect())))
    assert got == ["(5, 5)", "(None, 5)", "(None, None)", "(None, None)"]
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(map(str, map(tuple, kept))) == ["(5, 'q r s t u')", "(None, 'a b c d')"]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicate_classes(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1001), (None, 5), (1001, 1000)]
    random.Random(1).shuffle(edges)
    got = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(i, 0) for i in range(201)} | {(1000, 1000), (1001, 1000)}
    assert len(got) == 203


# --- Exact top-k -------------------------------------------------------------------------------


def plain_top(rows, k):
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
              if i is not None and v is not None
              and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in usable if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("lists", [1, 2, 3, 64])
def test_top_k_matches_brute_force(spark, lists):
    rng = np.random.default_rng(lists)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # ties
    rows += [(500, None), (520, [float("nan")] * 8), (540, [None] * 8), (None, rows[0][1]),
             (560, [float("inf")] + [0.0] * 7), (580, []), (600, [1.0, 2.0]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows],
                               "vec_id long, embedding array<float>, score int").repartition(5)
    got = exact_topk.top_k(df, F.col("vec_id") % 20 == 0, 20, lists=lists, chunk_rows=9)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 20)


def test_top_k_of_few_and_of_large_numbers(spark):
    rows = [(i, [5e5 * (i + 1), -3e6]) for i in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, F.col("vec_id") % 20 == 0, 40)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 40)
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0
    assert exact_topk.top_k(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0, 5).count() == 0
    with pytest.raises(ValueError):
        exact_topk.top_k(spark.createDataFrame([(0, [3e7] * 2)], df.schema), F.lit(True), 1,
                         scale=64.0)


# --- Mixing ------------------------------------------------------------------------------------


def mixed_docs(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)) + ("\nx" if i % 3 else ""),
             rng.choice(["en", "en", "fr", None]), rng.choice(["a"] * 4 + ["b", "c", None]))
            for i in range(3000)]
    rows += [(5000, None, "en", "a"), (5001, " ", "en", "a"), (None, "a b", "fr", "zz"), (1, *rows[1][1:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_raked_weights_meet_the_targets(spark):
    docs = mixed_docs(spark)
    marked, cell = mixing.sampled(docs, mixing.Plan(flatten=0.5, keep=0.6, rounds=20))
    assert marked.columns[:-1] == docs.columns
    rows = [r[cell] for r in marked.collect()]
    assert len(rows) == docs.count()
    total = sum(r["n_tokens"] for r in rows)
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(0.6 * total)
    assert all(0 <= r["probability"] <= 1 for r in rows)
    taken = sum(r["n_tokens"] for r in rows if r["sampled"])
    assert taken == pytest.approx(0.6 * total, rel=0.05)
    assert not any(r["sampled"] for r in rows if not r["n_tokens"])
    for r in rows:
        assert r["sampled"] == (r["n_tokens"] > 0 and r["draw"] < r["probability"])
    again = mixing.sample_documents(docs.repartition(7), mixing.Plan(0.5, 0.6, 20))
    assert again.columns == docs.columns
    assert again.count() == sum(r["sampled"] for r in rows)


def test_raking_alone(spark):
    cells = spark.createDataFrame(
        [("a", "en", "t", 100), ("a", "fr", "t", 300), ("b", "en", "u", 50), ("b", "fr", "t", 10)],
        "source string, language string, topic string, tokens long")
    targets = {"source": [("a", .1), ("b", .7), ("none", 5.), ("a", .2), ("b", None), ("b", -1.)],
               "language": [("en", 2.), ("fr", 2.)]}
    frames = {m: spark.createDataFrame(t, f"{m} string, target double") for m, t in targets.items()}
    got = mixing.rake(cells, frames, 60).collect()
    sums = {}
    for r in got:
        for m in targets:
            sums[r[m]] = sums.get(r[m], 0) + r["weight"]
    assert sums == pytest.approx({"a": .3, "b": .7, "en": .5, "fr": .5})


def test_scarce_categories_are_taken_whole_and_the_rest_meets_its_targets(spark):
    """Language x is scarcer than its target: it is wanted whole, y and z share the rest as their
    targets say, and the sources, which have room, meet theirs exactly."""
    sizes = {("a", "x"): 60, ("a", "y"): 300, ("a", "z"): 240, ("b", "x"): 40, ("b", "y"): 260,
             ("b", "z"): 100}
    docs = spark.createDataFrame(
        [(i, "w " * n, lang, source) for i, ((source, lang), n) in enumerate(sizes.items())],
        "doc_id long, text string, lang string, source string")
    targets = {"source": [("=a", .55), ("=b", .45)],
               "language": [("=x", .3), ("=y", .4), ("=z", .3)]}
    frames = {m: spark.createDataFrame(t, f"{m} string, target double") for m, t in targets.items()}
    plan = mixing.Plan(keep=0.6, rounds=12)
    got = {r["category"]: r for r in mixing.shares(docs, plan, frames).collect()}
    want = {"=a": .55, "=b": .45, "=x": 1 / 6, "=y": 5 / 6 * 4 / 7, "=z": 5 / 6 * 3 / 7, "other": 1}
    assert {c: r["sample"] for c, r in got.items()} == pytest.approx(want, abs=1e-6)
    assert {c: r["target"] for c, r in got.items()} == pytest.approx(
        {"=a": .55, "=b": .45, "=x": .3, "=y": .4, "=z": .3, "other": 1})
    marked, cell = mixing.sampled(docs, plan, frames)
    rows = [r[cell] for r in marked.collect()]
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(600)
    assert all(r["probability"] == pytest.approx(1) for r in rows if r["language"] == "=x")
    after = mixing.shares(docs, mixing.Plan(keep=0.6, rounds=12, within=False), frames).collect()
    assert max(abs(r["sample"] - want[r["category"]]) for r in after) > 0.005


def test_mixing_an_empty_table_and_clashing_names(spark):
    docs = mixed_docs(spark).withColumn("_cell", F.lit(1)).withColumn("probability", F.lit("p"))
    assert mixing.sample_documents(docs.limit(0)).count() == 0
    assert mixing.sample_documents(docs).columns == docs.columns


# --- Packing -----------------------------------------------------------------------------------


def test_bins_hold_what_they_say():
    rng = np.random.default_rng(1)
    lengths = packing.Lengths(sizes=(64, 128, 256), overhead=4, attention=4096)
    for n in (1, 5, 400):
        sizes = rng.integers(1, 257, n)
        bins, final = packing.pack(sizes, lengths)
        filled = np.bincount(bins, weights=sizes)
        assert (filled <= final).all() and len(filled) == len(final)
        for load, size in zip(filled, final):
            assert size == min(s for s in lengths.sizes if s >= load)
        alone = sum(lengths.cost(min(s for s in lengths.sizes if s >= x)) for x in sizes.tolist())
        assert sum(lengths.cost(int(s)) for s in final) <= alone
        # best fit: as good as a plain search over all open bins
        for largest in lengths.sizes:
            assert plain_best_fit(sizes, lengths, largest) == packing.best_fit(
                sizes, lengths, largest)[0].tolist()


def plain_best_fit(sizes, lengths, largest):
    rooms, out, left = [], [0] * len(sizes), int(sizes.sum())
    touched, clock = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = int(sizes[i])
        able = [b for b in range(len(rooms)) if rooms[b] >= size]
        if able:
            least = min(rooms[b] for b in able)
            own = max((b for b in able if rooms[b] == least), key=lambda b: touched[b])
        else:
            some = [s for s in sorted(lengths.sizes) if s >= size]
            some = [s for s in some if s <= largest] or some[:1]
            rooms.append(min(some, key=lambda s: (lengths.cost(s) / min(s, left), s)))
            touched.append(0)
            own = len(rooms) - 1
        rooms[own] -= size
        clock += 1
        touched[own] = clock
        left -= size
        out[i] = own
    return out


def test_packing_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 20, 100, 700]))) for i in range(500)]
    rows += [(900, None), (901, " \n"), (None, "a b c"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))
    lengths = packing.Lengths(sizes=(32, 64, 256), block=200)
    got = packing.pack_documents(docs, lengths=lengths).collect()
    tokens, bins = {}, {}
    for r in got:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            bins.setdefault(r["bin_id"], []).append(r)
    want = {}
    for i, t in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert tokens == want
    for own in bins.values():
        load = sum(r["n_tokens"] + 1 for r in own)
        assert {r["bin_tokens"] for r in own} == {load}
        assert {r["bin_length"] for r in own} == {min(s for s in lengths.sizes if s >= load)}
        assert sorted(r["place"] for r in own) == list(range(len(own)))
    again = packing.pack_documents(docs.repartition(6), lengths=lengths).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert packing.pack_documents(docs.limit(0), lengths=lengths).count() == 0


def test_packing_spreads_repeated_rows(spark, monkeypatch):
    """A row repeated without end fills many blocks, none of them beyond its size."""
    monkeypatch.setattr(packing, "COPIES_A_RUN", 70)
    rows = [(None, "a b c")] * 1500 + [(7, "d e")] * 70 + [(i, "x y z") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lengths = packing.Lengths(sizes=(8, 16), block=100)
    got = packing.pack_documents(docs, lengths=lengths).collect()
    assert len(got) == len(rows)
    assert sum(r["doc_id"] is None for r in got) == 1500
    assert sum(r["doc_id"] == 7 for r in got) == 70
    blocks = {}
    for r in got:
        blocks.setdefault(r["bin_id"].split("-")[0], []).append(r["doc_id"])
    assert len(blocks) == -(-len(rows) // 100)
    assert max(map(len, blocks.values())) < 200
    again = packing.pack_documents(docs.repartition(5), lengths=lengths).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


# --- Classifiers -------------------------------------------------------------------------------

ALPHABETS = {"xx": "abcde", "yy": "efghi", "zz": "ijkàé"}


def spoken(rng, lang, words=40):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(2, 8)))
                    for _ in range(words))


def test_languages_are_told_apart(spark):
    rng = random.Random(6)
    rows = [(i, spoken(rng, lang), lang) for i in range(450) for lang in [rng.choice(list(ALPHABETS))]]
    rows += [(1000, None, "xx"), (1001, "12 -- !", "xx"), (1002, "", None),
             (1003, spoken(rng, "yy", 30000), None), (None, spoken(rng, "zz"), "zz"), (1, *rows[1][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn(
        "SCORE", F.lit("clash"))
    got = language_id.identify(docs, remainder(F.col("doc_id"), 4) != 2).collect()
    assert len(got) == len(rows)
    pairs = [(r, a) for r, a in zip(got, rows) if a[1] and len(a[1]) > 20]
    held = [r["lang_pred"] == a[2] for r, a in pairs
            if a[2] and a[0] is not None and zlib.crc32(str(a[0]).encode()) % 4 == 2]
    assert np.mean(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "yy"]
    assert all(0 <= r["score"] <= 1 for r in got) and by[1000]["score"] == 0
    kept = language_id.keep_documents(docs, remainder(F.col("doc_id"), 4) != 2)
    assert kept.columns == docs.columns
    assert {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect())
    nothing = language_id.identify(docs, F.lit(False)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language_id.identify(docs.limit(0), F.lit(True)).count() == 0


def test_grams_stay_within_their_text():
    settings = language_id.Settings()
    texts = ["ab c", "", "\x00x--yz", "日本 \U00020000", " ", "a"]
    sizes, starts = language_id.grams_of(texts, settings)
    for i, text in enumerate(texts):
        alone, _ = language_id.grams_of([text], settings)
        for many, one in zip(sizes, alone):
            assert many[starts[i]:starts[i + 1]].tolist() == one.tolist()


def test_follower_learns_sparse_weights():
    settings = language_id.Settings(l1=0.5)
    learner = language_id.Follower(50, 2, settings)
    rng = np.random.default_rng(0)
    for _ in range(400):
        label = int(rng.integers(2))
        rows = np.unique(np.append(rng.integers(2, 50, 5), label))
        learner.learn(rows, np.ones(len(rows), np.float32), label)
    weights = learner.weights()
    assert weights[0, 0] > 0.5 and weights[1, 1] > 0.5
    assert (weights[2:] == 0).mean() > 0.3


def test_quality_is_learnt(spark):
    rng = random.Random(8)

    def text(good):
        words = spoken(rng, "xx").split()
        return " ".join(words if good else [w + "!!" if i % 3 else w for i, w in enumerate(words)])

    rows = [(i, text(i % 4 > 0)) for i in range(500)]
    rows += [(700, None), (701, ""), (702, "w " * 30000), (None, "a"), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(5))
    labels = spark.createDataFrame(
        [(i, int(i % 4 > 0)) for i in range(500)] + [(None, 1), (3, None), (2, 7), (1, 1)],
        "doc_id long, quality int")
    got = quality_nb.classify(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    assert got.columns == ["doc_id", "text", "quality", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows)
    right = [r["predicted"] == int(r["doc_id"] % 4 > 0) for r in found
             if r["doc_id"] is not None and r["doc_id"] < 500
             and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    one_kind = quality_nb.classify(docs, labels.where("quality = 1"), F.lit(True)).collect()
    assert {r["score"] for r in one_kind} == {0.5}
    assert quality_nb.classify(docs.limit(0), labels.limit(0), F.lit(True)).count() == 0


def test_indicators_stay_within_their_text():
    settings = quality_nb.Settings()
    texts = ["ab c c c", "", "\x00xyz", "日本 ", "A!! B!!", " ", "c"]
    together = list(quality_nb._each(quality_nb.indicators_of(texts, settings), len(texts)))
    for text, own in zip(texts, together):
        alone = next(quality_nb._each(quality_nb.indicators_of([text], settings), 1))
        assert [a.tolist() for a in own] == [a.tolist() for a in alone]


def test_dual_descent_separates():
    settings = quality_nb.Settings(buckets=64, cost=10.0, passes=200)
    rows = [np.array(r) for r in ([1, 5], [1, 6], [2, 5], [2, 6])]
    labels = np.array([True, True, False, False])
    ratios = np.ones(64, np.float32)
    weights, bias = quality_nb.dual_coordinate_descent(rows, ratios, labels, settings)
    margins = [weights[r].sum() / 2 ** 0.5 + bias for r in rows]
    assert margins == pytest.approx([1, 1, -1, -1], abs=0.02)


def test_number_forms_are_no_letters(spark):
    rows = [(i, "the words of the text " + "abc " * 5, "en") for i in range(40)]
    rows += [(i, "das sind die und der " + "xyz " * 5, "de") for i in range(40, 80)]
    rows += [(100, "½ ²", None), (101, "Ⅷ 12", None), (102, "ª", None), (103, "Ⅷ das", None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(
        docs, F.col("doc_id") < 100).where("doc_id >= 100").collect()}
    assert found[100] == found[101] == ("und", 0.0)
    assert found[102][0] != "und" and found[103][0] == "de"


@pytest.mark.parametrize("fit", ["quality", "language"])
def test_repeated_rows_do_not_enlarge_the_fit(spark, fit, monkeypatch):
    """A text that is in the table thousands of times is read once by the one task that fits."""
    rows = [(1, "one text of them", "en")] * 3000 + [(2, "ein anderer Text", "de")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    module = quality_nb if fit == "quality" else language_id
    plain = module.staged

    def watched(df, name):
        held = plain(df, name)
        if name.endswith("sample"):
            seen.append(held[0].count())
        return held

    monkeypatch.setattr(module, "staged", watched)
    if fit == "quality":
        marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
        quality_nb.train(docs, marks, F.lit(True))
    else:
        language_id.train(docs, F.lit(True))
    assert seen == [2]
