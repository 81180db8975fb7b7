"""Neighbour search against brute force: exact, blocked, by cells, on codes."""

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame

from plotweave.operators import vector_search as V
from plotweave.operators.embed import Embedder, embed, hashed_words
from plotweave.operators.rank import top_k

DIM = 8


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, DIM))
    v = centres[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, DIM))
    v[200:400] = v[200]  # a third of all rows are copies
    v[5] = 0
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(n > 0, n, 1)).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(5)


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")


def brute(vectors, ids, k):
    wide = vectors.astype(np.float64)
    out = {}
    for q in ids:
        s = np.round(wide @ wide[q], 6)
        out[q] = [int(i) for i in np.lexsort((np.arange(len(s)), -s))[:k]]
    return out


def collected(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


IDS = range(0, 600, 10)


@pytest.mark.parametrize("k", [1, 7, 250, 900])
def test_exact_equals_brute_force(queries, corpus, vectors, k):
    assert collected(V.exact_knn(queries, corpus, k, DIM)) == brute(vectors, IDS, k)


def test_exact_with_salted_merge(queries, corpus, vectors):
    assert collected(V.exact_knn(queries, corpus, 9, DIM, salts=3)) == brute(vectors, IDS, 9)


def test_blocks_equal_brute_force(monkeypatch, queries, corpus, vectors):
    monkeypatch.setattr(V, "QUERY_BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "CORPUS_BLOCK_ROWS", 100)
    got = V.exact_knn(queries, corpus, 9, DIM, max_broadcast_bytes=0)
    assert collected(got) == brute(vectors, IDS, 9)


def test_small_buffers_change_nothing(monkeypatch, spark, queries, corpus, vectors):
    monkeypatch.setattr(V, "_SCORE_CELLS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert collected(V.exact_knn(queries, corpus, 9, DIM)) == brute(vectors, IDS, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_batch_equals_single_queries(queries, corpus):
    together = collected(V.exact_knn(queries, corpus, 4, DIM))
    for q in (0, 210):
        one = V.exact_knn(queries.filter(F.col("query_id") == q), corpus, 4, DIM)
        assert collected(one) == {q: together[q]}


def test_empty_batch_has_the_schema(queries, corpus):
    got = V.exact_knn(queries.filter("query_id < 0"), corpus, 4, DIM)
    assert got.columns == ["query_id", "id", "score", "rank"]
    assert got.count() == 0


def test_no_index_below_the_minimum(corpus):
    assert V.build_cells(corpus.filter("id < 255"), DIM) is None
    assert V.cell_count(600) == 24


@pytest.fixture(scope="module")
def index(corpus):
    index = V.build_cells(corpus, DIM, sub_vectors=4)
    members = index.members.cache()
    return V.CellIndex(index.centres, members, DIM, index.codebooks)


def recall(got, want):
    return np.mean([len(set(got.get(q, [])) & set(w)) / len(w) for q, w in want.items()])


def test_recall_grows_and_full_probe_is_exact(queries, index, vectors):
    want = brute(vectors, IDS, 6)
    levels = [
        recall(collected(V.ann_search(queries, index, 6, probes=p)), want) for p in (1, 6, 24)]
    assert levels[0] <= levels[1] <= levels[2] == 1.0
    assert collected(V.ann_search(queries, index, 6, probes=24)) == want


def test_cell_blocks_equal_cell_scan(monkeypatch, queries, index):
    for codes in (False, True):
        scan = collected(V.ann_search(queries, index, 6, probes=5, use_codes=codes))
        with monkeypatch.context() as patch:
            patch.setattr(V, "collect_queries", lambda *_: None)
            patch.setattr(V, "CORPUS_BLOCK_ROWS", 50)
            patch.setattr(V, "QUERY_BLOCK_ROWS", 16)
            blocks = collected(V.ann_search(queries, index, 6, probes=5, use_codes=codes))
        assert scan == blocks


def test_codes_approximate_and_refine(queries, index, vectors):
    want = brute(vectors, IDS, 6)
    got = V.ann_search(queries, index, 6, probes=24, use_codes=True, refine=20)
    assert recall(collected(got), want) > 0.8
    assert index.codebooks.shape == (4, 256, 2)


def test_sub_vectors_must_divide(corpus):
    with pytest.raises(ValueError, match="do not divide"):
        V.train_codebooks(corpus, DIM, 3, 600)


def test_top_k_orders_ties(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 1, 5.0), (1, 3, 9.0), (2, 9, 1.0)],
                               "q int, id int, s double").repartition(4)
    for salts in (1, 3):
        got = top_k(df, ["q"], [F.desc("s"), F.asc("id")], 2, salts=salts)
        assert sorted((r["q"], r["rank"], r["id"]) for r in got.collect()) == [
            (1, 1, 3), (1, 2, 1), (2, 1, 9)]


def test_embedding(spark):
    df = spark.createDataFrame(
        [(1, "One two, TWO"), (2, None), (3, "--")], "i int, t string")
    got = {r["i"]: r["vector"] for r in embed(df, "t", hashed_words(16)).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6)
    assert sorted(x for x in got[1] if x)[-1] == pytest.approx(2 / 5**0.5, abs=1e-6)
    assert set(got[2]) == set(got[3]) == {0.0}


def test_embedding_plug_in_prefix_and_batches(spark):
    def load():
        def encode(texts):
            assert len(texts) <= 2
            return np.array([[len(t), 1.0 if t.startswith("Q: ") else 0.0] for t in texts])

        return encode

    model = Embedder("lengths", 2, load, query_prefix="Q: ", batch_size=2)
    df = spark.createDataFrame([(t,) for t in "abcde"], "t string").coalesce(1)
    passages = embed(df, "t", model).collect()
    queries = embed(df, "t", model, is_query=True).collect()
    assert all(r["vector"] == [1.0, 0.0] for r in passages)
    assert all(r["vector"][1] > 0 for r in queries)


def clustered(spark, clusters=40, each=60, dim=16, seed=5):
    """Unit vectors around random directions, with a zero vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = np.repeat(centres, each, axis=0) + 0.15 * rng.normal(size=(clusters * each, dim))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.vstack((rows, np.zeros(dim))).astype(np.float32)
    return spark.createDataFrame(
        [(i, [float(x) for x in r]) for i, r in enumerate(rows)],
        "id bigint, vector array<float>").repartition(6), rows


def neighbours_of(rows, queries, k):
    scores = np.round(rows[queries].astype(float) @ rows.astype(float).T, 6)
    return {int(q): sorted(((-s, i) for i, s in enumerate(row)))[:k]
            for q, row in zip(queries, scores)}


def found_by(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return {q: [(-s, i) for _, i, s in sorted(hits)] for q, hits in got.items()}


def test_cell_bounds_give_the_exact_neighbours_from_few_vectors(spark):
    corpus, rows = clustered(spark)
    index = V.build_cells(corpus, 16)
    queries = corpus.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    report = {}
    got = found_by(V.exact_knn_by_cells(queries, index, 5, report=report))
    assert got == neighbours_of(rows, np.arange(0, len(rows), 7), 5)
    assert report["full"] == len(got) * len(rows)
    # the zero vector's query has to read everything
    assert report["scored"] < 0.2 * report["full"]


@pytest.mark.parametrize("scale", [1.0, 0.01, 30.0])
def test_cell_bounds_hold_for_vectors_of_any_length(spark, monkeypatch, scale):
    corpus, rows = clustered(spark, 8, 20, 4)
    lengths = (1 + np.arange(len(rows)) % 5) * scale
    rows = (rows * lengths[:, None]).astype(np.float32)
    corpus = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)],
                                   "id bigint, vector array<float>")
    monkeypatch.setattr(V, "BOUNDS_AT_ONCE", 60)
    index = V.build_cells(corpus, 4, cells=9, min_rows=1)
    queries = corpus.where("id % 11 = 0").withColumnRenamed("id", "query_id")
    got = found_by(V.exact_knn_by_cells(queries, index, 4))
    assert got == neighbours_of(rows, np.arange(0, len(rows), 11), 4)


def test_more_neighbours_than_rows_and_no_queries(spark):
    corpus, rows = clustered(spark, 2, 3, 4)
    index = V.build_cells(corpus, 4, cells=3, min_rows=1)
    queries = corpus.where("id = 1").withColumnRenamed("id", "query_id")
    assert len(found_by(V.exact_knn_by_cells(queries, index, 50))[1]) == len(rows)
    assert V.exact_knn_by_cells(queries.where("false"), index, 5).count() == 0


def share_found(got, want):
    return np.mean([len({i for _, i in got[q]} & {i for _, i in hits}) / len(hits)
                    for q, hits in want.items()])


def test_two_levels_of_fitted_centres_reach_a_recall(spark):
    corpus, rows = clustered(spark)
    index = V.build_cells(corpus, 16)
    cells = index.centres.count()
    assert 36 <= cells <= V.cell_count(len(rows)) == 49
    queries = np.arange(0, len(rows) - 1, 7)
    asked = corpus.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    want = neighbours_of(rows, queries, 5)
    few = found_by(V.ann_search(asked, index, 5, probes=4))
    all_cells = found_by(V.ann_search(asked, index, 5, probes=cells))
    assert share_found(few, want) >= 0.9
    assert share_found(all_cells, want) == 1


def test_a_row_meets_two_roots_of_the_centres(spark):
    corpus, _ = clustered(spark)
    levels = V.train_two_levels(corpus, 49)
    assert len(levels.coarse) <= 7
    assert np.diff(levels.starts).max() <= 7 and np.diff(levels.starts).min() >= 1
    assert levels.starts[-1] == len(levels.fine) <= 49
    assert np.allclose(np.linalg.norm(levels.fine, axis=1), 1, atol=1e-5)
    own = V.assign_cells(corpus, levels).select("cell_id", "vector").toPandas()
    moved = V._unit(np.stack(own.vector))
    close = (moved * levels.fine[own.cell_id]).sum(axis=1)
    assert np.median(close) > 0.8


def test_fitted_books_reach_a_recall(spark):
    corpus, rows = clustered(spark)
    index = V.build_cells(corpus, 16, sub_vectors=8)
    asked = corpus.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    want = neighbours_of(rows, np.arange(0, len(rows) - 1, 7), 5)
    got = found_by(V.ann_search(asked, index, 5, probes=8, refine=12, use_codes=True))
    assert share_found(got, want) >= 0.9


def test_stored_sizes_spare_the_count(spark):
    corpus, rows = clustered(spark, 6, 10, 4)
    index = V.build_cells(corpus, 4, cells=6, min_rows=1)
    shaped = V.with_shapes(index)
    assert sum(r["size"] for r in shaped.centres.collect()) == len(rows)
    for probes, k in ((1, 3), (2, 30), (1, 500)):
        assert V.enough_probes(shaped, probes, k) == V.enough_probes(index, probes, k)


def sent_rows(monkeypatch):
    """Rows of each table that reaches the driver and of each batch that is broadcast."""
    fetched, shared = [], []
    fetch, share = ClassicDataFrame.toArrow, SparkContext.broadcast

    def to_arrow(df):
        fetched.append(fetch(df))
        return fetched[-1]

    def broadcast(context, value):
        if isinstance(value, tuple):
            shared.append(len(value[0]))
        return share(context, value)

    monkeypatch.setattr(ClassicDataFrame, "toArrow", to_arrow)
    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    return fetched, shared


def test_probing_every_cell_lists_no_pairs_of_query_and_cell(monkeypatch, queries, index, vectors):
    fetched, _ = sent_rows(monkeypatch)
    got = collected(V.ann_search(queries, index, 6, probes=24))
    assert got == brute(vectors, IDS, 6)
    assert max(t.num_rows for t in fetched) <= max(queries.count(), index.centres.count())


def test_a_short_list_of_every_row_is_not_made(queries, index, vectors):
    got = V.ann_search(queries, index, 6, probes=24, use_codes=True, refine=-(-len(vectors) // 6))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert collected(got) == brute(vectors, IDS, 6)


@pytest.mark.parametrize("codes", [False, True])
def test_batches_are_bounded_by_rows(monkeypatch, queries, index, codes):
    def answers():
        return [collected(found) for found in (
            V.exact_knn(queries, index.members, 6, DIM),
            V.exact_knn_by_cells(queries, index, 6),
            V.ann_search(queries, index, 6, probes=5, use_codes=codes))]

    want = answers()
    monkeypatch.setattr(V, "QUERY_CHUNK_ROWS", 40)
    _, shared = sent_rows(monkeypatch)
    assert answers() == want
    assert 0 < max(shared) < queries.count()


def test_large_batches_keep_their_hits_in_their_tasks(monkeypatch, queries, corpus, vectors):
    """Chunks of the corpus are broadcast; no hits are shuffled, whatever the number of tasks."""
    monkeypatch.setattr(V, "QUERY_CHUNK_ROWS", 15)
    monkeypatch.setattr(V, "MAX_BROADCAST_BYTES", 4 * DIM * 200)
    twice = queries.unionByName(queries.filter("query_id < 100"))
    more = V.exact_knn(twice, corpus, 12, DIM).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in more if r["query_id"] == 20] == [
        i for i in brute(vectors, [20], 6)[20] for _ in range(2)]
    monkeypatch.setattr(V, "top_k", None)
    for k in (1, 9, 250, 900):
        assert collected(V.exact_knn(queries, corpus, k, DIM)) == brute(vectors, IDS, k)


@pytest.mark.parametrize("codes", [True, False])
def test_codes_of_all_cells_are_scored_again_in_their_chunk(monkeypatch, queries, index, codes):
    """No short list is joined with the vectors; its rows and their scores stay the same."""
    def found():
        return sorted(map(tuple, V.ann_search(
            queries, index, 5, probes=24, refine=4, use_codes=codes).collect()))

    want = found()
    monkeypatch.setattr(V, "QUERY_CHUNK_ROWS", 15)
    monkeypatch.setattr(V, "MAX_BROADCAST_BYTES", 4 * DIM * 200)
    monkeypatch.setattr(V, "_rescore", None)
    monkeypatch.setattr(V, "_ann_batch", None)
    assert found() == want


@pytest.mark.parametrize("digits", [0, 2, 6])
@pytest.mark.parametrize("cells", [0, 1 << 20])
def test_hits_are_ranked_by_score_then_id(monkeypatch, digits, cells):
    monkeypatch.setattr(V, "_SCORE_CELLS", cells)
    rng = np.random.default_rng(digits)
    query, ident = rng.integers(0, 9, 400), rng.permutation(400)
    score = np.round(rng.normal(size=400), digits)
    for k in (1, 7, 60):
        order, place = V._ranked(query, ident, score, 10, k)
        want = []
        for q in range(10):
            rows = sorted((-score[i], ident[i]) for i in np.flatnonzero(query == q))[:k]
            want += [(q, int(i), n) for n, (_, i) in enumerate(rows)]
        assert list(zip(query[order].tolist(), ident[order].tolist(), place.tolist())) == want


@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e17, 1e30])
def test_scores_of_any_size_are_those_of_double_precision(scale):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(300, 12)) * scale).astype(np.float32)
    rows[7], rows[8] = np.nan, rows[9]
    best = V.BestHits(5, 4)
    V._offer_blocks(best, rows, np.arange(300), rows[10:15], np.arange(5))
    hits = V.hits_of(np.arange(5), best).to_pydict()
    scores = np.round(rows[10:15].astype(float) @ rows.astype(float).T, 6)
    for query in range(5):
        order = sorted((-s, i) for i, s in enumerate(scores[query]) if s == s)[:4]
        found = [i for q, i in zip(hits["query_id"], hits["id"]) if q == query]
        assert found == [i for _, i in order]


def test_codebooks_are_plain_lloyd_without_a_row_per_piece(spark, corpus, vectors, monkeypatch):
    def refuse(*_):
        raise AssertionError("a row per sub-vector is made")

    first = corpus.orderBy(F.xxhash64("id"), "id").limit(16).toArrow()
    monkeypatch.setattr(V.F, "posexplode", refuse)
    books = V.train_codebooks(corpus, DIM, 4, codes=16, iterations=3)
    rows = vectors.astype(np.float64).reshape(-1, 4, 2)
    plain = V._matrix(first["vector"]).astype(np.float64).reshape(-1, 4, 2).transpose(1, 0, 2).copy()
    for _ in range(3):
        for s in range(4):
            code = ((rows[:, s, None] - plain[s][None]) ** 2).sum(axis=2).argmin(axis=1)
            for c in np.unique(code):
                plain[s][c] = rows[code == c, s].mean(axis=0)
    np.testing.assert_allclose(books, plain, atol=1e-5)


def test_items_are_looked_through_only_in_vectors_with_the_rare_number(spark):
    rows = [(1, [1.0, 2.0]), (2, [V._RARE, 2.0])]
    schema = "id bigint, vector array<double>"
    whole = V.checked(spark.createDataFrame(rows, schema), 2)
    assert "array_contains" in whole._jdf.queryExecution().toString()
    assert sorted(r["id"] for r in whole.collect()) == [1, 2]
    for wrong in ([V._RARE, None], [None, V._RARE], [None, 1.0], [1.0], None):
        with pytest.raises(Exception, match="vector of id 7 does not have 2 components"):
            V.checked(spark.createDataFrame([(7, wrong)], schema), 2).collect()
