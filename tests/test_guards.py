"""What is refused, named or done without: bad vectors, patterns, indexes, sizes, orders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import plotweave
from plotweave import scratch, workload
from plotweave.operators import lexical, merge
from plotweave.operators import vector_search as V
from plotweave.operators.embed import hashed_words, with_query_instruction
from plotweave.plans import search as SP
from plotweave.sources import catalogue as C
from plotweave.sources.specs import SourceSpec, film_sources, read_csv

EMBEDDER = hashed_words(16)


def vectors(spark, rows, ident="id"):
    return spark.createDataFrame(rows, f"{ident} bigint, vector array<float>")


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, None], []])
def test_bad_vectors_are_named(spark, bad):
    good, faulty = [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (77, bad)]
    for queries, corpus in ((faulty, good), (good, faulty)):
        with pytest.raises(Exception, match="77"):
            V.exact_knn(vectors(spark, queries, "query_id"), vectors(spark, corpus), 1, 2).collect()
    with pytest.raises(Exception, match="77"):
        V.build_cells(vectors(spark, faulty), 2, cells=1, min_rows=1).members.collect()


def some_vectors(spark, n=240, dim=4):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(n, dim))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return vectors(spark, [(i, [float(x) for x in r]) for i, r in enumerate(rows)])


def test_large_batches_go_in_chunks(spark, monkeypatch):
    corpus = some_vectors(spark)
    asked = corpus.select(F.col("id").alias("query_id"), "vector")
    want = sorted(map(tuple, V.exact_knn(asked, corpus, 7, 4).collect()))
    monkeypatch.setattr(V, "QUERY_CHUNK_ROWS", 50)
    chunked = V.exact_knn(asked, corpus, 7, 4, max_broadcast_bytes=0)
    assert sorted(map(tuple, chunked.collect())) == want
    assert V.exact_knn(asked.limit(0), corpus, 7, 4, max_broadcast_bytes=0).count() == 0


def test_small_cells_are_topped_up(spark):
    corpus = some_vectors(spark)
    asked = corpus.select(F.col("id").alias("query_id"), "vector")
    index = V.build_cells(corpus, 4, cells=40, min_rows=1)
    for k in (50, 239, 1000):
        found = V.ann_search(asked, index, k, probes=1).groupBy("query_id").count().collect()
        assert len(found) == 240 and {r["count"] for r in found} == {min(k, 240)}


def test_many_centres_are_compared_in_parts(spark, monkeypatch):
    corpus = some_vectors(spark)
    centres = np.array([r["vector"] for r in corpus.limit(30).collect()], np.float32)
    centres[20] = centres[3]
    whole = sorted(map(tuple, V.assign_cells(corpus, centres).select("id", "cell_id").collect()))
    monkeypatch.setattr(V, "MAX_CENTRE_BYTES", 16 * 7)
    parts = sorted(map(tuple, V.assign_cells(corpus, centres).select("id", "cell_id").collect()))
    assert parts == whole and 20 not in {c for _, c in parts}


def test_codebooks_see_all_rows(spark):
    corpus = some_vectors(spark)
    books = V.train_codebooks(corpus, 4, 2, codes=8, iterations=3)
    again = V.train_codebooks(corpus.repartition(7), 4, 2, codes=8, iterations=3)
    assert books.shape == (2, 8, 2) and np.allclose(books, again, atol=1e-6)
    rows = np.array([r["vector"] for r in corpus.collect()])
    start = V.train_codebooks(corpus, 4, 2, codes=8, iterations=0)

    def error(b):
        return sum(((rows[:, 2 * s:2 * s + 2][:, None] - b[s]) ** 2).sum(axis=2).min(axis=1).sum()
                   for s in range(2))

    assert error(books) < error(start)


def test_faulty_patterns_are_named(spark):
    asked = spark.createDataFrame(
        [(1, "a film", "Drama|War"), (2, "a film", "("), (3, "a film", "")],
        "query_id bigint, query string, genre string")
    with pytest.raises(ValueError, match="query 2.*'\\('"):
        SP.pin(asked)
    held, rows = SP.pin(asked.where("query_id <> 2"))
    assert rows == held.count() == 2


FILMS = [(f"Film {i}", "2000", "Drama", f"the plot of film number {i} is a long and sad story {i}")
         for i in range(30)]


def films(spark):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(FILMS)],
        "o bigint, title string, year string, genre string, plot string")


SPEC = SourceSpec(name="films", path="", title="title", year="year", genre="genre", plot="plot",
                  order="o")


def test_an_index_that_fails_is_left_out(spark, tmp_path, monkeypatch):
    asked = spark.createDataFrame([(1, "sad story number 7")], "query_id bigint, query string")
    plain = str(tmp_path / "plain")
    plotweave.build_catalogue(spark, [SPEC], plain, EMBEDDER, tables={"films": films(spark)})
    want = plotweave.search(
        asked, plotweave.open_catalogue(spark, plain, EMBEDDER), fulltext=False).collect()

    def fails(*args, **kwargs):
        raise RuntimeError("no room")

    monkeypatch.setattr(C, "write_cells", fails)
    monkeypatch.setattr(C, "write_fulltext", fails)
    path = str(tmp_path / "c")
    report = plotweave.build_catalogue(
        spark, [SPEC], path, EMBEDDER, tables={"films": films(spark)}, index_min_rows=1)
    assert (report.ann, report.fulltext) == (False, False)
    assert report.ann_error == report.fulltext_error == "RuntimeError: no room"
    catalogue = plotweave.open_catalogue(spark, path, EMBEDDER)
    assert catalogue.meta["ann_error"] == "RuntimeError: no room"
    assert plotweave.search(asked, catalogue).collect() == want


@pytest.mark.parametrize("name", ["write_cells", "write_fulltext"])
def test_a_failed_index_is_no_smaller_result(spark, tmp_path, monkeypatch, name):
    """Words that only the text arm finds are found without the index; a query that is named after
    its index fails with it."""
    rows = [(i, f"Film {i}", "2000", "Drama", f"{'common words again ' * 9} number{i}")
            for i in range(80)]
    table = spark.createDataFrame(rows, films(spark).schema)
    asked = spark.createDataFrame([(1, "number7 number70 number79")], "query_id bigint, query string")
    found = []
    for path in ("whole", "lacks"):
        if path == "lacks":
            monkeypatch.setattr(C, name, lambda *_: 1 / 0)
            with pytest.warns(RuntimeWarning, match="ZeroDivisionError"):
                plotweave.build_catalogue(spark, [SPEC], str(tmp_path / path), EMBEDDER,
                                          tables={"films": table}, index_min_rows=20, cells=2)
        else:
            plotweave.build_catalogue(spark, [SPEC], str(tmp_path / path), EMBEDDER,
                                      tables={"films": table}, index_min_rows=20, cells=2)
        catalogue = plotweave.open_catalogue(spark, str(tmp_path / path), EMBEDDER)
        found.append([
            [r["Title"] for r in plotweave.search(asked, catalogue, 3, limit=3, probes=2).orderBy(
                "result_rank").collect()], catalogue.meta["ann"], catalogue.meta["fulltext"]])
    assert found[0][0] == found[1][0] and set(found[0][0]) == {"Film 7", "Film 70", "Film 79"}
    assert found[0][1:] == [True, True] and not all(found[1][1:])
    with pytest.raises(ZeroDivisionError):
        plotweave.build_catalogue(spark, [SPEC], str(tmp_path / "needs"), EMBEDDER, tables={
            "films": table}, index_min_rows=20, cells=2, require_indexes=True)
    monkeypatch.setattr(workload, "films", lambda *_: table.selectExpr(
        "title", "year release_year", "genre", "plot", "'' cast", "'' director", "'' keywords",
        "o src_ord"))
    with pytest.raises(ZeroDivisionError):
        workload.catalogue_path(spark, str(tmp_path / "registered"))


def test_a_build_deletes_its_intermediate_tables(spark, tmp_path):
    def kept():
        return [f for f in os.listdir(scratch.scratch_folder(spark).removeprefix("file://"))
                if f.startswith(("source", "entities"))]

    scratch.stage(spark.range(1), "other")
    before = len(kept())
    plotweave.build_catalogue(
        spark, [SPEC], str(tmp_path / "c"), EMBEDDER, tables={"films": films(spark)})
    assert len(kept()) == before


def test_the_size_from_which_an_index_is_built(spark, tmp_path):
    path = str(tmp_path / "c")
    report = plotweave.build_catalogue(
        spark, [SPEC], path, EMBEDDER, tables={"films": films(spark)}, index_min_rows=20, cells=4)
    assert report.ann and report.ann_error is None
    catalogue = plotweave.open_catalogue(spark, path, EMBEDDER)
    asked = spark.createDataFrame([(1, "sad story number 7")], "query_id bigint, query string")
    assert plotweave.search(asked, catalogue, probes=4).collect() == plotweave.search(
        asked, catalogue, use_ann=False).collect()


def test_limits_by_source():
    def limits(**options):
        return {s.name: s.limit_newest for s in film_sources("x", **options)}

    assert limits() == {"wiki": 15_000, "imdb": None, "movieverse": 20_000}
    assert limits(limit_newest={"wiki": None, "imdb": 5}) == {
        "wiki": None, "imdb": 5, "movieverse": 20_000}
    assert limits(limit_newest=3) == dict.fromkeys(("wiki", "imdb", "movieverse"), 3)
    assert limits(profile="test", limit_newest={"wiki": None}) == {"wiki": None}
    with pytest.raises(ValueError):
        limits(profile="test", limit_newest={"imdb": 3})


def test_several_unsplit_files_need_an_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("title,o\nx,1\n")
    spec = SourceSpec(name="s", path=str(tmp_path), title="title", split=False)
    with pytest.raises(ValueError, match="order"):
        read_csv(spark, spec)
    for options in ({"order": "o", "split": False}, {}):
        assert read_csv(spark, SourceSpec(
            name="s", path=str(tmp_path), title="title", **options)).count() == 2


def test_options_of_the_film_sources():
    specs = film_sources("x", multi_line=False, order="n")
    assert {(s.multi_line, s.order) for s in specs} == {(False, "n")}
    assert film_sources("x", "test", split=False)[0].split is False


@pytest.mark.parametrize("rank,order", [(0, 1 << 56), (0, -1), (128, 0), (-1, 0), (0, None)])
def test_row_ids_do_not_collide(spark, rank, order):
    rows = spark.createDataFrame([(rank, order)], "src_rank int, src_ord bigint")
    with pytest.raises(Exception, match="row order"):
        rows.select(merge.row_id()).collect()


def group_of(spark, n):
    plots = [(f"plot {i} " + " ".join(f"w{i}x{j}" for j in range(12)), i) for i in range(n)]
    return spark.createDataFrame(plots, "plot string, src_ord bigint").select(
        F.lit("t").alias("title_key"), F.lit("2000").alias("release_year"), "plot", "src_ord",
        F.lit(0).alias("src_rank"), F.lit(0).alias("recency"))


def test_large_groups_leave_no_rounds_behind(spark):
    embedder = hashed_words(512)
    merged = merge.merge_plots(group_of(spark, 300), embedder, max_group=10, head_rows=40,
                               rows_per_task=50).collect()
    assert merged[0]["plot"].count("\n\n") == 299
    left = os.listdir(scratch.scratch_folder(spark).removeprefix("file://"))
    assert not [f for f in left if f.startswith(("open-plots", "verdicts", "standing", "kept-plots"))]


def test_postings_are_counted_in_their_row(spark):
    docs = spark.createDataFrame(
        [(1, "b a b"), (2, ""), (3, None), (4, "Ä ä 1")], "id bigint, combined_text string")
    got = lexical.postings(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [
        ("1", 4, 3, 1), ("a", 1, 3, 1), ("b", 1, 3, 2), ("ä", 4, 3, 2)]


def test_query_instruction():
    assert with_query_instruction(EMBEDDER).query_prefix.startswith("Represent this sentence")
    assert EMBEDDER.query_prefix == ""
