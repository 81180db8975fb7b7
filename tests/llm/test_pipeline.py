"""The pipeline against a plain version of each stage's decision, and the registered queries."""

import importlib.util
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import ROOT, TESTDATA
from plotweave.llm import language_id, mixing, packing, simhash
from plotweave.llm.common import remainder
from test_row_operators import plain_counts
from test_table_operators import plain_classes, plain_fingerprint

sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels with rows of every awkward kind added."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    long = " ".join(f"word{i} of the" for i in range(9000))
    mix = "12 34 56 78 " + " ".join(str(i) for i in range(40))
    odd = [(10_001, None, "en", "a", 0), (10_002, "", None, None, None), (10_003, long, "en", "a", 1),
           (10_004, mix, "en", "a", 1), (10_005, long, None, "b", 1), (None, long + " end", "en", "a", 1)]
    first = docs.limit(1).collect()[0]
    odd += [tuple(first), (10_006, first["text"], first["lang"], None, 3)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(
        f"{folder}/documents.parquet")
    spark.read.parquet(f"{TESTDATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def steps(spark, tables, tmp_path_factory):
    """Each stage's input and output, written and read as the contract says."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(f"{folder}/{name}")
        result = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs, result
        docs = result
    return out


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_stages(steps):
    assert list(steps) == ["quality_rules", "language_id", "simhash_near_dedup", "source_mixing",
                           "best_fit_packing"]
    columns = steps["quality_rules"][0].columns
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == columns
        assert 0 < steps[name][1].count() <= steps[name][0].count()


def test_quality_stage(steps):
    """So few labels certify no cutoff: what is left is what the base rules keep."""
    before, after = steps["quality_rules"]
    want = []
    for r in before.collect():
        n_words, _, _, _, _, repeated, _ = plain_counts(r["text"])
        if not (n_words < 20 or 100 * repeated > 30 * n_words):
            want.append((r["doc_id"] is None, r["doc_id"] or 0))
    assert ids(after) == sorted(want)


def test_language_stage(spark, steps):
    before, after = steps["language_id"]
    judged = language_id.identify(before, remainder(F.col("doc_id"), 4) != 2).collect()
    assert ids(after) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in judged
                                if r["lang_pred"] != "und" and r["score"] >= 0.5)
    assert 10_004 in {r["doc_id"] for r in before.collect()}
    assert 10_004 not in {r["doc_id"] for r in after.collect()}, "no letter in it"


def test_near_duplicate_stage(steps):
    before, after = steps["simhash_near_dedup"]
    rows = sorted(before.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    classes = plain_classes([plain_fingerprint(r["text"]) for r in rows], 2)
    want = {(rows[c]["doc_id"] is None, rows[c]["doc_id"] or 0) for c in classes}
    assert ids(after) == sorted(want)
    assert len({r["text"] for r in after.collect()}) == after.count()


def test_mixing_stage(steps):
    before, after = steps["source_mixing"]
    marked, cell = mixing.sampled(before)
    rows = marked.collect()
    assert ids(after) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows
                                if r[cell]["sampled"])
    total = sum(r[cell]["n_tokens"] for r in rows)
    assert sum(r[cell]["n_tokens"] * r[cell]["probability"] for r in rows) == pytest.approx(
        mixing.Plan().keep * total, rel=1e-6)


def test_packing_stage(steps):
    before, after = steps["best_fit_packing"]
    tokens = {}
    for r in after.collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["bin_length"] in packing.Lengths().sizes and r["bin_tokens"] <= r["bin_length"]
    assert tokens == {r["doc_id"]: plain_counts(r["text"])[0] for r in before.collect()}


def test_run_is_its_stages(spark, tables, steps):
    got = sorted(map(str, corpus_pipeline.run(spark, tables).collect()))
    assert got == sorted(map(str, steps["best_fit_packing"][1].collect()))


@pytest.fixture(scope="module")
def entry_module():
    spec = importlib.util.spec_from_file_location(
        "__spark_entry__", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_source_mixing", "op5_chat_formatting",
                                  "op8_exact_topk", "op10_url_filter"])
def test_queries_match_their_sql(spark, entry_module, name):
    con = duckdb.connect()
    for file in os.listdir(TESTDATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{TESTDATA}/{file}'")
    cursor = con.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = entry_module.queries()[name](spark, TESTDATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*[f"`{c}`" for c in columns]).collect()))) == sorted(
        map(repr, cursor.fetchall()))


def test_every_operator_is_registered(entry_module):
    names = entry_module.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


def test_fingerprints_of_the_table(spark, entry_module):
    rows = spark.read.parquet(f"{TESTDATA}/documents.parquet").orderBy("doc_id").collect()
    classes = plain_classes([plain_fingerprint(r["text"]) for r in rows], 2)
    want = {(r["doc_id"], f"{plain_fingerprint(r['text']):016x}", rows[c]["doc_id"])
            for r, c in zip(rows, classes)}
    got = entry_module.queries()["op4_simhash_near_dedup"](spark, TESTDATA).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert simhash.BITS == 64
