"""Scalar expressions against expected values."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotweave.functions import scores as P
from plotweave.functions import text as X


def apply(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(out.collect(), key=lambda r: r["i"])]


def check(spark, fn, cases, kind="string"):
    assert apply(spark, fn, [c[0] for c in cases], kind) == [c[1] for c in cases]


def test_normalize_title(spark):
    check(spark, X.normalize_title, [
        ("The Matrix", "matrix"),
        ("matrix", "matrix"),
        ("Matrix, The", "matrix the"),
        ("“The Matrix”", "the matrix"),
        ("A.I.", "i"),
        ("Amélie", "amélie"),
        ("The", "the"),
        ("An  Actor's\tLife!", "actor s life"),
        ("snake_case", "snake_case"),
        ("300", "300"),
        ("  The  End \n", "end"),
        (None, "nan"),
        ("", ""),
    ])


def test_normalize_year(spark):
    check(spark, X.normalize_year, [
        ("1999", "1999"), ("1999.0", "1999"), ("(I) 2005", "2005"), ("12345", "Unknown"),
        ("1879", "Unknown"), ("1880", "1880"), ("2030", "2030"), ("2031", "Unknown"),
        ("9999", "Unknown"), ("", "Unknown"), (None, "Unknown"), ("'99", "Unknown"),
    ])


def test_recency_key_has_no_range_check(spark):
    check(spark, X.recency_key, [("9999", 9999), ("x1850y", 1850), ("12", 0), (None, 0)])


def test_year_bound(spark):
    check(spark, X.parse_year_bound, [
        (" 1990 ", 1990), ("19a0", None), ("", None), ("-5", None), ("²", None), (None, None),
        ("99999999999999", 99999999999999), ("9" * 30, (1 << 63) - 1),
    ])


def test_title_case(spark):
    check(spark, X.title_case, [
        (v, v.title()) for v in
        ["sci-fi", "DRAMA", "children's", "3d film", "élan vital", "o'BRIEN mc2x", "ßa", "", "a1b2"]
    ])


def test_strip_matches_python(spark):
    spaces = [" a ", "\t\na\x0b\x0c\r", " a ", "\x1ca\x1f", "　a b ", "", "  "]
    check(spark, X.strip, [(v, v.strip()) for v in spaces])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]),
                        max_size=12), min_size=20, max_size=20))
def test_strip_property(spark, values):
    values = [v.replace("\x00", "") for v in values]
    check(spark, X.strip, [(v, v.strip()) for v in values])


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="the anb_.'-é9 ", max_size=14), min_size=30, max_size=30))
def test_clean_titles_are_stable(spark, values):
    """A key without a leading article maps to itself."""
    keys = apply(spark, X.normalize_title, values)
    plain = [k for k in keys if not k.startswith(("the ", "a ", "an "))]
    if plain:
        check(spark, X.normalize_title, [(k, k) for k in plain])


def test_genre_parts(spark):
    check(spark, X.genre_parts, [
        ("sci-fi, DRAMA", ["Sci-Fi", "Drama"]),
        ("Action|Drama/action", ["Action", "Drama"]),
        ("['Drama', 'Comedy']", ["'Drama'", "'Comedy'"]),
        ("Back to top", []), ("unknown, none, nan", []), (None, []),
    ])


def test_term_parts(spark):
    check(spark, X.term_parts, [
        ("O'Brien, ['A', \"B\"]", ["OBrien", "A", "B"]),
        ("none, NaN, unknown, ,x", ["none", "x"]), (None, []),
    ])


def test_tokens(spark):
    check(spark, X.tokens, [("Héllo, World_2x!", ["héllo", "world", "2x"]), (None, []), ("--", [])])


def test_null_tokens(spark):
    check(spark, X.null_tokens, [
        ("NA", None), ("", None), ("nan", None), ("Unknown", "Unknown"), ("x", "x"), (None, None)])


def test_combined_text(spark):
    columns = ["title", "year", "genre", "cast", "director", "keywords", "plot"]
    rows = [
        ("T", "1999", "Drama", "A, B", "D", "k", "p" * 2000),
        ("T", "Unknown", "Unknown", "", "Unknown", "", "short"),
    ]
    text = X.combined_text(*[F.col(c) for c in columns])
    out = [r[0] for r in spark.createDataFrame(rows, columns).select(text).collect()]
    assert out[0] == ("Title: T. Release Year: 1999. Genre: Drama. Cast: A, B. Director: D. "
                      "Keywords: k. Plot: " + "p" * 1500)
    assert out[1] == "Title: T. Release Year: Unknown. Genre: Unknown. Plot: short"


def test_percent_round_trip(spark):
    check(spark, P.percent_text, [
        (0.9725, "97.2%"), (0.9735, "97.4%"), (0.0, "0.0%"), (1.0, "100.0%"), (-0.1, "-10.0%"),
    ], "double")
    got = apply(spark, P.percent_value, ["97.2%", "", None, "x", "-10.0%"])
    assert got == pytest.approx([0.972, 0.0, 0.0, 0.0, -0.1])


def test_similarity_from_distance(spark):
    got = apply(spark, P.similarity_from_distance, [0.25, -0.1, 1.4, 2.5], "double")
    assert got == pytest.approx([0.75, 1.0, -0.4, -1.0])


def test_sigmoid(spark):
    assert apply(spark, P.sigmoid, [0.0, 2.0], "double") == pytest.approx([0.5, 0.880797078])


def test_title_case_follows_the_rule_of_cased_letters(spark):
    texts = ["日本abc", "한국film", "ǆungla", "o'NEIL", "ΟΔΟΣ ΣΣ", "ßeta a1b2", "ﬁn", "ქართული X"]
    pool = [chr(c) for c in (*range(32, 0x130), 0x1C4, 0x1C5, 0x1C6, *range(0x391, 0x3A2),
                             *range(0x3A4, 0x3C2), *range(0x3C4, 0x3CA), *range(0x410, 0x450), 0x65E5, 0xD55C, 0x5D0)]
    rng = random.Random(3)
    texts += ["".join(rng.choice(pool) for _ in range(9)) for _ in range(2000)]
    assert apply(spark, X.title_case, texts) == [t.title() for t in texts]


def test_title_case_of_every_cased_letter(spark):
    """Alone, in front of a letter and behind one, for every letter of the first two planes that
    the patterns of the JVM know (theirs is an older Unicode)."""
    letters = [c for c in map(chr, range(0x20000))
               if c.isalpha() and c.lower() != c.upper() and not 0xD800 <= ord(c) < 0xE000]
    known = apply(spark, lambda x: x.rlike(r"^\p{L}$"), letters)
    letters = [c for c, k in zip(letters, known) if k]
    assert len(letters) > 2700
    texts = letters + [f"{c}a" for c in letters] + [f"b{c}" for c in letters]
    got = apply(spark, X.title_case, texts)
    wrong = [(t, g) for t, g in zip(texts, got) if g != t.title()]
    assert not wrong, wrong[:20]


def test_white_space_runs_inside_a_text_take_linear_time(spark):
    """Patterns tried at every character of a run would take minutes here."""
    run = " " * 200_000
    rows = spark.createDataFrame([(f" a{run}b ,{run}c{run}, d{run}x",)], "t string")
    started = time.monotonic()
    row = rows.select(
        X.strip(F.col("t")).alias("s"), X.first_words(X.strip(F.col("t")), 3).alias("w"),
        X.term_parts(F.col("t")).alias("p")).first()
    assert time.monotonic() - started < 10
    assert row["s"] == f"a{run}b ,{run}c{run}, d{run}x"
    assert row["w"] == "a b ,"
    assert row["p"] == [f"a{run}b", "c", f"d{run}x"]


def test_terms_and_first_words_around_every_kind_of_space(spark):
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    texts = [f"{c}a{c}{c}b{c},{c},{c}'c'{c},,[{c}d{c}]{c}e{c}" for c in spaces] + ["", ",", " , "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in rows.select("t", X.term_parts(F.col("t")).alias("p"),
                           X.first_words(X.strip(F.col("t")), 3).alias("w")).collect():
        cut = [re.sub(r"[\[\]'\"]", "", p).strip() for p in row["t"].split(",")]
        assert row["p"] == [p for p in cut if p]
        assert row["w"] == " ".join(row["t"].split()[:3])
