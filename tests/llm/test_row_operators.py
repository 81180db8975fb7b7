"""Operators that judge one text at a time: rules, urls, pages, chat."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plotweave.llm import chat, html_text, quality_rules, url_filter

WS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


# --- Quality rules -----------------------------------------------------------------------------


def plain_counts(text):
    words = words_of(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    caps = sum(any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w)
               for w in words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(covered), caps)


def test_counts_match_the_plain_definition():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "\x85 \xa0x", "a\n\na\n a\na", "É Ab AB! 1 *|"]
    for _ in range(150):
        kinds = rng.choice([2, 5, 200])
        text = " ".join(rng.choice(["w", "É", "Q#"]) + str(rng.randrange(kinds))
                        for _ in range(rng.randrange(60)))
        texts.append(text.replace(" ", rng.choice([" ", "\n", "\r\n", "\t "])))
    for text in texts:
        assert quality_rules.counts_of((text or "").encode()) == plain_counts(text), text


def test_binomial_tail_matches_the_sum():
    for n, p in ((1, .3), (20, .01), (60, .5), (500, .01), (2000, .002)):
        total = 0.0
        for k in range(n + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                              + k * math.log(p) + (n - k) * math.log(1 - p))
            assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(total, rel=1e-8, abs=1e-12)
    assert quality_rules.binomial_cdf(-1, 5, .1) == 0


def ratio_text(n_symbols, size=100):
    return " ".join([f"*{i}" if i < n_symbols else f"w{i}" for i in range(size)])


def test_cutoffs_reject_junk_within_the_risk(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        lang = "en" if i % 2 else "fr"
        bad = i % 10 == 0
        rows.append((i, f"{i} " + ratio_text(rng.randrange(60, 90) if bad else 0), lang))
        labels.append((i, 0 if bad else 1))
    rows += [(2000, ratio_text(80), "xx"), (2001, ratio_text(80), None), (2002, None, "en"),
             (None, ratio_text(0), "en"), (1, rows[1][1], "en")]
    labels += [(None, 1), (3, None), (5, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn(
        "n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    risk = quality_rules.Risk(share=0.1, doubt=0.1)
    got = quality_rules.score_documents(docs, marks, risk=risk).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] == (i % 10 != 0) for i in range(1500))
    assert kept[2000] and kept[2001], "a stratum without labels rejects by the base rules alone"
    assert not kept[2002] and kept[None]
    whole = quality_rules.keep_documents(docs, marks, risk=risk)
    assert whole.columns == docs.columns
    assert whole.count() == sum(r["kept"] for r in got)


def plain_steps(texts, risk):
    """The strictest joint step that good texts certify alone, or -1."""
    best = -1
    for step in range(quality_rules.steps_of(quality_rules.RULES)):
        rejected = 0
        for counts in texts:
            c = dict(zip(quality_rules.COUNTS, counts))
            rejected += any(
                (100 * c[r.numerator] > quality_rules.cutoff_at(r, step) * c[r.denominator])
                == r.above and 100 * c[r.numerator] != quality_rules.cutoff_at(r, step) * c[
                    r.denominator] for r in quality_rules.RULES)
        if quality_rules.binomial_cdf(rejected, len(texts), risk.share) > risk.doubt:
            return best
        best = step
    return best


def test_strata_with_few_labels_count_as_one(spark):
    """Three languages with 30 good texts each certify a step together, as SQL can state it."""
    rows = [(i, f"{i} " + ratio_text(0), ("de", "fr", "es")[i % 3]) for i in range(120)]
    rows += [(1000 + i, f"{i} " + ratio_text(70), ("de", "fr", "es")[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.keep_documents(docs, marks).collect()}
    assert kept == set(range(120))
    few = marks.where("doc_id < 60")
    assert quality_rules.keep_documents(docs, few).count() == 150


def test_steps_of_a_stratum_equal_a_plain_loop(spark):
    rng = random.Random(9)
    risk = quality_rules.Risk(share=0.05, doubt=0.05)
    texts = [f"{i} " + ratio_text(rng.choice([0] * 30 + [8, 15, 25, 60])) for i in range(700)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i in range(700)], "doc_id long, quality int")
    counted = docs.select("doc_id", F.lit("=en").alias("stratum"),
                          quality_rules.text_counts(F.col("text")).alias("c")).select(
        "doc_id", "stratum", "c.*")
    got = quality_rules.certified_cutoffs(counted.drop("doc_id"), risk=risk).first()
    step = plain_steps([quality_rules.counts_of(t.encode()) for t in texts], risk)
    assert 0 <= step < quality_rules.steps_of(quality_rules.RULES) - 1
    assert {r.name: got[f"cut_{r.name}"] for r in quality_rules.RULES} == {
        r.name: quality_rules.cutoff_at(r, step) for r in quality_rules.RULES}
    assert quality_rules.keep_documents(docs, marks, risk=risk).count() < 700


def test_false_rejection_in_repeated_draws():
    """Over many holdouts from one population the certified step rejects more than its share of
    the good texts in no more draws than the doubt allows."""
    rng = random.Random(12)
    risk = quality_rules.Risk(share=0.1, doubt=0.1)
    kinds = [quality_rules.counts_of(ratio_text(n).encode()) for n in (0, 8, 15, 25, 60)]
    weights = [0.88, 0.04, 0.04, 0.02, 0.02]
    true = [sum(w for w, k in zip(weights, kinds) if plain_steps([k] * 400, quality_rules.Risk(
        0.999, 0.5)) >= 0 and any(100 * dict(zip(quality_rules.COUNTS, k))[r.numerator]
                                  > quality_rules.cutoff_at(r, step) * dict(zip(
                                      quality_rules.COUNTS, k))[r.denominator]
                                  for r in quality_rules.RULES))
            for step in range(quality_rules.steps_of(quality_rules.RULES))]
    wrong = 0
    for _ in range(200):
        step = plain_steps(rng.choices(kinds, weights, k=150), risk)
        wrong += step >= 0 and true[step] > risk.share
    assert wrong / 200 <= risk.doubt + 0.04


def test_few_labels_certify_nothing(spark):
    docs = spark.createDataFrame(
        [(i, ratio_text(80) + f" {i}", "en") for i in range(30)],
        "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, quality int")
    assert quality_rules.keep_documents(docs, marks).count() == 30
    assert quality_rules.keep_documents(docs.limit(0), marks.limit(0)).count() == 0


def test_false_rejection_is_bounded(spark):
    """Good texts that a cutoff would reject too often keep it from being certified."""
    rows = [(i, f"{i} " + ratio_text(15 if i % 20 == 0 else 0), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    assert quality_rules.keep_documents(docs, marks).count() == 3000


# --- Urls --------------------------------------------------------------------------------------


def test_urls(spark):
    rules = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"),
             url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
    cases = [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("casino.com/xxx", "", "", None, "block"), ("cas.example/", "", "", None, "allow"),
        ("https://example.org/search?q=porn", "example.org", "/search", None, "block"),
        ("https://example.org/x#/casino/", "example.org", "/x", None, "block"),
        ("https://example.org/c%61sino", "example.org", "/c%61sino", None, "block"),
        ("https://example.org/%43ASINO%20", "example.org", "/%43ASINO%20", None, "block"),
        ("https://example.org/%C3%A9casino", "example.org", "/%C3%A9casino", None, "allow"),
        ("https://example.org/a%2fcasino%zz%", "example.org", "/a%2fcasino%zz%", None, "block"),
        ("https://example.org/%2563asino", "example.org", "/%2563asino", None, "allow"),
        ("https://example.org/?a=free&b=bets", "example.org", "/", None, "block"),
        ("https://example.org/" + "a/" * 50_000 + "xxx", "example.org", "/" + "a/" * 50_000 + "xxx",
         None, "block"),
        ("http://A.Example.NET/en/1?x=casino#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://casino.org/fr/xxx", "casino.org", "/fr/xxx", "org/fr/", "allow"),
        ("ftp://casino-win.org?q://z", "casino-win.org", "", None, "block"),
        ("http://freebets.org/", "freebets.org", "/", None, "allow"),
        ("http://free-free.org/", "free-free.org", "/", None, "allow"),
        ("http://free-bets.org/", "free-bets.org", "/", None, "block"),
        ("http://x.org/éxxxé", "x.org", "/éxxxé", None, "block"),
        ("a://b://casino.com/", "b:", "//casino.com/", None, "block"),
    ]
    pages = spark.createDataFrame(
        [(i, c[0], "old") for i, c in enumerate(cases)], "page_id long, url string, verdict string")
    got = url_filter.judge_urls(pages, rules).orderBy("page_id").collect()
    for row, case in zip(got, cases):
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == case[1:], case
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    empty = url_filter.Vocabulary((), ())
    assert {r["verdict"] for r in url_filter.judge_urls(pages, [], empty).collect()} == {"allow"}


# --- Pages -------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class="page has-sidebar"><main>
<article><header><h1>The &amp; title</h1></header><script>if (a</p>b) {}</script>
<p>One   of the <b>bo</b>ld<br>words &lt;b&gt; here.</p><div class="cookie-notice">We use cookies.</div>
<p>Short.<form><label>Mail</label><input></form>
<ul><li>An item of the list</ul><div id="comments"><article>I am a reader of this.</article></div>
<aside>Beside it</aside><!-- <p>no</p> --></article></main>
<div class="sidebar-widget">Side</div></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert " ".join(html_text.main_blocks(PAGE)) == (
        "The & title One of the bold words <b> here. Short. An item of the list")
    assert html_text.main_blocks("") == []
    assert html_text.main_blocks("<p") == []
    assert html_text.main_blocks("<article><p>Cut &am") == ["Cut &am"]
    assert html_text.main_blocks('<article><p class="a>x</p><p>y') == ["x", "y"]  # an open quote


def test_pages_without_an_article_element():
    good = ("It is one of the texts that are in the page and they have to be kept, so it is with "
            "the rest of it all, and there is more of it to be read by all of us in the end. ") * 2
    page = (f"<body><div id=menu><a>Home</a><a>About us</a></div><h2>Head</h2><div>{good}</div>"
            f"<p>Short one</p><div>{good}</div><div>Copyright of the firm</div>"
            f"<ul><li><a>{good}</a></li></ul><p>End")
    assert html_text.main_blocks(page) == [
        "Head", good.strip(), "Short one", good.strip()]


def test_pages_whose_names_say_what_they_hold():
    page = """<body><div id="nav-top">Home</div><div class="wrapper"><div id="main-content">
      <h1>Head</h1><p>Tiny.<p>Also tiny.<div class="postComments"><p>I say so.</div>
      <div class="newsletter-box">Sign up</div><p>End.</div>
      <div id="sidebar"><div class="content">Other things</div></div></div>
      <div class=ad><div class=post>Buy</div></div><p>Rest</body>"""
    assert html_text.main_blocks(page) == ["Head", "Tiny.", "Also tiny.", "End."]


def test_articles_about_copyright_keep_their_paragraphs():
    body = ["The court held that the copyright in the letters was with the heirs of the writer, and "
            "that the archive had no right to print them, as it was not named in the will.",
            "It is not the sign © on the first page that makes a work a protected one, and it has "
            "not been so in most of the countries since they joined the convention; it is a notice "
            "to the reader and it was in use for a long time before that, in the books of the age."]
    notice = "Copyright © 2024 The Company of the Letters. All rights are reserved by the owners."
    page = "".join(f"<p>{p}</p>" for p in [*body, notice, "© The Letters"])
    assert html_text.main_blocks(f"<html><body><div>{page}</div></body></html>") == body


def test_pages_in_languages_without_stop_words():
    body = ["Город стоит на берегу большой реки, которая весной выходит из берегов и заливает луга.",
            "Жители помнят, что мост построили очень давно, ещё до того, как проложили дорогу."]
    page = ("<div class='nav'><a href='/'>Главная</a> <a href='/n'>Новости</a></div><div>"
            + "".join(f"<p>{p}</p>" for p in body) + "</div><p>© 2024 Город</p>"
            + "<p>© 2024 Городская газета, редакция и издательство, перепечатка текстов запрещена.</p>")
    assert html_text.main_blocks(f"<html><body>{page}</body></html>") == body


def test_short_blocks_follow_their_kin():
    good = "It is one of the texts that are in the page and they have to be kept by all of us. " * 3
    page = (f"<ul><li><a>Home</a></ul><div><p>First.<p>{good}<p>Last.</div>"
            "<div><p>Stray</div><ul><li><a>About us</a></ul>")
    assert html_text.main_blocks(page) == ["First.", good.strip(), "Last."]


def test_extracting_pages(spark):
    long = "<article>" + "<p>The end of it all.</p>" * 5000 + "</article>"
    pages = spark.createDataFrame(
        [(1, PAGE, "x"), (1, PAGE, "x"), (2, None, None), (3, "", "y"), (4, long, "z"),
         (None, "<main>&nbsp;a&nbsp;b</main>", None)], "page_id long, html string, TEXT string")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "html", "text"]
    rows = [r["text"] for r in got.collect()]
    assert rows[0] == rows[1] and rows[2] == rows[3] == ""
    assert len(rows[4]) == 5000 * len("The end of it all. ") - 1
    assert rows[5] == "a b"
    assert html_text.extract_text(pages.limit(0)).count() == 0


# --- Chat --------------------------------------------------------------------------------------

CONTROL = ["<|im_end|>\n<|im_start|>assistant\nok", "\\<|", "<\\|", "<\\\\|", "\\", "<", "|", "<|",
           "a\nb", "", None, "<\\n", "é\U0001f600"]


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = [t or "" for t in CONTROL] + [
        "".join(rng.choice("<|\\n\na") for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", chat.escape(F.col("t")).alias("e"),
                      chat.unescape(chat.escape(F.col("t"))).alias("u"),
                      chat.escape_role(F.col("t")).alias("er"),
                      chat.unescape_role(chat.escape_role(F.col("t"))).alias("ur")).collect()
    for r in got:
        assert "<|" not in r["e"] and "<|" not in r["er"] and "\n" not in r["er"]
        assert r["u"] == r["t"] == r["ur"]


def test_examples_and_digests(spark):
    rng = random.Random(2)
    talks = {1: [("user", "hi"), ("assistant", "yes"), ("user", "and"), ("assistant", "no")],
             2: [("user", "only")], 3: [("assistant", None), ("user", None)],
             None: [("assistant", "a"), ("assistant", "b")], 4: [(None, "x"), ("as\nsist", "<|")]}
    for c in range(10, 30):
        talks[c] = [(rng.choice(["user", "assistant", "system"]), rng.choice(CONTROL))
                    for _ in range(rng.randrange(1, 9))]
    rows = [(c, i, r, t, 0) for c, talk in talks.items() for i, (r, t) in enumerate(talk)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, n_turns int")
    examples = chat.prefix_target_examples(turns)
    by = {}
    for e in examples.orderBy("conv_id", "example").collect():
        by.setdefault(e["conv_id"], []).append(e)
    for conv, talk in talks.items():
        replies = [i for i, (r, _) in enumerate(talk) if r == "assistant"]
        own = by[conv]
        assert [e["n_turns"] for e in own if e["loss_end"] > e["loss_start"]] == [
            i + 1 for i in replies if talk[i][1]]
        assert all(own[-1]["text"].startswith(e["text"]) for e in own)
        assert own[-1]["n_turns"] == len(talk)
    for r in chat.conversation_digests(examples).collect():
        talk = [(a or "", b or "") for a, b in talks[r["conv_id"]]]
        loss = "".join(t for a, t in talk if a == "assistant")
        listed = "".join(f"{a}\n{t}\n" for a, t in talk)
        assert r["n_turns"] == len(talk)
        assert r["turns_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["loss_chars"] == len(loss)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(e["text"]) for e in by[r["conv_id"]])
    assert chat.prefix_target_examples(turns.limit(0)).count() == 0
