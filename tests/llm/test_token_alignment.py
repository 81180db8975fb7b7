"""Tokens, alignment and corpus counts against the tokenizers' own calls and plain sets."""

import hashlib
import os
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plotweave.llm import token_alignment as A

BYTE_LEVEL = os.path.join(A.FOLDER, "byte_bpe_50k.json")
PIECES = os.path.join(A.FOLDER, "piece_bpe_32k.model")

ODD = ["", " ", "  ", "a ", " a", "a  b\n c \n\n d\t e ", "  x   y　", "x▁y",
       "日本 語  🙂 é", "<|endoftext|> <s> </s> <unk>", "\x00 \x01 a", "\x1c b \x85 c", "a" * 2000,
       " " * 5000 + "x", "\n" * 3000 + " z", "tab\t \tq", "it's we'LL 12 345", "﻿ x ​",
       "one\r\n two", "x " * 3, "é \U0010ffff"]


@pytest.fixture(scope="module")
def codec():
    with open(BYTE_LEVEL, "rb") as a, open(PIECES, "rb") as b:
        return A.Codec(a.read(), b.read())


@pytest.fixture(scope="module")
def plain():
    """Both libraries' own ids, or none where the bytes differ."""
    byte_level = Tokenizer.from_file(BYTE_LEVEL)
    byte_level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    of_char = A.byte_characters()

    def tokens(text):
        if not text:
            return [], [], [], []
        a = byte_level.encode(" " + text, add_special_tokens=False)
        b = pieces.encode(text)
        bytes_a = [bytes(of_char[c] for c in t) for t in a.tokens]
        bytes_b = []
        for i in b:
            piece = pieces.id_to_piece(i)
            bytes_b.append(bytes([int(piece[1:-1], 16)]) if pieces.is_byte(i)
                           else piece.replace("▁", " ").encode())
        own = (" " + text).encode()
        if b"".join(bytes_a) != own or b"".join(bytes_b) != own:
            return [], [], [], []
        return a.ids, b, list(map(len, bytes_a)), list(map(len, bytes_b))

    return tokens


def spans(lengths):
    ends = np.cumsum(lengths).tolist()
    return list(zip([0, *ends], ends))


def plain_facts(a, b, size_a, size_b):
    """Groups as text and links, over all pairs of ends and all pairs of tokens."""
    ends = sorted({e for _, e in spans(size_a)} & {e for _, e in spans(size_b)})
    groups = []
    for lo, hi in zip([0, *ends], ends):
        groups.append(",".join(str(i) for i, (x, y) in zip(a, spans(size_a)) if lo <= x and y <= hi)
                      + "|"
                      + ",".join(str(i) for i, (x, y) in zip(b, spans(size_b)) if lo <= x and y <= hi))
    links = [(i, j) for i, (p, q) in zip(a, spans(size_a)) for j, (x, y) in zip(b, spans(size_b))
             if max(p, x) < min(q, y)]
    return ";".join(groups), links


def some_texts(seed, count):
    rng = random.Random(seed)
    words = ["the", "thanedble", "Ünder", "naïve", "x1y2", "don't", "réeux", "ing", "\n", "-", "42",
             "日本", "🙂", "a.b", "https://e.org/q?x=1"]
    return [rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " ", ", ", ".\n"])
                                       for _ in range(rng.randrange(25))) for _ in range(count)]


def test_tokens_are_those_of_the_libraries(codec, plain):
    texts = ODD + some_texts(1, 150)
    found = codec.tokens(texts)
    for i, text in enumerate(texts):
        a, b, _, _ = plain(text)
        assert found.a[found.starts_a[i]:found.starts_a[i + 1]].tolist() == a, text
        assert found.b[found.starts_b[i]:found.starts_b[i + 1]].tolist() == b, text


def test_forgotten_segments_are_encoded_again(codec, monkeypatch):
    texts = some_texts(2, 30)
    before = codec.tokens(texts)
    monkeypatch.setattr(A, "_KNOWN_SEGMENTS", 0)
    after = codec.tokens(texts)
    assert before.a.tolist() == after.a.tolist() and before.b.tolist() == after.b.tolist()


ENDS = st.lists(st.integers(1, 6), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(ENDS, ENDS)
def test_alignment_of_any_ends(left, right):
    a, b = np.cumsum(left), np.cumsum(right)
    top = max(a[-1], b[-1])
    a, b = (np.append(x[x < top], top) for x in (a, b))
    found = A.align(a, b)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[found.last_a].tolist() == common == b[found.last_b].tolist()
    starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    expected = [(i, j) for i in range(len(a)) for j in range(len(b))
                if max(starts_a[i], starts_b[j]) < min(a[i], b[j])]
    assert sorted(zip(found.links_a.tolist(), found.links_b.tolist())) == expected


def test_long_stretches_are_jumped():
    ends = np.arange(1, 5001)
    same = A.align(ends, ends)
    assert same.last_a.tolist() == same.last_b.tolist() == list(range(5000))
    other = np.delete(ends, [7, 1000, 1001, 4998])
    found = A.align(ends, other)
    assert len(found.last_a) == len(other) and len(found.links_a) == 5000


def plain_counts(rows, plain):
    facts = []
    for doc, text in rows:
        tokens = plain(text)
        groups, links = plain_facts(*tokens)
        facts.append((doc, tokens, groups, links))
    count = {}
    for _, _, _, links in facts:
        for pair in set(links):
            count[pair] = count.get(pair, 0) + 1
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for doc, (a, b, _, _), groups, links in facts:
        out.append((doc, len(a), len(b), groups.count("|") if groups else 0, len(links),
                    sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [A.HEAD_PAIRS, 40, 0])
def test_counts_with_frequent_and_rare_pairs(spark, plain, head):
    texts = [t for t in ODD if len(t) < 3000] + some_texts(3, 40)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "the end"), (7, "the end"),
                                                    (7, "the end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "1 as a", "'x' as row", "2 as times", "3 as f").repartition(5)
    made = A.alignment_counts(docs, A.files(spark), head=head)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                            "groups_sha256"]
    assert sorted((tuple(r) for r in made.collect()), key=repr) == plain_counts(rows, plain)


def test_aligned_tokens_of_documents(spark, plain):
    texts = some_texts(4, 12) + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, said string")
    for row in A.align_documents(docs, A.files(spark), "said").collect():
        a, b, size_a, size_b = plain(row["said"])
        own = row["alignment"]
        assert (own["a"], own["b"]) == (a, b)
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        assert [ends_a[i - 1] for i in own["ends_a"]] == [ends_b[i - 1] for i in own["ends_b"]] == (
            sorted(set(ends_a.tolist()) & set(ends_b.tolist())))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert A.alignment_counts(none, A.files(spark)).count() == 0
