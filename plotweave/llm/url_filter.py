"""URL filter: host rules and a weighted vocabulary of URL terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import free_name

#: One hit rejects.
STRICT_TERMS = ("adult", "casino", "gambling", "hentai", "malware", "phishing", "poker", "porn",
                "spam", "torrent", "viagra", "warez", "xxx")
#: Several different ones reject.
SOFT_TERMS = ("ads", "bet", "bets", "bonus", "cheap", "clickbait", "coupon", "dating", "deals",
              "farm", "free", "jackpot", "loan", "loans", "pill", "pills", "promo", "replica",
              "sale", "sexy", "slots", "track", "tracker", "win", "winner")


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case ASCII terms; ``soft_needed`` different soft terms weigh as much as a strict one."""

    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    soft_needed: int = 2


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, below a path prefix."""

    verdict: str
    host: str
    path: str = "/"
    name: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "name", self.host + self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_that_fits(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equals a blocking one), else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
            for r in ordered]

    def chosen(values: list[str]) -> Column:
        return reduce(lambda rest, i: F.when(fits[i], F.lit(values[i])).otherwise(rest),
                      reversed(range(len(ordered))), F.lit(None).cast("string"))

    return chosen([r.name for r in ordered]), chosen([r.verdict for r in ordered])


_ESCAPE = re.compile("%([2-7][0-9A-Fa-f])")
_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_url(url: str) -> str:
    """A url with its escapes of ASCII characters resolved (once) and A-Z lower-cased."""
    if "%" in url:
        url = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url)
    return url.translate(_LOWER)


def _is_word(char: str) -> bool:
    return char.isascii() and char.isalnum()


def count_terms(vocabulary: Vocabulary):
    """A column function: strict hits and different soft terms in a whole url, its escapes
    resolved.

    One pass of an Aho-Corasick automaton finds every occurrence; one counts only where no ASCII
    letter or digit touches it. Null counts as empty.
    """
    weights = {t: 0 for t in vocabulary.soft} | {t: 1 for t in vocabulary.strict}

    @F.arrow_udf("struct<strict_hits:int,soft_terms:int>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            automaton.add_word(term, (term, weight))
        if weights:
            automaton.make_automaton()
        for batch in batches:
            strict, soft = [], []
            for url in batch.to_pylist():
                text, hits, seen = plain_url(url or ""), 0, set()
                for end, (term, weight) in automaton.iter(text) if text and weights else ():
                    start = end - len(term) + 1
                    if (start and _is_word(text[start - 1])) or (
                            end + 1 < len(text) and _is_word(text[end + 1])):
                        continue
                    if weight:
                        hits += 1
                    else:
                        seen.add(term)
                strict.append(hits)
                soft.append(len(seen))
            yield pa.StructArray.from_arrays(
                [pa.array(strict, pa.int32()), pa.array(soft, pa.int32())],
                ["strict_hits", "soft_terms"])

    return counted


def judge_urls(pages: DataFrame, rules: list[Rule], vocabulary: Vocabulary = Vocabulary(),
               url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, strict_hits, soft_terms and verdict (block or allow).

    A rule that fits decides; else the terms in the whole url do, query and fragment included: one
    strict hit or ``soft_needed`` different soft terms block. Row by row in one pass over the url,
    no shuffle. Null and empty urls, and urls without ``://``, have an empty host and path and fit
    no rule; null and empty ones are allowed. Columns of these names that ``pages`` has already are replaced. Repeated rows
    stay repeated; an empty table gives an empty one.
    """
    made = ("host", "path", "rule", "strict_hits", "soft_terms", "verdict")
    link, terms = free_name(pages, "_url"), free_name(pages, "_terms")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made or c == url]
    host, path = host_and_path(F.col(f"`{url}`"))
    split = pages.select(*kept, F.struct(
        host.alias("host"), path.alias("path"), F.col(f"`{url}`").alias("url")).alias(link))
    host, path = F.col(f"{link}.host"), F.col(f"{link}.path")
    counted = split.withColumn(terms, count_terms(vocabulary)(F.col(f"{link}.url")))
    rule, verdict = rule_that_fits(rules, host, path)
    by_terms = F.when((F.col(f"{terms}.strict_hits") > 0) | (
        F.col(f"{terms}.soft_terms") >= vocabulary.soft_needed), "block").otherwise("allow")
    return counted.select(
        *[c for c in kept], host.alias("host"), path.alias("path"), rule.alias("rule"),
        F.col(f"{terms}.strict_hits"), F.col(f"{terms}.soft_terms"),
        F.coalesce(verdict, by_terms).alias("verdict"))
