"""Text expressions. All of them run inside the JVM and take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave import settings as S

# Java's \s under (?U), plus the four separators that Python also counts as white space.
_SPACE = r"[\s\x1c-\x1f]"
# The same characters one by one, for what takes no pattern, and as patterns without a flag: most
# characters are told by a table of the first 256 and one comparison.
SPACES = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
    0x2029, 0x202F, 0x205F, 0x3000)))
_LOW, _HIGH = ("".join(f"\\u{ord(c):04x}" for c in SPACES if (c < "\u0100") == low)
               for low in (True, False))
_ONE_SPACE = rf"[{_LOW}[\u1680-\u3000&&[{_HIGH}]]]"
SPACE_RUN = f"{_ONE_SPACE}+"
_FIRST_WORDS = rf"^(?:[^{_LOW}{_HIGH}]++{_ONE_SPACE}++){{0,%d}}+[^{_LOW}{_HIGH}]++"
# A run of spaces is tried once, from its start or where the cut before ended.
_COMMA = rf"(?:\G|(?<!{_ONE_SPACE})){_ONE_SPACE}*+,{_ONE_SPACE}*+"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends; a pattern would be tried at every character."""
    return F.btrim(text, F.lit(SPACES))


def first_words(stripped: Column, n: int) -> Column:
    """The first ``n`` words of a stripped text with a blank between, without cutting the rest."""
    return F.regexp_replace(F.regexp_extract(
        stripped, _FIRST_WORDS % (n - 1), 0), SPACE_RUN, " ")


def squeeze(text: Column) -> Column:
    """Collapse white-space runs to one blank and trim."""
    return strip(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def normalize_title(title: Column) -> Column:
    """Matching key of a title: case, punctuation and one leading article do not count.

    A null title takes part under the text ``nan``.
    """
    lowered = strip(F.lower(F.coalesce(title, F.lit("nan"))))
    bare = F.regexp_replace(lowered, rf"(?U)[^\p{{L}}\p{{N}}_\s\x1c-\x1f]", " ")
    return squeeze(F.regexp_replace(bare, rf"(?U)^(the|a|an){_SPACE}+", ""))


def first_year(text: Column) -> Column:
    """First run of four digits as an int, null when there is none."""
    return F.regexp_extract(text, "([0-9]{4})", 1).try_cast("int")


def normalize_year(text: Column) -> Column:
    """Four-digit year text inside the accepted range, else ``Unknown``."""
    low, high = S.YEAR_RANGE
    found = F.regexp_extract(text, "([0-9]{4})", 1)
    return F.when(found.try_cast("int").between(low, high), found).otherwise(S.UNKNOWN)


def recency_key(text: Column) -> Column:
    """Sort key of the newest-N cut: any four digits count, nothing parseable is 0."""
    return F.coalesce(first_year(text), F.lit(0))


def parse_year_bound(text: Column) -> Column:
    """A year bound typed by a person: digits only, otherwise no bound.

    A number of any length is a bound: past the range of a long it is that range's end, which no
    year reaches either.
    """
    bare = strip(text)
    number = F.coalesce(bare.try_cast("bigint"), F.lit((1 << 63) - 1))
    return F.when(bare.rlike("^[0-9]+$"), number)


# Letters whose title form is one character other than their capital (digraphs, Greek with a
# subscript, Georgian), each with that form.
_TITLE_FORMS = {
    c: c.title() for c in map(chr, range(0x180, 0x2000))
    if len(c.title()) == 1 and c.title() != c.upper()}
# Letters whose title form has several characters that are not a capital and small letters.
_LONG_TITLE_FORMS = {
    c: c.title() for c in map(chr, range(0x100, 0x2000))
    if len(c.title()) > 1 and c.title() != c.upper()[0] + c.upper()[1:].lower()}


def title_case(text: Column) -> Column:
    """Title form for the first letter of every run of cased letters, lower case for the rest.

    A letter without case (as in most scripts) ends a run like any other character.
    """
    before, after = "".join(_TITLE_FORMS), "".join(_TITLE_FORMS.values())

    def cased(run: Column) -> Column:
        head = F.left(run, F.lit(1))
        special = F.translate(head, before, after)
        # A first letter that grows when raised (ß) keeps only its first half capital.
        raised = F.upper(head)
        plain = F.concat(F.left(raised, F.lit(1)), F.lower(F.substr(raised, F.lit(2))))
        long_form = F.create_map(*[F.lit(x) for pair in _LONG_TITLE_FORMS.items() for x in pair])
        first = F.when(head.rlike(f"[{before}]"), special).when(
            head.isin(*_LONG_TITLE_FORMS), long_form[head]).otherwise(plain)
        # Lowered behind a letter: a sigma takes its final form only after one.
        rest = F.substr(F.lower(F.concat(F.lit("a"), F.substr(run, F.lit(2)))), F.lit(2))
        return F.concat(first, rest)

    runs = F.regexp_extract_all(text, F.lit(f"({S.CASED}+|{S.UNCASED}+)"), 1)
    return F.array_join(F.transform(runs, cased), "")


def genre_parts(text: Column) -> Column:
    """Distinct cleaned genre names of one value (null gives an empty array)."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), S.GENRE_SPLIT), strip)
    kept = F.filter(parts, lambda p: ~F.lower(p).isin(*S.GENRE_NOISE))
    return F.array_distinct(F.transform(kept, title_case))


def term_parts(text: Column) -> Column:
    """Cleaned comma-separated terms of one value, in their order.

    The whole value is cleaned before it is cut, as no character that goes is a comma, and the
    cuts take the white space around them."""
    bare = strip(F.regexp_replace(F.coalesce(text, F.lit("")), S.TERM_CLEAN, ""))
    return F.filter(F.split(bare, _COMMA), lambda p: ~F.lower(p).isin(*S.TERM_NOISE))


def tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def null_tokens(text: Column) -> Column:
    """Null where a scanned field holds one of the usual missing-value texts."""
    return F.when(~text.isin(*S.NA_TOKENS), text)


def combined_text(
    title: Column, year: Column, genre: Column, cast: Column, director: Column,
    keywords: Column, plot: Column, max_plot_chars: int = S.EMBED_PLOT_CHARS,
) -> Column:
    """One searchable text per entity; optional parts vanish when they are empty."""

    def optional(label: str, value: Column, *absent: str) -> Column:
        return F.when(~value.isin("", *absent), F.concat(F.lit(label), value))

    return F.concat_ws(
        ". ",
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Release Year: "), year),
        F.concat(F.lit("Genre: "), genre),
        optional("Cast: ", cast),
        optional("Director: ", director, S.UNKNOWN),
        optional("Keywords: ", keywords),
        F.concat(F.lit("Plot: "), F.substring(plot, 1, max_plot_chars)),
    )


def digest(x: Column) -> Column:
    """SHA-256 of a text: what stands for it where many texts are compared."""
    return F.sha2(x, 256)
