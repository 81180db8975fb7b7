"""Main text of web pages by block rules in two passes."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import free_name

STOP_WORDS = frozenset((
    # English
    "a an and are as at be been but by for from had has have he her his i in is it its not of on "
    "or she so that the their they this to was we were which will with you "
    # French
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur ne nous on ou par "
    "pas pour que qui sa se ses son sont sur un une vous "
    # German
    "aber als auch auf aus bei das dem den der des die ein eine er es für hat ich im ist mit nach "
    "nicht sich sie sind und von war wie wir zu zum zur "
    # Spanish
    "al como con del el en es esta ha la las lo los más no o para pero por que se su sus una y"
).split())

#: Elements whose content is never text of the page.
_RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes",
        "template", "svg", "math", "select", "object", "audio", "video", "canvas")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr img br".split())
_PAGE_PARTS = frozenset("nav footer aside form menu dialog button head fieldset".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Words in class, id or role that name a part of the page beside its article.
_BESIDE = frozenset((
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices newsletter subscribe subscription popup "
    "modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs toolbar "
    "share sharing social login signin signup pagination pager widget widgets copyright disclaimer "
    "masthead paywall skip alert alertdialog dialog complementary contentinfo search form").split())
#: Those that an article element inside does not undo.
_READERS = frozenset((
    "comment comments commentlist disqus respond reply replies discussion related recommended "
    "recommendations footer").split())

#: Words that name what holds the article where no element says so.
_HOLDS = frozenset(("article", "content", "entry", "main", "post", "story"))
_SCOPES = ("article", "main", "content")

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)                                        # comment
      | <[!?][^>]*(?:>|\Z)                                       # declaration
      | <(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*+)
          (?P<rest>(?>"[^"]*"|'[^']*'|[^>"'])*+>|[^>]*+(?:>|\Z)) # tag, also with an open quote
    """, re.S | re.X)
_ATTRIBUTE = re.compile(
    r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in _RAW}
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: A copyright mark with its year, as notices have it.
_NOTICE = re.compile(r"(?:©|\(c\)|copyright)[\W_]*(?:©|\(c\))?[\W_]*(?:19|20)\d\d", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class BlockRules:
    """Thresholds, lengths in characters. ``inside`` holds within an article or main element."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    link_density: float = 0.2
    link_density_inside: float = 0.6
    stop_words: frozenset[str] = STOP_WORDS


@dataclass
class Block:
    text: str = ""
    links: int = 0
    beside: bool = False
    scope: str = ""
    heading: bool = False
    parent: int = 0
    label: str = field(default="", compare=False)


def _hints(rest: str) -> tuple[frozenset[str], bool, bool]:
    """Words in class, id and role; whether hidden; whether marked as the article's body."""
    words, hidden, body = set(), False, False
    for key, double, single, bare in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), double or single or bare
        if key in ("class", "id", "role"):
            words.update(w.lower() for w in _NAME_PART.findall(value))
            body |= key == "role" and value.lower() == "main"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif key == "itemprop" and value.lower() == "articlebody":
            body = True
    return frozenset(words), hidden, body


def blocks_of(page: str) -> list[Block]:
    """The page cut at block-level tags, with what surrounds each block.

    Tolerates open tags and quotes and a page that breaks off anywhere.
    """
    found: list[Block] = []
    # name, beside the article, for good, scope, number
    stack: list[tuple[str, bool, bool, str, int]] = [("", False, False, "", 0)]
    elements = 0
    pieces: list[str] = []
    links, in_link, heading = 0, 0, False

    def flush() -> None:
        nonlocal links, heading
        text = " ".join(references.unescape("".join(pieces)).split())
        if text:
            _, beside, _, scope, number = stack[-1]
            found.append(Block(text, links, beside, scope, heading, number))
        pieces.clear()
        links, heading = 0, False

    at, end = 0, len(page)
    while at < end:
        match = _MARKUP.search(page, at)
        stop = match.start() if match else end
        if stop > at:
            chunk = page[at:stop]
            pieces.append(chunk)
            if in_link:
                links += len(chunk.strip())
        if not match:
            break
        at = match.end()
        if match["name"] is None:
            continue
        name, closing = match["name"].lower(), bool(match["slash"])
        if name in _RAW:
            if not closing and not match["rest"].endswith("/>"):
                at = _RAW_END[name].search(page, at).end()
            if name not in ("script", "style", "noscript", "template"):
                pieces.append(" ")
            continue
        if name == "a":
            in_link = max(0, in_link - 1) if closing else 1
        if name == "br":
            pieces.append(" ")
        if name in _VOID and name not in ("hr",):
            continue
        plain = name in _INLINE
        if not plain:
            flush()
        if closing:
            heading = False
            if not plain or any(s[0] == name for s in stack[1:]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        if plain:
                            flush()
                        del stack[i:]
                        break
            continue
        if name in ("p", "hr", "body", "html"):
            continue
        heading = name in _HEADINGS
        words, hidden, body = _hints(match["rest"]) if "=" in match["rest"] or (
            "hidden" in match["rest"]) else (frozenset(), False, False)
        _, beside, for_good, scope, _ = stack[-1]
        nested = name == "article" and scope == "article"
        opens = (name in ("article", "main") or body) and not nested
        outer = "header" in words or name == "header"
        readers = bool(words & _READERS) or name in ("aside", "footer") or nested or hidden
        side = bool(words & _BESIDE) or name in _PAGE_PARTS or (outer and scope != "article")
        if plain and not (readers or side):
            continue
        elements += 1
        if plain or (opens and not readers and not for_good):
            flush()
        if opens and not readers and not for_good:
            stack.append((name, False, False, "main" if name == "main" else "article", elements))
            continue
        if not scope and not (beside or readers or side) and words & _HOLDS:
            scope = "content"
        stack.append((name, beside or readers or (side and not opens), for_good or readers,
                      scope, elements))
    flush()
    return found


def _stop_words(text: str, rules: BlockRules) -> tuple[int, int]:
    """Known stop words of a text, and all its words."""
    words = _LETTERS.findall(text.lower())
    return sum(w in rules.stop_words for w in words), len(words)


def _tells_little(blocks: list[Block], rules: BlockRules) -> bool:
    """Whether stop words say nothing about the page: its longer blocks that are not links hold so
    few known ones that its language is another."""
    counts = [_stop_words(b.text, rules) for b in blocks if len(b.text) >= rules.short
              and not b.beside and b.links <= rules.link_density * len(b.text)]
    return sum(c[0] for c in counts) < rules.stop_low * sum(c[1] for c in counts)


def _first_pass(block: Block, rules: BlockRules, foreign: bool = False) -> str:
    """good, bad, near (nearly good) or short. ``foreign``: few stop words are no sign."""
    size = len(block.text)
    density = block.links / size
    inside = bool(block.scope)
    if block.beside or density > (rules.link_density_inside if inside else rules.link_density):
        return "bad"
    if not inside and ("©" in block.text or "copyright" in block.text.lower()) and (
            size < rules.short or size <= rules.long and _NOTICE.search(block.text)):
        return "bad"
    if size < rules.short:
        return "short"
    stops, words = _stop_words(block.text, rules)
    share = stops / words if words else 0.0
    if share >= rules.stop_high:
        return "good" if size > rules.long else "near"
    if share >= rules.stop_low:
        return "near"
    return "short" if inside else "near" if foreign else "bad"


def main_blocks(page: str, rules: BlockRules = BlockRules()) -> list[str]:
    """The blocks of the page's article in page order.

    First every block is judged by what surrounds it, its links, its length and its share of stop
    words. Then the nearly good and after them the short blocks take the label of the nearest
    decided ones: inside an article or main element a block goes only if both sides are bad;
    elsewhere a nearly good one stays if either side is good (or no block of the page is), a
    short one if both are or one in the same element is (a heading: if the next one is). A page
    with hardly any known stop word is in another language: its longer blocks are nearly good. On a
    page with an article element (else a main one, else one named as holding the content) only
    what is inside can stay.
    """
    blocks = blocks_of(page)
    scopes = {b.scope for b in blocks if not b.beside}
    scope = next((s for s in _SCOPES if s in scopes), "")
    if scope:  # what stands beside the article takes no part, also not as a neighbour
        blocks = [b for b in blocks if b.scope == scope and not b.beside]
    foreign = not scope and _tells_little(blocks, rules)
    for block in blocks:
        block.label = _first_pass(block, rules, foreign)
    edge = "good" if scope else "bad"
    for waiting in ("near", "short"):
        _inherit(blocks, waiting, edge, bool(scope))
    return [b.text for b in blocks if b.label == "good"]


def _inherit(blocks: list[Block], waiting: str, edge: str, inside: bool) -> None:
    """Second pass over the blocks labelled ``waiting``: labels of the nearest decided ones."""
    border = Block(label=edge, parent=-1)
    before, nearest = [], border
    for block in blocks:
        before.append(nearest)
        if block.label in ("good", "bad"):
            nearest = block
    alone = not inside and waiting == "near" and not any(b.label == "good" for b in blocks)
    after, nearest, decided = [], border, {}
    for block in reversed(blocks):
        after.append(nearest)
        if block.label in ("good", "bad"):
            nearest = block
    for i, (block, left, right) in enumerate(zip(blocks, before, reversed(after))):
        if block.label != waiting:
            continue
        if inside or waiting == "near":
            good = alone or "good" in (left.label, right.label)
        elif block.heading:
            good = right.label == "good"
        else:  # beside a bad block only as the good one's own kin
            good = any(n.label == "good" and n.parent == block.parent for n in (left, right)) or (
                left.label == right.label == "good")
        decided[i] = "good" if good else "bad"
    for i, label in decided.items():
        blocks[i].label = label


def extract_text(pages: DataFrame, rules: BlockRules = BlockRules(),
                 html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each, blocks joined by one space.

    Whole pages are read, one at a time, inside the scan's own tasks. Null, empty and textless
    pages give an empty text; a column named as ``text`` before is replaced (in any case of
    letters). Repeated rows stay repeated; an empty table gives an empty one.
    """
    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(
                [" ".join(main_blocks(value.as_py() or "", rules)) for value in batch],
                pa.string())

    source = free_name(pages, "_html")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() != text.lower()]
    carried = pages.select(*kept, F.col(f"`{html}`").alias(source))
    return carried.withColumn(text, extracted(F.col(source))).drop(source)
