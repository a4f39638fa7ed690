"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is read into blocks: runs of text between block-level tags, with character references decoded and
white space turned into single spaces. A linear classifier (``page_model``: length, link density, punctuation,
the block's own tag, evidence of the tags and class names around it; fitted to generated pages) gives each
block the log-odds of being content; these are the terminal capacities. Neighbouring blocks, and blocks near
each other in the element tree, are joined by smoothness edges, heavier the nearer. The minimum cut separates
content from boilerplate: short paragraphs that say nothing by themselves go with what stands around them.

Class names are evidence, not a verdict: a word of one that names boilerplate counts only where no other word
of the same name speaks for content, and inside an article or main only on containers whose name says nothing
else. Scripts, styles, form controls, comments of the markup and the head never become blocks, nor does what the
``hidden`` attribute or display:none hides; controls and formulas inside a sentence don't part it. Unclosed and
wrongly nested tags are closed as browsers do for paragraphs and list items; an attribute value ends at its
closing quote, however far, or at the first > if there is none; text cut off inside a tag is markup. Reading
is linear in the page; nothing is capped but distances in the element tree, which count as 24 beyond that.

Null and empty html give an empty text, as do pages without content. Repeated pages give repeated rows, an
empty table an empty one. Other columns are kept; a column with the output's name is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .min_cut import min_cut_labels
from .page_model import statistics, weights
from .word_cache import hold

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_NAMING = frozenset("class id role aria-label itemprop".split())
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SKIP = frozenset("head script style template textarea svg iframe select option button audio video canvas".split())
_RAW = frozenset("script style textarea title iframe template svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr button select option math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mspace "
    "semantics annotation".split()
)
_AWAY = frozenset("nav footer aside menu dialog".split())
_FORM = frozenset(["form", "fieldset"])
_HOME = frozenset("article main".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies respond".split())
_AWAY_WORDS = _COMMENT_WORDS | frozenset(
    "nav navbar navigation menu menubar topbar footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice alert popup modal subscribe subscription newsletter signup login share sharing "
    "social related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar masthead copyright legal disclaimer "
    "tags tagcloud search contentinfo complementary".split()
)
#: words that name nothing else than adverts
_ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo".split())
_HOME_WORDS = frozenset("article content post entry story main text".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split()) | _INLINE
_CLOSES = {
    "p": frozenset(["p"]),
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
}
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
)
_FENCE = frozenset("article aside div footer form header main nav section table ul ol dl td th blockquote body html".split())
FAR = 24


@dataclass(slots=True)
class Element:
    """``home``: in an article or main element; ``home_named``: in one so named. ``away``: in a navigation,
    aside, footer ... element inside the nearest article or main (or anywhere, without one),
    ``away_around``: in one outside it; ``away_named`` and ``away_named_around``: the same of class names;
    ``form``: in a form inside the nearest article or main (or anywhere, without one). ``box``: the nearest
    element, itself included, that isn't an inline one."""

    tag: str
    depth: int
    parent: Element | None
    box: Element | None = None
    home: bool = False
    home_named: bool = False
    away: bool = False
    away_around: bool = False
    form: bool = False
    away_named: bool = False
    away_named_around: bool = False
    comment: bool = False
    skip: bool = False


@dataclass(slots=True)
class Block:
    element: Element
    text: str = ""
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    length: int = 0


class _Tags:
    """Ends of the tags of one page."""

    def __init__(self, page: str):
        self.page = page
        self.unclosed = {'"': len(page), "'": len(page)}  # from here on no such quote follows

    def end(self, at: int) -> int:
        """Position behind the tag whose name ends at ``at``: the first > outside quoted values. A quote that
        never closes begins no value."""
        page = self.page
        end = page.find(">", at)
        if end < 0:
            return len(page)
        i = at
        while True:
            double, single = page.find('"', i, end), page.find("'", i, end)
            opens = min(x for x in (double, single, end) if x >= 0)
            if opens == end:
                return end + 1
            quote = page[opens]
            if page[opens - 1] not in "= \t\n\r" or opens >= self.unclosed[quote]:  # no value begins here
                i = opens + 1
                continue
            closes = page.find(quote, opens + 1)
            if closes < 0:
                self.unclosed[quote] = opens
                i = opens + 1
                continue
            i = closes + 1
            if i > end:
                end = page.find(">", i)
                if end < 0:
                    return len(page)


def _named(value: str, tag: str, inside: bool) -> tuple[bool, bool, bool]:
    """What a class attribute or the like says: content, boilerplate, reader comments. Of each name in it, boilerplate
    words count only without content words. ``inside`` an article or main, where a history may be a social one and a
    board one for notices, they count only on containers, in names of such words alone, and a single one only if it
    names adverts or reader comments."""
    home = away = comment = False
    for name in value.lower().split():
        words = _SPLIT.split(name)
        if not _HOME_WORDS.isdisjoint(words) and _COMMENT_WORDS.isdisjoint(words):
            home = True
        elif not _AWAY_WORDS.isdisjoint(words):
            if inside and _COMMENT_WORDS.isdisjoint(words):
                own = [w for w in words if w]
                sole = len(own) == 1 and own[0] not in _ADVERT_WORDS
                if sole or tag in _PROSE or not _AWAY_WORDS.issuperset(own):
                    continue
            away = True
            comment = comment or not _COMMENT_WORDS.isdisjoint(words)
    return home and not away, away, comment


def _child(tag: str, attributes: str, top: Element) -> Element:
    e = replace(top, tag=tag, depth=top.depth + 1, parent=top, skip=top.skip or tag in _SKIP)
    if tag not in _INLINE:
        e.box = e
    if tag in _HOME:
        e.home, e.away_around, e.away_named_around = True, e.away or e.away_around, e.away_named or e.away_named_around
        e.away = e.away_named = e.form = False
    elif tag in _AWAY or tag == "header" and not top.home:
        e.away = True
    elif tag in _FORM:
        e.form = True
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), values[0] or values[1] or values[2]
            if name in _NAMING:
                home, away, comment = _named(value, tag, top.home)
                e.home_named = e.home_named or home
                e.comment = e.comment or comment
                if away and tag not in ("body", "html", *_HOME):
                    e.away_named = True
            elif name == "hidden" or name == "style" and _UNSEEN.search(value):
                e.skip = e.skip or tag not in ("html", "body")
    return e


def read_blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    root = Element("#root", 0, None)
    root.box = root
    stack, links, tags = [root], 0, _Tags(page)
    open_: Counter[str] = Counter()  # elements of the stack by tag
    blocks: list[Block] = []
    block = Block(root)

    def close_block() -> None:
        nonlocal block
        if block.parts:
            text = " ".join("".join(block.parts).split())
            if text:
                block.text, block.parts = text, []
                blocks.append(block)
        block = Block(stack[-1].box)

    def pop_to(depth: int) -> None:
        nonlocal links
        popped = stack[depth:]
        del stack[depth:]
        open_.subtract(e.tag for e in popped)
        if any(e.tag not in _INLINE for e in popped):
            close_block()
        links -= sum(e.tag == "a" for e in popped)

    at, n, lower = 0, len(page), None
    while at < n:
        opens = page.find("<", at)
        if opens < 0:
            opens = n
        if opens > at and not stack[-1].skip:
            text = page[at:opens]
            if "&" in text:
                text = entities.unescape(text)
            block.parts.append(text)
            size = len(text.strip())
            block.length += size
            if links:
                block.linked += size
        if opens == n:
            break
        if page.startswith("<!--", opens):
            end = page.find("-->", opens + 4)
            at = n if end < 0 else end + 3
            continue
        match = _NAME.match(page, opens + 1)
        if not match:
            if page[opens + 1 : opens + 2] in ("!", "?", "/"):
                end = page.find(">", opens)
                at = n if end < 0 else end + 1
            else:  # a sign of the text
                if not stack[-1].skip:
                    block.parts.append("<")
                    block.length += 1
                at = opens + 1
            continue
        tag, closing = match[1].lower(), page[opens + 1] == "/"
        end = tags.end(match.end())
        attributes = page[match.end() : end - 1]
        at = end
        if closing:
            if tag == "p" and not open_["p"]:
                close_block()
            if open_[tag]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        pop_to(depth)
                        break
                    if tag in _INLINE and stack[depth].tag in _FENCE:
                        break
            continue
        if tag in _RAW and not (tag == "svg" and attributes.endswith("/")):  # no other one closes itself
            if lower is None:
                lower = page.lower() if len(page.lower()) == n else page
            end = lower.find(f"</{tag}", at)
            if end < 0:
                end = n
            close = page.find(">", end)
            at = n if close < 0 else close + 1
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag in _VOID or tag == "svg":
            if tag == "hr":
                close_block()
            continue
        ends = _CLOSES.get(tag) or (_CLOSES["p"] if tag in _ENDS_P else None)
        if ends and any(open_[x] for x in ends):
            for depth in range(len(stack) - 1, 0, -1):
                e = stack[depth]
                if e.tag in ends:
                    pop_to(depth)
                elif e.tag in _FENCE:
                    break
        stack.append(_child(tag, attributes, stack[-1]))
        open_[tag] += 1
        if tag == "a":
            links += 1
        if tag not in _INLINE:
            close_block()
    close_block()
    return blocks


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree, FAR at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def content_costs(blocks: list[Block], weights_of: tuple[float, ...], most: float = 8.0) -> list[tuple[float, float]]:
    """(cost of calling it content, cost of calling it boilerplate) of each block: its log-odds of being
    boilerplate or content, ``most`` at most."""
    odds = (statistics(blocks) @ weights_of).clip(-most, most).tolist()
    return [(max(0.0, -z), max(0.0, z)) for z in odds]


def smoothness(blocks: list[Block], near: float = 1.25, beside: float = 0.1) -> list[tuple[int, int, float]]:
    """Edges of neighbours, to a quarter with each step of their distance in the tree beyond that of siblings,
    and of the next block of one parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            steps = max(2, _distance(blocks[i - 1].element, b.element))
            edges.append((i - 1, i, beside + near * 4.0 ** (2 - steps)))
        parent = id(b.element.parent)
        before = last.get(parent)
        if before is not None and before < i - 1:
            edges.append((before, i, near / 2))
        last[parent] = i
    return edges


def labelled(blocks: list[Block], weights_of: tuple[float, ...] | None = None) -> list[bool]:
    """Whether each block is content."""
    if not blocks:
        return []
    return min_cut_labels(content_costs(blocks, weights_of or weights(read_blocks)), smoothness(blocks))


def main_text(page: str | None, weights_of: tuple[float, ...] | None = None) -> str:
    """The page's content blocks in order, joined by empty lines."""
    blocks = read_blocks(page or "")
    return "\n\n".join(b.text for b, content in zip(blocks, labelled(blocks, weights_of)) if content)


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text in column ``out`` (replaced if there is one, in whatever case). Narrow."""
    common.tune(pages.sparkSession)
    fitted = weights(read_blocks)

    def task():
        hold("html", lambda: None)
        return lambda htmls: [pa.array([main_text(h.as_py(), fitted) for h in htmls], pa.string())]

    return common.with_columns(pages, source, [T.StructField(out, T.StringType())], task)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).selectExpr("page_id", "url", "text", "cast(length(text) as long) as n_chars")


QUERIES = {"op6_html": op6_html}
ORACLES: dict[str, str] = {}
