"""Main text of web pages by two-pass block rules.

A page is cut into blocks at the tags that start a line of their own. First pass: a block in a menu,
header, footer, sidebar, notice, advert, form or comment list is bad (by its element, role or
class); so is one mostly of links. A block of ``LONG`` words or more with enough stop words is good. One without is
bad only if it is in Latin letters on a page most of whose long text has them, as the known stop words say nothing on
other languages. Letters of scripts without blanks count as half a word. What is left, short blocks above all, is ambiguous.
Second pass: an ambiguous block takes the label of its nearest decided neighbours, hidden blocks aside; the nearer one
wins where they differ, in a tie a heading goes with what follows and any other block with what is before. A class, or a form, hides no element that holds most of the page's text
with its <main> or <h1>, or nearly all of it. Where a page marks its article or main part, and no more text is in long good blocks outside, only
blocks of that part can be good, long blocks there need no stop words, and only neighbours there count; a part
without any decided block is good as a whole, and so is a page of short blocks alone.

Defined results: null, empty or text-free html gives an empty text. Markup that is cut off or not
closed is read up to its end: an open script hides the rest, an open tag is dropped. Scripts, styles
and comments are never text. Character references are decoded once. Equal rows give equal results,
a null page_id or url is kept, an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from termlens.llm.batches import pieces

#: Words from which a block is long, and least shares of stop words and links.
LONG = 10
STOP_DENSITY = 0.1
LINK_DENSITY = 0.5
#: Share of a page's text that a class hides in no case.
NEARLY_ALL = 0.9

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can for from had has have he her his if in is it its no not of on
    one or our she so than that the their there they this to was we were which who will with would you your
    aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist man mit nach
    nicht noch nur oder sich sie sind so um und von war wie wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ont ou par pas plus pour
    qui que sa se ses son sont sur un une vous
    al como con cuando del desde ella ellos entre era esta este han hay las lo los más muy nos para pero por porque ser sin
    sobre su sus también tiene todo una uno y ya""".split()
)

_BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2
    h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot
    th thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(
    """head title script style noscript template svg iframe object canvas audio video textarea select button input label
    nav aside footer menu dialog search""".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of class and id names of parts that are no article.
_PARTS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer
    comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter
    subscribe subscription widget widgets toolbar pagination pager login signup copyright""".split()
)
#: Words of class names that tell of the page's state, as in has-sidebar or header-fixed.
_STATES = frozenset("has with without no not is enabled disabled fixed sticky static open closed active visible".split())
_CONTAINERS = ("article", "main")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title)\b(?P<rawrest>[^>]*)>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-z\-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]+")
#: Letters of scripts that set no blanks between words: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    text: str
    words: int
    stops: int
    linked: float
    hidden: bool
    container: int  # number of the article or main part, 0 outside
    latin: bool = True  # whether half of its letters are Latin
    heading: bool = False
    part: int = 0  # number of the innermost element that its class hides, 0 for none

    @property
    def is_text(self) -> bool:
        return not self.hidden and self.linked <= LINK_DENSITY

    @property
    def is_long(self) -> bool:
        return self.is_text and self.words >= LONG

    @property
    def has_stops(self) -> bool:
        return self.stops >= STOP_DENSITY * self.words


def _hiding(name: str, rest: str, inside: bool) -> str:
    """"always" or "part" (unless it holds the page's text) if an element starts a part that is no article, or nothing."""
    if name in _HIDDEN or name == "header" and not inside:
        return "always"
    found = "part" if name == "form" else ""
    if not rest or name in ("html", "body", *_CONTAINERS):
        return found
    for key, one, two, three in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), one or two or three
        if key in ("class", "id"):
            if not (inside and name in ("header", "h1")) and any(_names_part(token) for token in value.lower().split()):
                found = "part"
        elif key == "role" and value.lower() in _ROLES:
            return "always"
        elif key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDING.search(value):
            return "always"
    return found


def _names_part(token: str) -> bool:
    words = re.split(r"[^a-z0-9]+", token)
    return not _PARTS.isdisjoint(words) and _STATES.isdisjoint(words)


def blocks(html: str) -> list[Block]:
    """The page's blocks that hold text, in order."""
    found: list[Block] = []
    held: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, hidden, container, part
    opened: Counter[str] = Counter()  # names on the stack
    parents, marked = [0], [False]  # of each part: the part around it, whether it holds <main> or <h1>
    containers = links = 0

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(t for t, _ in held)).split())
            if text:
                words = _WORD.findall(text.lower())
                linked = sum(len(t.strip()) for t, link in held if link) / max(1, sum(len(t.strip()) for t, _ in held))
                name, hidden, container, part = stack[-1] if stack else ("", False, 0, 0)
                count = max(len(text.split()), len(_UNSPACED.findall(text)) // 2)
                latin = 2 * sum(map(len, _LATIN.findall(text))) >= sum(map(len, words))
                stops = sum(w in STOP_WORDS for w in words)
                found.append(Block(text, count, stops, linked, hidden, container, latin, name in _HEADINGS, part))
            held.clear()

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at:
            held.append((html[at : token.start()], links > 0))
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append((" ", links > 0))
            continue
        if name in _BLOCKS or name in _HIDDEN:
            flush()
        if token["close"]:
            while opened[name]:
                closed = stack.pop()[0]
                opened[closed] -= 1
                links -= closed == "a"
                if closed == name:
                    break
        elif name not in _VOID and not token["rest"].rstrip().endswith("/"):
            _, hidden, container, part = stack[-1] if stack else ("", False, 0, 0)
            hiding = _hiding(name, token["rest"], container > 0)
            hidden = hidden or hiding == "always"
            if hiding == "part" and not hidden:
                parents.append(part)
                marked.append(False)
                part = len(parents) - 1
            if name in ("main", "h1") and not hidden:
                marked[part] = True
            if name in _CONTAINERS and not container and not hidden:
                containers += 1
                container = containers
            links += name == "a"
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                opened["p"] -= 1
            stack.append((name, hidden, container, part))
            opened[name] += 1
    if at < len(html):
        held.append((html[at:], links > 0))
    flush()
    if len(parents) > 1:
        _hide_parts(found, parents, marked)
    return found


def _hide_parts(page: list[Block], parents: list[int], marked: list[bool]) -> None:
    """Hide the blocks of every part but those that hold the page's text."""
    words = [0] * len(parents)
    for block in page:
        if block.is_text:
            words[block.part] += block.words
    for part in range(len(parents) - 1, 0, -1):
        words[parents[part]] += words[part]
        marked[parents[part]] |= marked[part]
    opened = [2 * w > words[0] and (mark or w >= NEARLY_ALL * words[0]) for w, mark in zip(words, marked)]

    def closed() -> list[bool]:
        shut = [False]
        for part in range(1, len(parents)):
            shut.append(shut[parents[part]] or not opened[part])
        return shut

    shut = closed()
    if not any(b.is_long and not shut[b.part] for b in page):
        opened = [one or mark for one, mark in zip(opened, marked)]
        shut = closed()
    for block in page:
        block.hidden = block.hidden or shut[block.part]


def labels(page: list[Block]) -> list[bool]:
    """Which blocks are the main text."""
    longs = [b for b in page if b.is_long]
    # whether the page is in a language whose stop words are known
    known = 2 * sum(b.words for b in longs if b.has_stops) >= sum(b.words for b in longs if b.latin or b.has_stops)

    def is_good(block: Block) -> bool:
        return block.has_stops or not block.latin or not known

    inside = sum(b.words for b in page if b.container and b.is_text)
    marked = any(b.container and not b.hidden for b in page)
    marked = marked and inside >= sum(b.words for b in longs if not b.container and is_good(b))
    first: list[bool | None] = []
    for block in page:
        if block.hidden or marked and not block.container:
            first.append(False)
        elif block.linked > LINK_DENSITY:
            first.append(None if marked else False)
        elif block.words >= LONG:
            first.append(marked or is_good(block))
        else:
            first.append(None)
    # runs of blocks that may look at each other: one part, or the whole page without parts
    parts: dict[int, list[int]] = {}
    for number, block in enumerate(page):
        if not block.hidden and (block.container or not marked):
            parts.setdefault(block.container if marked else 0, []).append(number)
    final = [bool(label) for label in first]
    for numbers in parts.values():
        if all(first[n] is None for n in numbers):
            for n in numbers:
                final[n] = True
            continue
        decided = [place for place, n in enumerate(numbers) if first[n] is not None]
        following = 0
        for place, n in enumerate(numbers):
            while following < len(decided) and decided[following] < place:
                following += 1
            if first[n] is None:
                before = decided[following - 1] if following else None
                after = decided[following] if following < len(decided) else None
                if before is None or after is None:
                    final[n] = bool(first[numbers[after if before is None else before]])
                elif place - before != after - place:
                    final[n] = bool(first[numbers[before if place - before < after - place else after]])
                else:
                    final[n] = bool(first[numbers[after if page[n].heading else before]])
    return final


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    return "\n".join(block.text for block, good in zip(page, labels(page)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    source = pages.select("page_id", "url", "html")
    kinds = [source.schema[name].dataType.simpleString() for name in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            texts = [main_text(html) for html in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return source.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
