"""Main text of web pages by block rules in two passes.

Markup is cut into blocks at block-level tags. Scripts, styles, heads, selects and other parts that hold no prose go as they are
met. Menus, headers, footers, sidebars, forms, adverts, notices and reader comments, known by tag, role, or the words of class
and id, are marked, and a marked part goes unless it holds nearly all plain text of the page or its article: then the mark
is wrong (a form around the page, a class like layout-sidebar-right, a sidebar that is never closed), and only what is marked
inside it is looked at. The first pass classifies each block by its length, link density and stop-word density as good, bad, or ambiguous;
short blocks, and blocks inside an article without stop words, are ambiguous. On a page in whose long blocks the known stop
words hardly occur, length and link density decide alone. In the second pass, an ambiguous block takes the label of its
nearest decided neighbours (good if they differ inside an article, bad elsewhere). If a page marks its article (article,
main, role main), blocks outside it are bad, and inside it the link density alone decides: ambiguous blocks end good.

A part ends where HTML ends it: at its end tag, at a tag that implies it (a p at the next p or table, a li at the next li), or
at the end of an element around it. Inside an article, ids of headings and sections name what they are about (id="search"),
so only their class and role mark them as other than main text; ids of sections beside an article in a main still count.

Null and empty pages give an empty string, an empty table no rows; rows with one page_id are each extracted by itself; a page
of any length is read in one pass, in time proportional to it. Other columns than the three named are ignored. White space
inside a block becomes one space; blocks are joined by an empty line."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SKIP_TAGS = frozenset("button canvas datalist embed head iframe map math noscript object select svg template textarea".split())
#: Parts that are no main text unless nearly all of the page is in them.
MARKED_TAGS = frozenset("aside dialog footer form menu nav".split())
RAW_TAGS = ("script", "style")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole words of class, id and role that mark parts without main text.
SKIP_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
#: Before such a word they say what the layout around them has, as in no-sidebar or has_banner.
LAYOUT_WORDS = frozenset("has have hide no non not with without".split())
#: Words and tags of parts that are long at times though they are no main text.
STRONG = frozenset("aside comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr header masthead menu nav navbar navigation notice notices replies reply respond".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its more most no not of on one only or other our out she should so some such than that the their them then there these they this to was we were what when where which who will with would you your "
        "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur "
        "au aux avec ce ces cette dans de des du elle en est et été être il ils je la le les leur lui mais me même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses son sont sur tu un une vous y à "
        "al como con cuando de del desde donde el ella en entre era es esta este fue ha hasta hay la las lo los más me mi muy nada no nos o para pero por porque que quien se ser si sin sobre su sus también te tiene todo un una y ya"
    ).split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their end tags leave elements open that were opened inside them.
FORMATTING = frozenset("a b big code em font form i nobr s small strike strong tt u".split())
_HEAD = frozenset("base link meta noframes noscript script style template title".split())
#: End tags, and tags that imply an end, don't act beyond these.
_SCOPE = frozenset("applet caption marquee object select table td template th".split())
_BOUNDED = BLOCK_TAGS | _SCOPE | frozenset("button dialog hgroup search".split())
_ROWS = frozenset("caption colgroup tbody td tfoot th thead tr".split())
_TABLE = frozenset(("table", "template"))
_ENDS_P = BLOCK_TAGS - _ROWS - frozenset("body head html legend noscript optgroup option title".split()) | frozenset("dialog hgroup search".split())
_DEFINED, _CELLS = frozenset(("dd", "dt")), frozenset(("td", "th"))
_ITEM_BOUNDS = _BOUNDED - frozenset("address div p".split())
#: For a start tag: the elements that it ends, and the bounds.
_IMPLIED = {
    "li": (frozenset(["li"]), _ITEM_BOUNDS - {"li"}), "dd": (_DEFINED, _ITEM_BOUNDS - _DEFINED), "dt": (_DEFINED, _ITEM_BOUNDS - _DEFINED),
    "option": (frozenset(["option"]), _SCOPE | {"optgroup"}), "optgroup": (frozenset(["option", "optgroup"]), _SCOPE),
    "td": (_CELLS, _TABLE | {"tr"}), "th": (_CELLS, _TABLE | {"tr"}), "tr": (_ROWS - {"tbody", "thead", "tfoot"}, _TABLE | {"tbody", "thead", "tfoot"}),
    "button": (frozenset(["button"]), _SCOPE),
    **dict.fromkeys("caption colgroup tbody tfoot thead".split(), (_ROWS, _TABLE)),
}
#: For an end tag: the bounds, where they aren't those of its kind.
_END_BOUNDS = {"p": _SCOPE | {"button"}, "li": _SCOPE | {"ol", "ul"}, "table": frozenset(["template"]), "template": frozenset(), **dict.fromkeys(_ROWS, _TABLE)}
#: Deeper elements make the outermost be forgotten, which bounds the work for a tag; browsers nest no deeper either.
_DEEPEST = 512
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")


@dataclass(frozen=True)
class Rules:
    """Characters of a block that isn't short, and that is long; densities of stop words; greatest density of links; density
    of stop words under which a page's language isn't known; share of the plain text with which a marked part stays, and
    its characters at least, for parts of STRONG words and others."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    links: float = 0.4
    unknown: float = 0.05
    most: float = 0.67
    nearly_all: float = 0.9
    strong_chars: int = 1500


@dataclass
class Block:
    """inside: 2 in an article, 1 in a main, else 0; part: the number of the marked part that it is in, from 1."""

    text: str
    link_chars: int
    inside: int
    heading: bool
    part: int = 0
    label: str = ""


@dataclass
class Part:
    outer: int
    strong: bool


class Elements:
    """The elements that are open: names, the marked part that each opens (0: none) and its level of main text; the place
    among them of the one that is left out (-1 for none)."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.parts: list[int] = []
        self.mains: list[int] = []
        self.skip = -1
        self.links = self.headings = 0
        self._parts: list[int] = [0]  # those that are open, from the outermost
        self._mains: list[int] = [0]

    def part(self) -> int:
        return self._parts[-1]

    def open_parts(self) -> list[int]:
        return self._parts

    def inside(self) -> int:
        return max(self._mains)

    def mark(self, part: int) -> None:
        """The innermost element opens a marked part."""
        self.parts[-1] = part
        self._parts.append(part)

    def main(self, level: int) -> None:
        """The innermost element holds main text; marked parts around it should have ended before."""
        self.mains[-1] = level
        self._mains.append(level)
        self.parts[:], self._parts = [0] * len(self.names), [0]

    def _count(self, name: str, n: int) -> None:
        self.links += n * (name == "a")
        self.headings += n * (name in HEADINGS)

    def _find(self, ended: frozenset[str], bounds: frozenset[str], nearest: bool = False) -> int:
        found = -1
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in ended:
                found = i
                if nearest:
                    break
            elif self.names[i] in bounds:
                break
        return found

    def _cut(self, at: int) -> None:
        if at >= 0:
            while len(self.names) > at:
                self._remove(len(self.names) - 1)

    def _remove(self, at: int) -> None:
        name, part, level = self.names.pop(at), self.parts.pop(at), self.mains.pop(at)
        self._count(name, -1)
        if part:
            self._parts.remove(part)
        if level:
            self._mains.remove(level)
        self.skip = -1 if at == self.skip else self.skip - (self.skip > at)

    def imply(self, name: str) -> None:
        """Ends what a start tag of that name ends."""
        names = self.names
        if not names:
            return
        if "head" in names and name not in _HEAD and (name in BLOCK_TAGS or names[-1] == "head") or names[-1] in HEADINGS and name in HEADINGS:
            self._cut(names.index("head") if "head" in names else len(names) - 1)
        if name in _ENDS_P and "p" in names:
            self._cut(self._find(frozenset(["p"]), _END_BOUNDS["p"]))
        if name == "a":
            self.end(name)
        elif name in _IMPLIED:
            self._cut(self._find(*_IMPLIED[name]))

    def open(self, name: str) -> None:
        self.names.append(name)
        self.parts.append(0)
        self.mains.append(0)
        self._count(name, 1)
        if len(self.names) > _DEEPEST:  # the outermost that marks nothing
            plain = (i for i in range(64) if i != self.skip and not self.parts[i] and not self.mains[i])
            self._remove(next(plain, 1 if self.skip == 0 else 0))

    def end(self, name: str) -> bool:
        """Takes an end tag; whether it ends an element that isn't inside the one left out, nor that one."""
        names, skip = self.names, self.skip
        ended = HEADINGS if name in HEADINGS else frozenset([name])
        if name not in HEADINGS and name not in names:
            return False
        if skip >= 0 and name == names[skip]:
            self._cut(self._find(ended, frozenset(), True))
            return False
        bounds = _END_BOUNDS.get(name) if name in _END_BOUNDS else _SCOPE if name in _BOUNDED or name in FORMATTING else _BOUNDED
        at = self._find(ended, bounds, True)
        if at < 0:
            return False
        if name in FORMATTING and not self.parts[at]:
            self._remove(at)
        else:
            self._cut(at)
        return at < skip


def marks(attributes: str, by_id: bool = True) -> frozenset[str]:
    """The words by which attributes mark a part without main text; its id counts only if by_id."""
    if not attributes or attributes.isspace():
        return frozenset()
    out = set()
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "role") or name == "id" and by_id:
            for part in value.split():
                words = _WORD.findall(part)
                out |= {w for v, w in zip(["", *words], words) if w in SKIP_WORDS and v not in LAYOUT_WORDS}
        elif name == "hidden" and not attributes[max(0, m.start() - 1)] in "-\"'" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.add("hidden")
    return frozenset(out)


def blocks(page: str) -> tuple[list[Block], list[Part]]:
    """The page's blocks in order, those of marked parts too, and these parts by number from 1 (the first entry is the page)."""
    found: list[Block] = []
    text: list[str] = []
    breaks = link_chars = 0
    seen = False
    elements, parts = Elements(), [Part(0, False)]
    current = inside = 0  # of the elements that are open
    heading = link = False

    def close() -> None:
        nonlocal link_chars
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                found.append(Block(whole, min(link_chars, len(whole)), inside, heading, current))
            text.clear()
        link_chars = 0

    def data(more: str) -> None:
        nonlocal link_chars, breaks
        if more and elements.skip < 0:
            text.append(more)
            if not more.isspace():
                breaks = 0
            if link:
                link_chars += len(_SPACE.sub(" ", html.unescape(more)).strip())

    def renew() -> None:
        """After elements changed: a block ends where another part begins."""
        nonlocal current, inside, heading, link
        if elements.part() != current:
            close()
        current, inside, link, heading = elements.part(), elements.inside(), elements.links > 0, elements.headings > 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            data(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        empty = name in VOID_TAGS or attributes.endswith("/")
        skipped, names = elements.skip, elements.names
        pushed = False
        if closing:
            outside = elements.end(name)
            if not outside and skipped >= 0:
                continue
        else:
            if skipped >= 0 and name in ("article", "main") and names[skipped] != "template":
                elements.skip = -1  # the part that should have ended before never did
            elements.imply(name)
            if not empty and name not in ("html", "body"):
                elements.open(name)
                pushed = True
            if elements.skip >= 0:
                continue
        if name in BLOCK_TAGS:
            close()
            breaks = 0
        elif name == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                close()
        if pushed:
            subject = heading or name in HEADINGS or name == "section" and ("article" in names or not seen)
            words = marks(attributes, not (inside and subject))
            commentary = bool(words & COMMENTS) or name == "article" and any(parts[p].strong for p in elements.open_parts())
            main = (name in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", attributes)) and not commentary
            seen = seen or name == "article" and not commentary
            if main:
                elements.main(2 if name == "article" else 1)
            elif name in SKIP_TAGS or "hidden" in words:
                close()
                elements.skip = len(names) - 1
            elif words or name in MARKED_TAGS or name == "header" and not inside:
                parts.append(Part(elements.part(), bool((words | {name}) & STRONG)))
                elements.mark(len(parts) - 1)
        if pushed or closing or not empty:
            renew()
    if at < len(page):
        data(page[at:])
    close()
    return found, parts


def kept(found: list[Block], parts: list[Part], rules: Rules = Rules()) -> list[Block]:
    """Without the blocks of marked parts, but for parts that hold nearly all plain text there is: of the articles, else of the
    mains, else of the page."""
    level = max((b.inside for b in found), default=0)
    chars = [0] * len(parts)
    for b in found:
        if b.inside == level:
            chars[b.part] += len(b.text) - b.link_chars
    for p in range(len(parts) - 1, 0, -1):
        chars[parts[p].outer] += chars[p]
    out = [False] * len(parts)
    for p in range(1, len(parts)):
        own, rest = chars[p], chars[0] - chars[p]
        strong = parts[p].strong
        enough = own >= (rules.strong_chars if strong else rules.long)
        share = rules.nearly_all if strong or rest >= rules.long else rules.most
        out[p] = out[parts[p].outer] or not enough or own < share * chars[0]
    return [b for b in found if not out[b.part]]


def _size(text: str) -> int:
    """Characters; one of a script without spaces says as much as two."""
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def classify(found: list[Block], rules: Rules = Rules()) -> list[Block]:
    """Both passes; every block gets the label good or bad."""
    marked = any(b.inside for b in found)
    words = [b.text.lower().split() for b in found]
    stops = [sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in own) for own in words]
    prose = [i for i, b in enumerate(found) if _size(b.text) >= rules.short and b.link_chars <= rules.links * len(b.text)]
    unknown = sum(stops[i] for i in prose) < rules.unknown * sum(len(words[i]) for i in prose)
    for i, b in enumerate(found):
        density, size = b.link_chars / len(b.text), _size(b.text)
        if marked and not b.inside:
            b.label = "bad"
            continue
        stop = stops[i] / len(words[i])
        if density > rules.links:
            b.label = "" if b.heading else "bad"
        elif size < rules.short:
            b.label = ""
        elif unknown or stop >= rules.stop_high or stop >= rules.stop_low and size >= rules.long or b.inside and stop >= rules.stop_low:
            b.label = "good"
        else:
            b.label = "" if b.inside else "bad"
    decided = [b.label for b in found]
    before: list[str] = []
    last = ""
    for label in decided:
        last = label or last
        before.append(last)
    last = ""
    for i in range(len(found) - 1, -1, -1):
        last = decided[i] or last
        if not decided[i]:
            b = found[i]
            near = {x for x in (before[i], last) if x}
            b.label = near.pop() if len(near) == 1 else "good" if b.inside else "bad"
            if b.inside and b.label == "bad" and b.link_chars <= rules.links * len(b.text):
                b.label = "good"  # a link list beside it says nothing about plain text of an article
    return found


def extract(page: str | None, rules: Rules = Rules()) -> str:
    return "\n\n".join(b.text for b in classify(kept(*blocks(page or ""), rules), rules) if b.label == "good")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [extract(x.as_py(), rules) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
