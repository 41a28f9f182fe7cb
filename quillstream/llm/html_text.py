"""Main text of web pages by tree scoring (operator 10).

A page is read into a tree. Every paragraph gives points for its length and commas to its ancestors, the whole to
its parent, half to the next, less further up; a container's points are discounted by the share of its text that
lies in links. The best container is kept with those of its siblings that are of its kind, score near it or are text, headings,
lists or tables, each of plain text. Navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known
by element or by the words in class, id and role, are left out before and inside.

Names are judged as wholes: ``comment-list`` and ``site-header`` name parts outside the article, ``share-price`` and
``no-sidebar`` do not, and nothing that holds the title and most of the plain text of a page is left out by its name.
A form that holds most of the plain text is the frame of its page and stays. What its own ``hidden`` or ``style`` says is not
shown is left out; the words of other attributes and ``aria-hidden`` decide nothing.
Lists of links stay inside the article; where no element marks the article, a list of links before its first or
after its last block is a menu, unless a heading stands right before it.

Defined cases: a null or empty page has no text; unclosed elements end where HTML ends them; a quoted value without
a closing quote ends with its tag, and a tag without an end runs to the end of the page; text outside of any
paragraph is a block of its container; a page without a paragraph gives the text of its body; repeated rows are
each read; an empty table gives an empty result; other columns are ignored. Pages of any length and depth are read
whole, in time that grows with their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_MARK = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*)|/)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
DROPPED = frozenset("nav footer aside form button select dialog menu object canvas audio video label fieldset".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that the start of another closes: by the start, those it closes, up to a border.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_BUT_P = BLOCKS - {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand beside the best container as a part of the article.
BESIDE = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
FIELDS, LETTERS_A_FIELD = frozenset("input select textarea".split()), 200
#: Words in class, id and role that tell what is not the article.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices outbrain pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar side signup social sponsor sponsored subscribe subscription taboola "
    "teaser toolbar widget widgets alert paywall skip complementary contentinfo".split()
)
#: Words that may stand beside those in the name of such a part.
FURNITURE = frozenset(
    "area bar block body bottom box button buttons card center column container content global group header holder icons inner item items label left link links list main menu message nav outer page panel posts primary "
    "right row secondary section site slot top unit wrap wrapper zone form signup thread title first last mobile desktop sticky fixed".split()
)
INSIDE = frozenset("article main content post entry story body text page hentry".split())
_PART = re.compile("[a-z]+")


def _names_outside(names: list[str]) -> bool:
    """Whether a name is made of words for parts outside the article, and of nothing else but furniture."""
    for name in names:
        words = set(_PART.findall(name))
        if words & OUTSIDE and words <= OUTSIDE | FURNITURE:
            return True
    return False


class Element:
    __slots__ = ("tag", "parent", "inside", "words", "named", "wraps", "points", "letters", "linked", "titled", "asks")

    def __init__(self, tag: str, parent: Element | None, names: list[str]):
        self.tag, self.parent = tag, parent
        self.words = frozenset(w for x in names for w in _PART.findall(x))
        self.named = bool(names) and tag not in ("html", "body", "article", "main") and _names_outside(names)
        self.inside: list = []
        self.wraps = False  # a form round the whole page
        self.points, self.letters, self.linked, self.titled, self.asks = 0.0, 0, 0, tag in ("h1", "article", "main"), 0

    def outside(self) -> bool:
        """Whether this is a part that no article has."""
        if self.tag in DROPPED and not self.wraps or self.named:
            return True
        if self.tag == "header":
            return not any(isinstance(x, Element) and x.tag in HEADINGS for x in self.inside) or "page" in self.words or "site" in self.words
        return False


def _attributes(tag: str, marks: str) -> tuple[list[str], bool]:
    """Names in class, id and role; whether the element is not shown, by its own attributes and not by words in their values."""
    names, unseen = [], False
    for name, a, b, c in _ATTRIBUTE.findall(marks):
        name = name.lower()
        if name in ("class", "id", "role"):
            names += (a or b or c).lower().split()
        elif name == "hidden" or name == "style" and _UNSEEN.search(a or b or c):
            unseen |= tag not in VOID
        elif name == "type" and tag == "input":
            unseen |= (a or b or c).lower() == "hidden"
    return names, unseen


def read(page: str) -> list[Element]:
    """The tree of a page, its root first and parents before their children, without comments and the insides of scripts and the like."""
    top = here = Element("html", None, [])
    every = [top]
    opened: dict[str, list[int]] = {}  # depths of the open elements of each tag
    path, shut = [top], []  # the open elements; the depths of the open blocks
    no_more: set[str] = set()  # quotes that the rest of the page does not have
    at = text = 0

    def close_to(d: int) -> None:
        nonlocal here
        while len(path) > d:
            x = path.pop()
            opened[x.tag].pop()
            if shut and shut[-1] == len(path):
                shut.pop()
        here = path[-1]

    def close_first(tags: set[str] | frozenset[str], borders: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of ``tags`` if no border stands inside it."""
        d = max((opened[t][-1] for t in tags if opened.get(t)), default=0)
        if d and d > max((opened[t][-1] for t in borders if opened.get(t)), default=0):
            close_to(d)

    while (start := page.find("<", at)) >= 0:
        m = _MARK.match(page, start)
        if m is None:
            at = start + 1
            continue
        end = m.end()
        if m[3] is None:
            k = page.find("-->" if m[1] else ">", start + 2)
            end = len(page) if k < 0 else k + (3 if m[1] else 1)
        else:
            while (k := _STOP.search(page, end)) is not None and k[0] != ">":
                before = k.start() - 1
                while before >= end and page[before].isspace():
                    before -= 1
                valued, end = before >= end and page[before] == "=", k.end()
                if valued:
                    shut_at = -1 if k[0] in no_more else page.find(k[0], end)
                    if shut_at < 0:
                        no_more.add(k[0])
                        after = page.find(">", end)
                        end = len(page) if after < 0 else after
                        k = None if after < 0 else _STOP.match(page, after)
                        break
                    end = shut_at + 1
            end = len(page) if k is None else k.end()
        if start > text:
            here.inside.append(page[text:start])
        at = text = end
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            d = opened[tag][-1] if opened.get(tag) else 0
            if d and (tag in BLOCKS or not shut or shut[-1] < d):  # an inline end tag does not close a block
                close_to(d)
            continue
        if tag in ("html", "body", "head") and here is top:
            continue
        if tag in BLOCKS:
            close_first({"p"}, _BUT_P)
        if tag in CLOSES:
            close_first(CLOSES[tag], BORDERS[tag])
        marks = page[m.end() : end].removesuffix(">")
        names, unseen = _attributes(tag, marks) if marks else ([], False)
        new = Element("template" if unseen else tag, here, names)
        here.inside.append(new)
        every.append(new)
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = text = over.end() if over else len(page)
        elif tag not in VOID and not marks.endswith("/"):
            depth = len(path)
            opened.setdefault(new.tag, []).append(depth)
            if new.tag in BLOCKS:
                shut.append(depth)
            path.append(new)
            here = new
    if text < len(page):
        here.inside.append(page[text:])
    return every


_LONG_ZERO, _LONG = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond all characters become the replacement character."""
    if "&#" in text:
        text = _LONG.sub("\ufffd", _LONG_ZERO.sub("&#", text))
    return html.unescape(text)


def _plain(pieces: list[str]) -> str:
    return " ".join(decoded("".join(pieces)).split())


def blocks(root: Element) -> Iterator[tuple[Element, str, int]]:
    """(container, text, characters in links) of each block of text in page order."""
    pieces: list[str] = []
    linked: list[str] = []
    holder = root
    stack: list[tuple[Element, int, bool]] = [(root, 0, False)]
    while stack:
        node, i, in_link = stack.pop()
        if i < len(node.inside):
            stack.append((node, i + 1, in_link))
            x = node.inside[i]
            if isinstance(x, str):
                pieces.append(x)
                if in_link:
                    linked.append(x)
            elif x.tag == "br":
                pieces.append(" ")
            elif not x.outside() and x.tag not in VOID:
                if x.tag in BLOCKS:
                    if text := _plain(pieces):
                        yield holder, text, len(_plain(linked))
                    pieces, linked, holder = [], [], x
                stack.append((x, 0, in_link or x.tag == "a"))
            elif x.tag in BLOCKS:
                if text := _plain(pieces):
                    yield holder, text, len(_plain(linked))
                pieces, linked = [], []
        elif node.tag in BLOCKS or node is root:
            if text := _plain(pieces):
                yield holder, text, len(_plain(linked))
            pieces, linked = [], []
            holder = node.parent or root
    if text := _plain(pieces):
        yield holder, text, len(_plain(linked))


def _weigh(every: list[Element], found: list[tuple[Element, str, int]]) -> None:
    """Letters, letters in links, titles and fields to fill in of all elements, those of their descendants included."""
    for e in every:
        e.letters = e.linked = 0
        e.asks = int(e.tag in FIELDS)
    for holder, text, linked in found:
        holder.letters += len(text)
        holder.linked += linked
    for e in reversed(every):
        if e.parent is not None:
            e.parent.letters += e.letters
            e.parent.linked += e.linked
            e.parent.asks += e.asks
            e.parent.titled |= e.titled


def _settle(every: list[Element]) -> None:
    """Take back names that would leave out the title and most of the plain text, and forms that wrap the page: those that hold
    most of the plain text, with the title or at least ``LETTERS_A_FIELD`` letters to each field."""
    named = [e for e in every if e.named]
    forms = [e for e in every if e.tag == "form"]
    if named or forms:
        for e in named:
            e.named = False
        for e in forms:
            e.wraps = True
        _weigh(every, list(blocks(every[0])))
        most = 0.5 * (every[0].letters - every[0].linked)
        for e in named:
            e.named = not (e.titled and e.letters - e.linked > most)
        for e in forms:
            plain = e.letters - e.linked
            e.wraps = plain > most and (e.titled or plain > LETTERS_A_FIELD * e.asks)


def main_text(page: str) -> str:
    """Blocks of the article, joined by two line ends."""
    every = read(page)
    _settle(every)
    found = list(blocks(every[0]))
    _weigh(every, found)
    scored: dict[int, Element] = {}
    for holder, text, linked in found:
        points = 1 + text.count(",") + text.count("\uff0c") + min(len(text) / 100, 3.0)
        node = holder.parent if holder.tag in ("p", "pre") and holder.parent else holder
        share = 1.0
        for level in range(4):
            if node is None:
                break
            node.points += points * share
            scored[id(node)] = node
            node, share = node.parent, (0.5 if level == 0 else share * 0.5)

    def worth(e: Element) -> float:
        bonus = 25.0 if e.tag in ("article", "main") or "main" in e.words and e.tag != "body" else 5.0 if e.words & INSIDE and e.tag != "body" else 0.0
        return (e.points + bonus) * (1 - e.linked / max(1, e.letters))

    if not scored:
        return ""
    best = max(scored.values(), key=worth)
    keep = {id(best)}
    if best.parent is not None and best.tag not in ("article", "main"):
        for x in best.parent.inside:
            if isinstance(x, Element) and x.letters and not x.outside() and x.linked < 0.25 * x.letters:
                if x.tag == best.tag or x.tag in BESIDE or id(x) in scored and worth(x) >= 0.2 * worth(best):
                    keep.add(id(x))
    # Parents come before their children, so one walk tells for each element whether it is kept and marked as the article.
    kept: dict[int, tuple[bool, bool]] = {}
    for e in every:
        up = kept[id(e.parent)] if e.parent is not None else (False, False)
        kept[id(e)] = (up[0] or id(e) in keep, up[1] or e.tag in ("article", "main"))
    out = [(holder, text, linked > 0.8 * len(text) and holder.tag in ("li", "ul", "ol", "div", "td", "dd", "dt") and not kept[id(holder)][1]) for holder, text, linked in found if kept[id(holder)][0]]
    plain = [i for i, (_, _, menu) in enumerate(out) if not menu]
    if plain:
        last = plain[-1]
        out = out[plain[0] :] if out[last][0].tag in HEADINGS else out[plain[0] : last + 1]
    return "\n\n".join(text for _, text, _ in out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(markup).alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
