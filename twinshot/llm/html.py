"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, in page order. Every line weighs its visible
characters outside links; menus, footers, adverts and the like are left out. The block of a line is the
sum of weights over a window of ``WINDOW`` lines. Text surges where the block reaches the threshold and
dives where blocks fall to nothing; what lies between a surge and its dive is main text, short lines
inside it included. The threshold is ``SURGE``, or the page's largest block if that is smaller.

The same rule chooses on every page, by text lengths. An article mark is a bounded factor: if a page has
one, a character inside weighs ``INSIDE`` and one outside ``OUTSIDE``, so an article of under 20 characters
in any three lines does not surge beside longer text.

Pages are read by a scanner that looks at every character a fixed number of times, whatever is left open.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinshot.llm.words import slices

WINDOW = 3
SURGE = 80
#: Weights of a character on a page with an article mark: three lines surge from 20 characters inside, 320 outside.
INSIDE = 4.0
OUTSIDE = 0.25

# Elements by their role in HTML.
_RAW = set("script style iframe title".split())
_BOILERPLATE = set("nav footer aside form menu dialog button select textarea noscript template svg math canvas object".split())
# A form around one of these, or around this many paragraphs, holds the page and is none of its forms.
_PAGE_PARTS = set("article main nav header footer h1".split())
_PAGE_PARAGRAPHS = 3
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul button textarea".split()
)
_MAIN = {"article", "main"}
# Words in class, id or role that name an element's part in the page.
_NAMED = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright "
    "disqus footer header menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related "
    "replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split()
)

# Inside an article, and in names of an article's own parts (entry-header), only these words count.
_UNMISTAKABLE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus menu "
    "modal nav navbar navigation newsletter notice pager pagination popup promo replies respond sharing sidebar sponsored "
    "subscribe".split()
)
_UNMISTAKABLE_NAMES = set("share share-bar share-buttons share-links social-share comment-list comment-form".split())
_OWN_PARTS = set("article content entry post story".split())
# An <article> is out only if it is a reader's comment; other names on it are tags of its subject.
_COMMENT_NAMES = set("comment comments comment-body".split())
# Names such as has-sidebar or no-comments tell of the page, not of the element.
_TELLING = set("has have no with without".split())
# Elements of running text: what holds them directly is a column of text.
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

_OPEN = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
# What may end a tag or open a quoted value; a quote elsewhere in a tag is an ordinary character.
_STOP = re.compile(r""">|=\s*["']""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_NAME = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""\shidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _boilerplate(name: str, attributes: str, in_main: bool, in_article: bool) -> bool:
    if name in _BOILERPLATE or (name == "header" and not in_main):
        return True
    if name in ("body", "html") or not attributes:
        return False
    for m in _NAME.findall(attributes):
        for part in m.lower().strip("\"'").split():
            words = set(_WORD.findall(part))
            if name in _MAIN:
                if part in _COMMENT_NAMES:
                    return True
                continue
            if words & _TELLING:
                continue
            own = in_article or words & _OWN_PARTS
            if part in _UNMISTAKABLE_NAMES or words & (_UNMISTAKABLE if own else _NAMED):
                return True
    return bool(_HIDDEN.search(attributes))


class _Element:
    __slots__ = ("name", "boilerplate", "main", "prose", "holder", "column", "within")

    def __init__(self, name: str, parent: _Element | None = None, boilerplate: bool = False, main: bool = False):
        self.name, self.boilerplate, self.main = name, boilerplate, main
        block = name in _BLOCKS or parent is None
        self.prose = name in _PROSE or (not block and parent.prose)
        #: The nearest element that holds running text, a heading or paragraph not counted.
        self.holder = self if block and not self.prose else parent.holder
        #: Whether running text stood in the element directly, so that it goes on after an advert.
        self.column = False
        self.within = parent is not None and parent.in_column()

    def in_column(self) -> bool:
        h = self.holder
        return h.within or (h.column and h.name not in ("body", "html", ""))


class _Tag(NamedTuple):
    start: int
    end: int
    name: str
    closing: bool = False
    attributes: str = ""
    wraps: bool = False


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place after the tag whose name ends at ``at``, or -1 if nothing ends it."""
    while stop := _STOP.search(page, at):
        at = stop.end()
        if stop[0] == ">":
            return at
        quote = page[at - 1]
        # A quote that nothing closes is an ordinary character; ``last`` says so without a look to the end.
        if at <= last[quote]:
            at = page.index(quote, at) + 1
    return -1


def tags(page: str) -> list[_Tag]:
    """Tags, comments and raw elements (both without a name) of a page, in order.

    A comment or raw element that is left open reaches to the page's end, as in a browser; from a tag
    without an end on all is text.
    """
    last = {q: page.rfind(q) for q in "\"'"}
    found: list[_Tag] = []
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            found.append(_Tag(at, end + 3 if end >= 0 else len(page), ""))
        elif page.startswith("<![CDATA[", at):
            found.append(_Tag(at, at + 9, ""))
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            found.append(_Tag(at, end + 1 if end >= 0 else len(page), ""))
        elif m := _OPEN.match(page, at):
            end = _tag_end(page, m.end(), last)
            if end < 0:
                break
            name, closing = m[1].lower(), page[at + 1] == "/"
            if name in _RAW and not closing:
                close = _RAW_END[name].search(page, end)
                end = _tag_end(page, close.end(), last) if close else -1
                found.append(_Tag(at, end if end >= 0 else len(page), ""))
            else:
                found.append(_Tag(at, end, name, closing, page[m.end() : end - 1]))
        else:
            at = page.find("<", at + 1)
            continue
        at = page.find("<", found[-1].end)
    return _with_wrappers(found)


def _with_wrappers(found: list[_Tag]) -> list[_Tag]:
    """Mark the forms that a page, or the body of one, lies in. Forms don't nest."""
    form, paragraphs = None, 0
    for i, tag in enumerate(found):
        if tag.name == "form":
            form, paragraphs = (None, 0) if tag.closing else (i if form is None else form, paragraphs)
        elif form is not None and not tag.closing:
            paragraphs += tag.name == "p"
            if tag.name in _PAGE_PARTS or paragraphs >= _PAGE_PARAGRAPHS:
                found[form] = found[form]._replace(wraps=True)
    return found


def lines(page: str) -> tuple[list[str], list[float]]:
    """(text, weight) of the page's lines."""
    texts: list[str] = []
    weights: list[int] = []
    inside: list[bool] = []
    line: list[str] = []
    weight = 0
    stack = [_Element("")]
    #: Places in the stack by name, and of its blocks, so that an end tag finds its element at once.
    places: defaultdict[str, list[int]] = defaultdict(list)
    block_places: list[int] = []
    skipping = links = mains = 0
    main_here = prose_here = False

    def end_line() -> None:
        nonlocal weight, line, main_here, prose_here
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            texts.append(text)
            # A heading, a paragraph or a line of the article that is a link goes with the text beside it.
            weights.append(max(weight, int(main_here or prose_here)))
            inside.append(main_here)
        line, weight, main_here, prose_here = [], 0, False, False

    def gap() -> None:
        # Parts of the page stand apart: blocks of lines do not reach over from one to the next.
        end_line()
        if texts and texts[-1]:
            texts.extend([""] * WINDOW)
            weights.extend([0] * WINDOW)
            inside.extend([False] * WINDOW)

    def add(text: str) -> None:
        nonlocal weight, main_here, prose_here
        if skipping:
            return
        line.append(text)
        visible = len(text) - text.count(" ")
        if not text.isspace() and visible:
            main_here = main_here or mains > 0
            prose_here = prose_here or stack[-1].prose
            if stack[-1].prose or not links:
                stack[-1].holder.column = True
            if not links:
                weight += visible

    def pop() -> None:
        nonlocal skipping, mains, links
        element = stack.pop()
        places[element.name].pop()
        if element.name in _BLOCKS:
            block_places.pop()
        skipping -= element.boilerplate
        mains -= element.main
        links -= element.name == "a"
        if element.main and not mains:
            gap()

    at = 0
    for tag in tags(page):
        if tag.start > at:
            add(page[at : tag.start])
        at = tag.end
        name, attributes = tag.name, tag.attributes
        if not name:
            # Where a comment or script was, words do not grow together.
            add(" ")
            continue
        if name in _BLOCKS:
            end_line()
        if tag.closing:
            depth = places[name][-1] if places[name] else 0
            # An end tag closes what was left open inside, but not a part of the page it lies in.
            if not depth or (name not in _BLOCKS and block_places and block_places[-1] > depth):
                continue
            while len(stack) > depth:
                pop()
        elif name not in _VOID and not attributes.rstrip().endswith("/"):
            if name == "p" and stack[-1].name == "p":
                pop()
            boiler = not tag.wraps and _boilerplate(name, attributes, mains > 0, mains > 0 or stack[-1].in_column())
            is_main = name in _MAIN and not boiler
            if (is_main and not mains) or (boiler and not skipping and not mains and not stack[-1].holder.column):
                gap()
            places[name].append(len(stack))
            if name in _BLOCKS:
                block_places.append(len(stack))
            stack.append(_Element(name, stack[-1], boiler, is_main))
            skipping += boiler
            mains += is_main
            links += name == "a"
    add(page[at:])
    end_line()
    if any(i and w for i, w in zip(inside, weights)):
        return texts, [w * (INSIDE if i else OUTSIDE) for i, w in zip(inside, weights)]
    return texts, [float(w) for w in weights]


def chosen(weights: list[float]) -> list[tuple[int, int]]:
    """(first, end) of the runs of lines from a surge to its dive."""
    if not any(weights):
        return []
    # Block i sums lines i - WINDOW + 1 .. i, with lines outside the page empty.
    w = np.r_[np.zeros(WINDOW - 1), np.array(weights), np.zeros(WINDOW - 1)]
    blocks = sum(w[i : len(w) - WINDOW + 1 + i] for i in range(WINDOW))
    surge = min(SURGE, blocks.max())
    edges = np.flatnonzero(np.diff(np.r_[0, (blocks > 0).astype(np.int8), 0]))
    runs = zip(edges[::2].tolist(), edges[1::2].tolist())
    return [(begin, dive - WINDOW + 1) for begin, dive in runs if blocks[begin:dive].max() >= surge]


def main_text(page: str | None) -> str:
    """The page's main text; empty for a null page or one without any."""
    texts, weights = lines(page or "")
    return " ".join(t for begin, end in chosen(weights) for t in texts[begin:end] if t)


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined
    by one space. A null or empty page has an empty text. Rows stay one to one; other columns are not
    read.
    """
    plain = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, sizes], ["page_id", "url", "text", "n_chars"])

    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
