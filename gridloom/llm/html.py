"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks: the text between tags that break a line. Of each block the tree sees its
number of words and its link density, those of the block before and after it, and what encloses it (an article, a
menu or footer, a form, an element whose class or id tells an advert, notice, sidebar or comments). A class or id
that only has such a word among others ("share-price") leaves the decision to words and link densities, as do pages
without a main element. The tree is grown here, from the small labelled table below, by
the usual splits on Gini impurity.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never have text of the page.
SILENT = frozenset("script style noscript template head title iframe object svg select option datalist textarea button canvas audio video".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder mfenced semantics mstyle mspace".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside menu dialog".split())
FORM = frozenset("form fieldset label input".split())
MAIN = frozenset("article main".split())
#: What class, id and role say of an element: whole words of them.
ADVERT = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted".split())
AROUND = frozenset("nav navbar navigation menu sidebar aside footer header masthead breadcrumb breadcrumbs toolbar pagination pager share sharing social related recommended widget newsletter subscribe signup login search copyright tags".split())
NOTICE = frozenset("cookie cookies consent gdpr notice alert popup modal overlay paywall disclaimer privacy".split())
COMMENT = frozenset("comment comments reply replies respond disqus discussion reader reviews".split())
OWN = frozenset("article post entry story".split())
BODY = frozenset("body content text main".split())
#: Words beside which the ones above still say all of an element ("ad-slot", "site-footer", "comment-list").
GLUE = OWN | BODY | frozenset("posts articles stories area bar block blocks bottom box button buttons col column container fixed global group holder icon icons inline inner item items left link links list main media outer page panel primary right row secondary section site slot sticky title top unit wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())

SAYING = ADVERT | AROUND | NOTICE | COMMENT | GLUE

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
#: One column each: words, link density, of this block, the one before and the one after; then what encloses it.
COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_boiler", "in_form", "in_advert", "in_around", "in_notice", "in_comment", "in_header", "in_doubt", "hidden", "heading", "has_main")


#: Marks of inline elements whose text is none of the block's.
SILENCING = frozenset(("in_advert", "in_comment", "hidden"))


class Block:
    __slots__ = ("text", "words", "linked", "marks")

    def __init__(self, text: str, words: int, linked: int, marks: frozenset[str]):
        self.text, self.words, self.linked, self.marks = text, words, linked, marks


@lru_cache(maxsize=4096)
def _marks(name: str, attributes: str) -> frozenset[str]:
    """What an element says of the text in it."""
    out = set()
    if name in MAIN:
        out.add("in_main")
    elif name in BOILER:
        out.add("in_boiler")
    elif name in FORM:
        out.add("in_form")
    elif name == "header":
        out.add("in_header")
    elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        out.add("heading")
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        low = value.lower()
        if key == "hidden" or key == "aria-hidden" and low == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            out.add("hidden")
        elif key == "role":
            out |= {"in_main"} if low in ("main", "article") else {"in_around"} if low in ROLES else set()
        elif key in ("class", "id") and name not in ("html", "body"):
            for one in value.split():
                tokens = {t.rstrip("0123456789") for t in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", one).lower())}
                if tokens & OWN:
                    tokens.discard("header")  # an article's own header
                    if tokens & BODY or tokens <= OWN:
                        out.add("in_main")
                for mark, words in (("in_advert", ADVERT), ("in_around", AROUND), ("in_notice", NOTICE), ("in_comment", COMMENT)):
                    if tokens & words:
                        # Comments read like an article, so words and densities can't tell them: any word of theirs decides.
                        out.add(mark if mark == "in_comment" or tokens - {""} <= SAYING else "in_doubt")
    return frozenset(out)


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order. White space counts as one space; character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool]] = []  # name, marks of the blocks in it, whether its text counts
    open_names: Counter = Counter()  # of the stack: an end tag that matches nothing costs no walk
    marks: frozenset[str] = frozenset()
    quiet = 0  # open inline adverts and other inline parts that are no text of their block
    text: list[str] = []
    linked: list[str] = []
    link = 0
    missing: set[str] = set()  # silent elements that have no end tag further on

    def flush() -> None:
        if text:
            whole = SPACE.sub(" ", "".join(text)).strip()
            if whole:
                out.append(Block(whole, whole.count(" ") + 1, len(SPACE.sub(" ", " ".join(linked)).split()), marks))
            text.clear()
            linked.clear()

    def add(raw: str) -> None:
        if raw and not quiet:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if link:
                linked.append(plain)

    def close(at: int) -> None:
        """Ends the element at this place of the stack and all that are open in it."""
        nonlocal link, marks, quiet
        for n, _, counts in stack[at:]:
            open_names[n] -= 1
            link -= n == "a"
            quiet -= not counts
        del stack[at:]
        marks = stack[-1][1] if stack else frozenset()

    def last(name: str) -> int:
        at = len(stack) - 1
        while stack[at][0] != name:
            at -= 1
        return at

    page, at = page or "", 0
    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if m[1]:
            if name not in INLINE:
                flush()
            if open_names[name]:
                close(last(name))
            continue
        if name in SILENT and not m[3].endswith("/"):
            if name not in INLINE:
                flush()
            end = None if name in missing else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not end:
                missing.add(name)
            if name == "head":
                body = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                at = (body.end() if body and body[0][1] == "/" else body.start()) if body else at
            elif end:
                at = end.end()
            elif name in ("script", "style", "textarea", "title"):
                at = len(page)
            continue
        if name not in INLINE:
            flush()
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and name in (n for n, _, _ in stack[-3:]):
            close(last(name))  # these end the one before them
        own = _marks(name, m[3])
        counts = True
        if name in INLINE:
            # An inline element doesn't mark the block around it; its own text is left out where it is an advert, hidden or the like.
            counts = not own & SILENCING
        else:
            marks = marks | own if own else marks
        stack.append((name, marks, counts))
        open_names[name] += 1
        quiet += not counts
        link += name == "a"
    add(page[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """(blocks, COLUMNS)"""
    n = len(found)
    out = np.zeros((n, len(COLUMNS)))
    if not n:
        return out
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked / b.words for b in found])
    out[:, 0], out[:, 1] = words, links
    out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
    main = any("in_main" in b.marks for b in found)
    for k, b in enumerate(found):
        for mark in b.marks:
            out[k, COLUMNS.index(mark)] = 1
    out[:, COLUMNS.index("has_main")] = main
    return out


#: The labelled table, built from what holds for whole families of blocks.
#: Marks of blocks that are no main text wherever they stand.
APART = ["in_advert", "in_around", "in_notice", "in_comment", "in_form", "in_boiler", "hidden"]
#: Marks that change nothing in a main element.
NEUTRAL = ["", "heading", "in_header"]
#: Words and link density of a block, and of the one before or after it; (0, 0) where there is none. Every family of
#: marks meets all of them, so that no size stands for a mark.
SIZES = [(1, 0.0), (2, 1.0), (3, 0.6), (4, 0.0), (6, 1.0), (8, 0.0), (12, 0.0), (17, 0.1), (23, 0.0), (30, 0.6), (60, 0.1), (200, 0.0)]
SIDES = [(0, 0.0), (1, 0.0), (2, 1.0), (3, 0.6), (5, 0.0), (12, 0.0), (12, 1.0), (40, 0.1), (150, 0.0)]


def reads_like_text(words: int, links: float, before: tuple[int, float], after: tuple[int, float], heading: bool) -> bool:
    """The label of a block that no mark tells: long text, or short text between blocks of text, but neither links nor what a page begins and ends with."""
    if links >= 0.34:
        return False
    if heading:
        return after[0] > 0 and after[1] < 0.34
    if words >= 20:
        return True
    return min(before[0], after[0]) > 0 and max(before[1], after[1]) < 0.34


def labelled() -> list[tuple]:
    """(words, links, words before, links before, words after, links after, marks, label: 1 for main text)"""
    rows = []
    for (words, links), before, after, extra in product(SIZES, SIDES, SIDES, NEUTRAL):
        size = (words, links, *before, *after)
        text = reads_like_text(words, links, before, after, "heading" in extra)
        rows.append((*size, f"has_main in_main {extra}", 1))
        rows.append((*size, f"has_main in_main in_doubt {extra}", int(text or links < 0.34 and words >= 6)))
        rows.append((*size, f"has_main {extra}", 0))
        rows += [(*size, f"has_main in_main {extra} {mark}", 0) for mark in APART]
        rows += [(*size, f"{extra} {mark}", 0) for mark in APART]
        rows += [(*size, f"{doubt} {extra}", int(text and "in_header" not in extra)) for doubt in ("", "in_doubt")]
    return rows


class Tree:
    """A binary decision tree: a split on one column, or a leaf's label."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 24):
        self.label, self.column = int(2 * y.sum() >= len(y)), -1
        if depth and 0 < y.sum() < len(y):
            best = (self._impurity(y) * len(y) - 1e-9, -1, 0.0)
            for c in range(x.shape[1]):
                values = np.unique(x[:, c])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, c] <= cut
                    got = self._impurity(y[low]) * low.sum() + self._impurity(y[~low]) * (~low).sum()
                    if got < best[0]:
                        best = (got, c, float(cut))
            if best[1] >= 0:
                self.column, self.cut = best[1:]
                low = x[:, self.column] <= self.cut
                self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return float(2 * p * (1 - p))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.label)
        out, low = np.zeros(len(x), int), x[:, self.column] <= self.cut
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


@lru_cache(maxsize=1)
def tree() -> Tree:
    rows = labelled()
    x = np.array([[*row[:6], *(float(c in row[6].split()) for c in COLUMNS[6:])] for row in rows])
    return Tree(x, np.array([row[7] for row in rows]))


def main_texts(pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    keep = iter(tree().predict(np.concatenate([np.zeros((0, len(COLUMNS))), *map(features, found)])).tolist())
    return ["\n".join([b.text for b in page if next(keep)]) for page in found]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            texts = main_texts(some.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page. Null and empty pages, and pages without main text, have an empty text; repeated rows give repeated rows; an empty table gives none. Only page_id, url and html are read; rows never leave their partition."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
