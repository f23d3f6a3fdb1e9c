"""HTML extraction: flat text blocks, classified by a decision tree on their own and their neighbours' features.

A page is cut at block-level tags into flat text blocks.  Each has its word
count, its link density (share of its words inside links), the same of the
blocks before and after it, and what the open elements around it say of
themselves.  A decision tree, trained here on the small labelled pages below,
tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?=\s|=|$|/)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")

#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template iframe head title textarea select option".split())
#: Of these, what is not closed goes on to the page's end.
RAW = frozenset("script style textarea title".split())
#: Elements that begin and end a text block; all others are part of the text around them.
BREAKS = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose opening marks everything inside them.
HOLDERS = frozenset("nav header footer aside form article main section div ul ol dl table menu dialog figure figcaption blockquote details fieldset button".split())
#: Elements that end where the next of their kind begins; a paragraph ends at any block.
OPTIONAL_END = frozenset("li dt dd tr td th".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

#: Words in class, id or role attributes, by what they say.
NOTICE_WORDS = frozenset("cookie cookies consent notice notices banner alert popup modal newsletter subscribe gdpr dialog overlay toast".split())
ADVERT_WORDS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion promoted adsense banner".split())
FRAME_WORDS = frozenset("nav navbar navigation menu header footer sidebar breadcrumb breadcrumbs topbar masthead copyright share social related pagination pager tags toolbar widget login search complementary contentinfo".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus respond discussion".split())
MAIN_WORDS = frozenset("article content main post entry story body".split())

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "frame", "notice", "advert", "comment", "form", "main", "page_main", "heading", "item"]


class Block:
    __slots__ = ("features", "flags", "linked", "text", "words")

    def __init__(self, text: str, words: int, linked: int, flags: dict[str, int]) -> None:
        self.text, self.words, self.linked, self.flags = text, words, linked, flags
        self.features: list[float] = []


def _holder_flags(tag: str, attributes: str) -> dict[str, int]:
    flags = {}
    if tag in ("nav", "header", "footer", "aside", "menu"):
        flags["frame"] = 1
    elif tag in ("form", "fieldset", "button"):
        flags["form"] = 1
    elif tag in ("article", "main"):
        flags["main"] = 1
    elif tag == "dialog":
        flags["notice"] = 1
    if attributes:
        said = {w.lower() for m in _HINT.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")}
        if said:
            for name, words in (("frame", FRAME_WORDS), ("notice", NOTICE_WORDS), ("advert", ADVERT_WORDS), ("comment", COMMENT_WORDS)):
                if said & words:
                    flags[name] = 1
            if not flags and said & MAIN_WORDS:
                flags["main"] = 1
        if _HIDDEN.search(attributes):
            flags["notice"] = 1
    return flags


class Scanner:
    """Tags and text between them, in one pass: what is once not found ahead is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.at = page, 0
        self.missing: set[str] = set()

    def _find(self, what: str, start: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, start)
        if found < 0:
            self.missing.add(what)
        return found

    def _past(self, what: str, start: int) -> int:
        found = self._find(what, start)
        return len(self.page) if found < 0 else found + len(what)

    def _tag_end(self, start: int) -> int:
        """Where a tag ends; a quote that is never closed does not hide the tag's end."""
        at = start
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            close = self._find(m[0], m.end())
            at = m.end() if close < 0 else close + 1
        return len(self.page)

    def tokens(self) -> Iterator[tuple[str, bool, str]]:
        """("", False, text), or the name of a tag in lower case, whether it closes, and its attributes."""
        page, size = self.page, len(self.page)
        text = 0
        while self.at < size:
            start = self._find("<", self.at)
            if start < 0:
                break
            self.at = start + 1
            ahead = page[start + 1 : start + 2]
            if ahead in ("!", "?"):
                yield "", False, page[text:start]
                if page.startswith("<!--", start):
                    self.at = self._past("-->", start + 4)
                elif page.startswith("<![CDATA[", start):
                    self.at = self._past("]]>", start + 9)
                    yield "", False, html.escape(page[start + 9 : self.at].removesuffix("]]>"))
                else:
                    self.at = self._past(">", start)
                text = self.at
            elif m := _NAME.match(page, start):
                yield "", False, page[text:start]
                end = self._tag_end(m.end())
                self.at = text = end + 1
                closing = m[0][1] == "/"
                yield m[0][1 + closing :].lower(), closing, page[m.end() : end]
                text = self.at = max(self.at, text)
        yield "", False, page[text:]

    def skip(self, tag: str) -> None:
        """Go behind the element's end tag."""
        if tag in self.missing:
            return
        end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(self.page, self.at)
        if end:
            self.at = end.end()
        elif tag in RAW:
            self.at = len(self.page)
        else:
            self.missing.add(tag)


def text_blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order, with features."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, dict[str, int]]] = []
    opened: Counter[str] = Counter()
    flags: dict[str, int] = {}
    link = heading = item = False

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, text.count(" ") + 1, len("".join(linked).split()), flags | ({"heading": 1} if heading else {}) | ({"item": 1} if item else {})))
            parts.clear()
            linked.clear()

    def push(tag: str, more: dict[str, int]) -> None:
        nonlocal flags
        stack.append((tag, flags))
        opened[tag] += 1
        flags = flags | more

    def pop() -> str:
        nonlocal flags
        tag, flags = stack.pop()
        opened[tag] -= 1
        return tag

    scanner = Scanner(page)
    for tag, closing, said in scanner.tokens():
        if not tag:
            if said:
                parts.append(said)
                if link:
                    linked.append(said + " ")
            continue
        if tag in SKIPPED:
            if tag in ("head", "title", "body"):
                close()
            if not closing and not said.endswith("/"):
                scanner.skip(tag)
            continue
        if tag not in BREAKS:
            if tag == "a":
                link = not closing
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        close()
        link = False
        heading = tag in HEADINGS and not closing
        item = tag == "li" and not closing or (item and tag == "p")
        if not closing and stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in OPTIONAL_END):
            pop()
        if tag in HOLDERS:
            if not closing:
                push(tag, _holder_flags(tag, said))
            elif opened[tag]:
                while pop() != tag:
                    pass
        elif tag not in VOID and said and not closing:
            own = _holder_flags("p", said)
            if own.keys() - {"main"}:
                push(tag, own)
        elif closing and stack and stack[-1][0] == tag:
            pop()
    close()
    page_main = float(any("main" in b.flags for b in blocks))
    for k, b in enumerate(blocks):
        near = []
        for other in (blocks[k - 1] if k else None, blocks[k + 1] if k + 1 < len(blocks) else None):
            near += [float(other.words), min(1.0, other.linked / other.words)] if other else [0.0, 0.0]
        b.features = [float(b.words), min(1.0, b.linked / b.words), *near, *(page_main if name == "page_main" else float(b.flags.get(name, 0)) for name in FEATURES[6:])]
    return blocks


class DecisionTree:
    """Binary classification tree by Gini impurity; a leaf is the share of its rows that are main text."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, depth: int = 6, least: int = 2) -> None:
        self.root = self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int):
        share = float(y.mean())
        if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
            return share
        best = None
        for f in range(x.shape[1]):
            o = np.argsort(x[:, f], kind="stable")
            v, cum, n = x[o, f], np.cumsum(y[o]), len(y)
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= least) & (n - k >= least)]
            if not len(k):
                continue
            left, right = cum[k - 1] / k, (cum[-1] - cum[k - 1]) / (n - k)
            impurity = k * left * (1 - left) + (n - k) * right * (1 - right)
            i = int(np.argmin(impurity))
            if best is None or impurity[i] < best[0] - 1e-12:
                best = impurity[i], f, float(v[k[i] - 1] + v[k[i]]) / 2
        if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
            return share
        _, f, cut = best
        low = x[:, f] <= cut
        return f, cut, self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least)

    def score(self, row: list[float]) -> float:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node


_LONG = "The ship left the harbour before the wind rose, and nobody on the shore could say when it would come back from the north."
_MORE = "In the evening the council met again, heard what the captain had sent, and put the matter off until the spring."
#: Labelled pages: html, and for each of its blocks in order 1 for main text, 0 for the rest.
LABELLED: list[tuple[str, str]] = [
    (f"<nav><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul></nav><article><h1>Ship leaves</h1><p>{_LONG}</p><p>{_MORE}</p><p>So it is.</p></article><footer>All rights reserved. {_MORE}</footer>", "0011110"),
    (f"<header>The Daily Paper</header><div class=ad>{_LONG}</div><main><h2>Council</h2><p>{_MORE}</p><ul><li>First point of the plan</li><li>Second one</li></ul><p>{_LONG}</p></main><aside><p>{_MORE}</p><a href=x>More</a></aside>", "0011111" + "00"),
    (f"<div class=cookie-notice>We use cookies. {_LONG}</div><article><p>{_LONG} <a href=x>The wind</a> stayed.</p><p>Yes.</p><blockquote>{_MORE}</blockquote></article><section id=comments><h3>Comments</h3><p>{_LONG}</p><p>Nice!</p></section>", "0111000"),
    (f"<ul class=menu><li><a href=x>One</a><li><a href=x>Two</a><li><a href=x>Three</a></ul><h1>{_LONG}</h1><p>{_MORE}</p><p>{_LONG}</p><p>Short end.</p><form><p>Your name and your address, please, so that we can write to you</p><button>Send</button></form>", "00011110" + "0"),
    (f"<div id=header><p>Paper of the town and the harbour since the year of the flood</p></div><div class=content><h2>Wind</h2><p>{_LONG}</p><p>{_MORE}</p></div><div class=sidebar><p>{_LONG}</p><p>{_MORE}</p></div><div id=footer><p>{_MORE}</p></div>", "0111000"),
    (f"<article><div class=advert><p>{_MORE}</p></div><p>{_LONG}</p><p><a href=x>Read the whole story here on the next page</a></p><p>It rained.</p><div class=comments><p>{_MORE}</p></div></article>", "01110"),
    (f"<p><a href=x>Home</a> <a href=x>Sport</a> <a href=x>Weather</a></p><p>{_LONG} {_MORE}</p><p>{_MORE}</p><p><a href=x>Privacy</a> <a href=x>Contact</a></p>", "0110"),
    (f"<div class=newsletter><p>{_LONG}</p></div><article><h1>On the wind</h1><p>Rain.</p><p>{_MORE} {_LONG}</p><table><tr><td>Monday</td><td>12 boats</td></tr></table></article><aside class=ad><p>{_MORE}</p></aside><nav><p>{_LONG}</p></nav><footer><p>{_LONG}</p></footer>", "011111000"),
    (f"<article><header><h1>Title of it</h1></header><p>{_LONG}</p><footer><p>Posted by a hand</p></footer></article><div role=alert><p>{_MORE}</p></div><div class=related><p>{_LONG}</p></div><section class=reply><p>{_LONG}</p></section><form class=search><p>{_MORE}</p></form>", "0100000"),
    (f"<article><p>{_LONG}</p><p>End.</p><form><p>{_LONG}</p><p>Mail</p></form></article><div class=popup><p>{_MORE}</p><p>Close</p></div><div class=sponsored><p>{_LONG}</p><p>Buy</p></div><div class=discussion><p>{_LONG}</p><p>First!</p></div>", "1100000000"),
]


#: What stands around a text that is not the page's own, by its opening and closing.
_AROUND = [("<div class=ad>", "</div>"), ("<aside>", "</aside>"), ("<header>", "</header>"), ("<footer>", "</footer>"), ("<nav>", "</nav>"), ("<form>", "</form>"), ("<div class=cookie>", "</div>"), ("<div id=sidebar>", "</div>"), ("<section class=comments>", "</section>"), ("<div class=banner role=alert>", "</div>"), ("<div class=sponsored>", "</div>"), ("<div class=share>", "</div>")]
_TEXTS = ["Now", "A line of about eight words in all", _MORE, f"{_LONG} {_MORE}", f"{_MORE} {_LONG} {_MORE}"]


def _plain_pages() -> Iterator[tuple[str, str]]:
    """Pages whose elements say nothing of themselves: words and links of a block and its neighbours decide."""
    menu = "<{0}><a href=x>Home</a></{0}><{0}><a href=x>Our town</a></{0}><{0}><a href=x>All of the news</a></{0}>"
    for tag in ("p", "div", "td"):
        block = lambda t, tag=tag: f"<{tag}>{t}</{tag}>"
        links = menu.format(tag)
        wrap = (lambda x: f"<table><tr>{x}</tr></table>") if tag == "td" else (lambda x: x)
        for k in range(len(_TEXTS)):
            texts = [_TEXTS[(k + j) % len(_TEXTS)] for j in range(5)]
            inner = "".join(map(block, texts))
            yield wrap(links + inner + links), "000" + "11111" + "000"
            yield wrap(links + block("Ships") + links + inner), "000" + "0" + "000" + "11111"
            yield wrap(inner + block("Pages") + links), "11111" + "0" + "000"
            yield wrap(inner + block(f"{_LONG} <a href=x>{texts[k]}</a>") + inner), "1" * 11
            yield wrap(links + block(f"<a href=x>{_MORE}</a> {_MORE}") + inner), "000" + "1" + "11111"


def labelled_pages() -> list[tuple[str, str]]:
    """LABELLED, plain pages, and each surrounding of _AROUND before, inside and after main text of several lengths."""
    pages = LABELLED + list(_plain_pages())
    for k in range(len(_TEXTS)):
        texts = [_TEXTS[(k + j) % len(_TEXTS)] for j in range(4)]
        inner = "".join(f"<p>{t}</p>" for t in texts)
        # a run of links inside the article is a menu; one linked paragraph or list item between others is text
        for n in (2, 3, 5):
            links = "".join(f"<li><a href=x>{_TEXTS[(k + 2 * j) % len(_TEXTS)]}</a></li>" for j in range(n))
            pages.append((f"<article>{inner}<ul>{links}</ul>{inner}</article>", "1111" + "0" * n + "1111"))
            pages.append((f"<main><ul>{links}</ul>{inner}</main>", "0" * n + "1111"))
            pages.append((f"<article>{inner}<div>{links}</div></article>", "1111" + "0" * n))
        pages.append((f"<article>{inner}<p><a href=x>{texts[0]}</a></p>{inner}<ul><li>{texts[1]}</li><li><a href=x>{texts[2]}</a></li><li>{texts[3]}</li></ul></article>", "1111" + "1" + "1111" + "111"))
        pages.append((f"<article><p><a href=x>{texts[0]}</a></p>{inner}<p><a href=x>{texts[3]}</a></p></article>", "1" + "1111" + "1"))
        pages.append((f"<p>{texts[0]}</p><article>{inner}</article><div>{texts[1]}</div><p>{texts[2]}</p>", "0" + "1111" + "00"))
    for i, (begin, end) in enumerate(_AROUND):
        for k, own in enumerate(_TEXTS):
            texts = [_TEXTS[(i + k + j) % len(_TEXTS)] for j in range(4)]
            noise = f"{begin}<p>{own}</p>{end}"
            inner = "".join(f"<p>{t}</p>" for t in texts)
            pages.append((f"<nav><a href=x>Up</a></nav>{noise}<article><h1>{texts[1]}</h1>{inner}</article>{noise}", "00111110"))
            pages.append((f"<article>{inner}{noise}<p>{texts[2]}</p></article><footer><p>{texts[0]}</p></footer>", "11110" + "10"))
            pages.append((f"{noise}<main><ul><li>{texts[0]}</li><li>{texts[3]}</li></ul><h2>{texts[1]}</h2></main><p><a href=x>{own}</a></p>", "01110"))
            pages.append((f"{noise}{inner}<h2>{texts[1]}</h2>{inner}{noise}", "0" + "111111111" + "0"))
    return pages


@lru_cache(maxsize=1)
def block_tree() -> DecisionTree:
    """The tree trained on the labelled pages; they are fixed, so every process gets the same tree."""
    rows, labels = [], []
    for page, marks in labelled_pages():
        blocks = text_blocks(page)
        if len(blocks) != len(marks):
            raise ValueError(f"{len(blocks)} blocks and {len(marks)} labels: {[b.text[:20] for b in blocks]}")
        rows += [b.features for b in blocks]
        labels += [int(c) for c in marks]
    return DecisionTree(np.array(rows), np.array(labels, float), depth=12)


def main_text(page: str | None) -> str:
    """The main text: blocks that the tree takes for it, in page order, joined by line feeds."""
    tree = block_tree()
    return "\n".join(b.text for b in text_blocks(page or "") if tree.score(b.features) >= 0.5)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row.

    A null or empty page has an empty text.  Null ids and repeated rows keep a
    row each; other columns are ignored.  Pages of any length are read whole,
    in time in proportion to it, however malformed; an empty table stays empty.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
