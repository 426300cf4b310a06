"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags.  What the page itself declares to be a menu, header, footer, sidebar, form,
notice, advert or comment, by its element or by the names that its elements bear, is cut out like scripts.  Every other block has its word
count and link density, those of the blocks before and after it, and those of the blocks that share its parent; a decision
tree, trained on the labelled pages of `labelled_pages`, keeps it or not by these measures alone.  Kept blocks are joined in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

# Names of HTML elements and words that sites use in class and id.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style title textarea template svg iframe select button object xmp noembed noframes".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html li main menu nav noscript ol section span table td tr ul p".split())
#: Elements whose blocks count as standing together; those of the others stand with their parent's.
PARENTS = frozenset("article aside body details dialog div fieldset footer form header html main nav noscript section td".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adbox alert advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus foot footer form gdpr head header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted promotion recommended related replies respond reviews share sharing sidebar sidebars signup skip social sponsor sponsored subscribe tags toc toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post postbody prose story text".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: A form that holds so much of a page's plain words is the page's frame and declares nothing.
FRAME = 0.75


@dataclass
class Element:
    """An open element: its number, tag, and whether it declares boilerplate, or the main text."""

    number: int
    tag: str
    boiler: bool
    main: bool


@dataclass
class Block:
    """A flat block with the numbers of the elements it stands in (outermost first) and of those that are parents."""

    text: str
    words: int
    linked: int
    heading: int
    label: int
    within: list[Element]
    parents: list[int]


def _hints(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role names boilerplate, or the main text."""
    words: set[str] = set()
    for m in _HINT.finditer(attributes):
        words.update(_WORDS.findall(_HUMP.sub(" ", m[1] or m[2] or m[3] or "").lower()))
    return bool(words & BOILER_WORDS), bool(words & MAIN_WORDS)


def flat_blocks(page: str) -> list[Block]:
    """The page's text blocks in order; raw elements, comments and markup are left out, references decoded."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[Element] = []
    links, heading, label, at, number = 0, 0, 0, 0, 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, in_link in parts if in_link)
                out.append(Block(text, n := len(text.split()), min(linked, n), heading, label, list(stack), [e.number for e in stack if e.tag in PARENTS]))
            parts.clear()

    while at < len(page):
        m = _MARKUP.search(page, at)
        if not m:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        tag = _TAG.match(page, at) or _LOOSE.match(page, at)
        if not tag:  # a declaration, an end without a name, or a tag that the page's end cuts off
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        at, name, closing = tag.end(), tag[2].lower(), bool(tag[1])
        if name in RAW_TAGS and not closing:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = len(page) if not end and name in ("script", "style", "title", "textarea") else end.end() if end else at
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name in BLOCK_TAGS:
            close()
            heading = int(not closing and name[0] == "h" and name[1:].isdigit())
            label = int("data-label" in tag[3])
            links = 0 if name not in ("br", "hr") else links
        if name in CONTAINERS:
            if closing:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == name), -1)
                if k >= 0:
                    del stack[k:]
            elif not tag[3].endswith("/") or name not in VOID_TAGS:
                bad, good = _hints(tag[3]) if tag[3] else (False, False)
                if name == "p":
                    k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag != "span"), -1)
                    if k >= 0 and stack[k].tag == "p":
                        del stack[k:]
                structural = name not in ("html", "body")
                header = name == "header" and not any(e.main for e in stack)
                number += 1
                stack.append(Element(number, name, structural and (bad or header or name in BOILER_TAGS), structural and not bad and (good or name in MAIN_TAGS)))
    close()
    return out


def undeclared(found: list[Block]) -> list[Block]:
    """The blocks that the page doesn't declare to be boilerplate: the nearest mark counts."""
    plain = sum(b.words - b.linked for b in found)
    held: dict[int, int] = {}
    for b in found:
        for e in b.within:
            if e.tag == "form":
                held[e.number] = held.get(e.number, 0) + b.words - b.linked

    def declared(b: Block) -> bool:
        marks = [e for e in b.within if e.main or e.boiler and held.get(e.number, 0) < FRAME * plain] if any(e.boiler for e in b.within) else []
        return bool(marks) and not marks[-1].main

    return [b for b in found if not declared(b)]


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "parent_share", "parent_density", "parent_words", "alone")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block; a parent that holds one block alone is passed over for its own parent."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    alone: dict[int, int] = {}
    for b in found:
        if b.parents:
            alone[b.parents[-1]] = alone.get(b.parents[-1], 0) + 1
    own = []
    for i, b in enumerate(found):
        k = len(b.parents) - 1
        while k > 0 and alone[b.parents[-1]] == 1 and alone.get(b.parents[k], 0) <= 1:
            k, x[i, 10] = k - 1, 1
        own.append(b.parents[k] if k >= 0 else 0)
    parent = np.unique(np.array(own), return_inverse=True)[1]
    words, linked = np.array([b.words for b in found], float), np.array([b.linked for b in found], float)
    all_words, all_linked = np.bincount(parent, words)[parent], np.bincount(parent, linked)[parent]
    x[:, 0] = words
    x[:, 1] = linked / words
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    x[:, 6] = [b.heading for b in found]
    x[:, 7] = (all_words - all_linked) / max(1.0, words.sum() - linked.sum())
    x[:, 8] = all_linked / all_words
    x[:, 9] = all_words
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 8) -> tuple:
    """A binary decision tree by Gini impurity: (feature, threshold, left, right), or a leaf's share of 1."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return (float(y.mean()),)
    best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones, n = x[order, f], np.cumsum(y[order]), np.arange(1, len(y) + 1)
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(y) - cut - 1 >= least)]
        if len(cut):
            a, na = ones[cut], n[cut]
            b, nb = ones[-1] - a, len(y) - na
            loss = 2 * a * (na - a) / na + 2 * b * (nb - b) / nb
            k = int(np.argmin(loss))
            if loss[k] < best[0]:
                best = (loss[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
    if best[1] is None:
        return (float(y.mean()),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def leaves(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out, left = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[left], out[~left] = leaves(tree[2], x[left]), leaves(tree[3], x[~left])
    return out


def train(pages: list[str]) -> tuple:
    """A tree from pages whose main blocks carry a data-label attribute."""
    got = [undeclared(flat_blocks(p)) for p in pages]
    return grow(np.concatenate([features(g) for g in got]), np.array([b.label for g in got for b in g], float))


def main_text(tree: tuple, page: str | None) -> str:
    found = undeclared(flat_blocks(page or ""))
    keep = leaves(tree, features(found)) >= 0.5 if found else []
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row, with the tree trained on `pages` (the labelled pages by default).

    Null and empty pages give an empty text, and so do pages without a block that is kept; rows that repeat are each
    extracted; other columns play no part.
    """
    from .labelled_pages import PAGES

    blocks.session_limits(df.sparkSession)
    tree = train(PAGES if pages is None else pages)
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(tree, p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
