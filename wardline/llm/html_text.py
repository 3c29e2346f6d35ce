"""Main text of pages: flat text blocks judged by a decision tree.

Each page is cut into text blocks (``blocks``). A block's features are its words and link density, those of the
blocks before and after it, and where the markup puts it. A decision tree (CART, Gini) fitted to
a small labelled table judges all blocks of a batch at once: the tree lies in arrays and is
walked by numpy. Kept blocks are joined in page order. A page is judged alone, so no rows are
exchanged.

The labelled table is made by rule (``labelled_pages``): page layouts with the article's blocks
marked, from fixed draws. It is a few thousand blocks, the same for every input.

Cases: a null or empty page, and one without an article, gives empty text. Markup may be broken
or cut off anywhere: an open comment, tag or script ends the text. Repeated rows are extracted
each; other columns are not read."""
from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks
from .common import slices

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "place", "heading", "item", "section", "phrase", "ended")
#: First character of a labelled article block; it occurs in no page that is judged.
MARK = "␁"
_EMPTY = Block("", 0, 0, 0, False, False, 0, False, False)


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row per block of all pages; blocks of other pages are no neighbours."""
    rows = [b for p in pages for b in p]
    if not rows:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in rows], float)
    links = np.array([b.linked for b in rows], float) / words
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    edge = np.concatenate([[True], page[1:] != page[:-1], [True]])

    def beside(x: np.ndarray, step: int) -> np.ndarray:
        moved = np.roll(x, step)
        moved[edge[:-1] if step > 0 else edge[1:]] = 0
        return moved

    place = np.array([b.place for b in rows], float)
    best = np.zeros(len(pages))
    np.maximum.at(best, page, np.where(links < 0.5, place, 0))
    best = best[page]
    # -2 marked as beside the article, -1 outside the page's best marked part, 0 nothing is marked, 1 in it
    place = np.where(place < 0, -2, np.where(best == 0, 0, np.where(place >= best, 1, -1)))
    own = np.array([(b.heading, b.item, b.section, b.phrase, b.ended) for b in rows], float)
    return np.column_stack([words, links, beside(words, 1), beside(links, 1), beside(words, -1), beside(links, -1), place, own])


class Tree(NamedTuple):
    feature: np.ndarray  # -1 at leaves
    cut: np.ndarray  # rows with at most this go left
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # of kept blocks among a node's

    def keeps(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.share[node] > 0.5
            at = node[inner]
            goes = x[inner, f[inner]] <= self.cut[at]
            node[inner] = np.where(goes, self.left[at], self.right[at])


def best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, int, float]:
    """(Gini impurity after it, feature, cut) of the best split with ``least`` rows on both sides; the
    impurity is infinite if there is none. Of equals the first feature and lowest cut."""
    best = (np.inf, -1, 0.0)
    n, total = len(y), y.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])[:-1]
        left = np.arange(1, n)
        able = (v[1:] > v[:-1]) & (left >= least) & (n - left >= least)
        if able.any():
            a, b = ones / left, (total - ones) / (n - left)
            impurity = np.where(able, 2 * (left * a * (1 - a) + (n - left) * b * (1 - b)) / n, np.inf)
            k = int(np.argmin(impurity))
            if impurity[k] < best[0] - 1e-12:
                best = (float(impurity[k]), f, float((v[k] + v[k + 1]) / 2))
    return best


def fit(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2) -> Tree:
    """A classification tree; nodes are numbered as they are made, parents first."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        share = y[rows].mean()
        nodes.append([-1, 0.0, 0, 0, share])
        me, now = len(nodes) - 1, 2 * share * (1 - share)
        if level < depth and now > 0:
            after, f, cut = best_split(x[rows], y[rows], least)
            if after < now - 1e-9:
                goes = x[rows, f] <= cut
                nodes[me][:2] = f, cut
                nodes[me][2] = grow(rows[goes], level + 1)
                nodes[me][3] = grow(rows[~goes], level + 1)
        return me

    grow(np.arange(len(y)), 0)
    feature, cut, left, right, share = zip(*nodes)
    return Tree(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(share))


# What the parts of labelled pages say and how layouts mark them.
_NOTICES = ("We use cookies to improve your visit. Accept", "Wir verwenden Cookies auf dieser Seite", "Ce site utilise des cookies",
            "Este sitio utiliza cookies", "Please enable JavaScript to view this page", "Subscribe to our newsletter today")
_ENDS = ("© 2024 Example Inc. All rights reserved", "Copyright 2023 Muster GmbH", "Tous droits réservés", "Privacy policy · Terms of use", "Impressum Datenschutz")
_FORMS = ("Sign up for updates", "Log in to your account", "Your name", "Leave a reply", "Search")
_TITLES = ("Comments", "3 comments", "Kommentare", "Commentaires", "Comentarios")
_LINKS = ("Related articles", "You may also like", "Read next", "Mehr zum Thema")
#: (opening, closing) of each part; an empty one is a plain ``div``.
_LAYOUTS = (
    {"article": ("<article>", "</article>"), "menu": ("<nav>", "</nav>"), "head": ("<header>", "</header>"), "end": ("<footer>", "</footer>"),
     "side": ("<aside>", "</aside>"), "notice": ('<div class="cookie-notice">', "</div>"), "advert": ('<div class="ad">', "</div>"),
     "form": ("<form>", "</form>"), "comments": ('<section class="comments">', "</section>")},
    {"article": ('<div class="post-content">', "</div>"), "menu": ('<div id="menu">', "</div>"), "head": ('<div id="header">', "</div>"),
     "end": ('<div class="page-footer">', "</div>"), "side": ('<div class="sidebar">', "</div>"), "notice": ('<div id="notice">', "</div>"),
     "advert": ('<div class="advert">', "</div>"), "form": ('<div class="newsletter">', "</div>"), "comments": ('<div id="comments">', "</div>")},
    {"article": ("<main>", "</main>"), "menu": ('<div role="navigation">', "</div>"), "head": ("<header>", "</header>"), "end": ("<footer>", "</footer>"),
     "side": ("", ""), "notice": ("", ""), "advert": ("", ""), "form": ("<form>", "</form>"), "comments": ("", "")},
    {"article": ("<article>", "</article>")},
    {}, {},
)


def labelled_pages(n: int = 900, seed: int = 7) -> list[str]:
    """Pages whose article blocks start with ``MARK``: layouts by turns, lengths by fixed draws."""
    rng = random.Random(seed)

    def words(lo: int, hi: int, end: str = ".") -> str:
        size = round(lo * (hi / lo) ** rng.random())
        return " ".join("w" * rng.randint(1, 9) for _ in range(size)) + rng.choice(["", end, end])

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="#">{words(1, 5, "")}</a></{tag}>' for _ in range(k))

    def article(bare: bool) -> str:
        out, own = [f"<h1>{MARK}{words(2, 14)}</h1>"], rng.randint(2, 9)
        for _ in range(own):
            kind = rng.random()
            low = 12 if bare else 1
            text = words(low, 140)
            if kind < 0.08:
                out.append(f"<h2>{MARK}{words(1, 8, '')}</h2><p>{MARK}{words(20, 80)}</p>")
            elif kind < 0.16:
                out.append("<ul>" + "".join(f"<li>{MARK}{words(4 if bare else 1, 25)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.3:
                out.append(f'<p>{MARK}{text} <a href="#">{words(1, 4, "")}</a> {words(3, 40)}</p>')
            elif kind < 0.35:
                out.append(f"<blockquote>{MARK}{text}</blockquote>")
            elif kind < 0.4 and not bare:
                out.append(f'<p>{MARK}<a href="#">{words(2, 12)}</a></p><p>{MARK}{words(5, 60)}</p>')
            elif kind < 0.45 and not bare:
                out.append(f"<p>{MARK}{words(5, 60)} {rng.choice((*_NOTICES, *_ENDS, *_FORMS))} {words(5, 60)}</p>")
            else:
                out.append(f"<p>{MARK}{text}</p>")
        return "".join(out)

    def page(layout: dict[str, tuple[str, str]]) -> str:
        bare = "article" not in layout

        def odds(p: float) -> bool:
            return rng.random() < p

        def part(name: str, inner: str) -> str:
            opening, closing = layout.get(name, ("", ""))
            if not opening:
                return f"<div>{inner}</div>"
            if name != "article" and odds(0.7):  # a marked part may say anything
                inner += "".join(f"<{t}>{words(1, 120)}</{t}>" for t in rng.choices(["p", "p", "li", "h3", "div"], k=rng.randint(1, 6)))
            return opening + inner + closing

        def marked(name: str) -> bool:
            return bool(layout.get(name, ("", ""))[0])

        def advert() -> str:
            return part("advert", f"<p>{words(1, 30)}</p>" if marked("advert") else f'<p><a href="#">{words(3, 15)}</a></p>')

        out = []
        if odds(0.4):
            out.append(part("notice", f"<p>{rng.choice(_NOTICES)}</p>"))
        out.append(part("head", f"<div>{words(1, 4, '')}</div>" + (f"<p>{words(2, 7, '')}</p>" if odds(0.4) else "")))
        out.append(part("menu", f"<ul>{links(rng.randint(3, 8))}</ul>"))
        if odds(0.4):
            out.append(advert())
        body = article(bare)
        if marked("advert") and odds(0.3):
            body = body.replace("</p>", "</p>" + advert(), 1)
        if odds(0.3):
            body += f"<ul>{links(rng.randint(2, 5))}</ul>"
        if not bare and odds(0.15):
            body += f"<h3>{rng.choice(_TITLES)}</h3>" + "".join(f"<div>{words(1, 90)}</div>" for _ in range(rng.randint(1, 4)))
        out.append(part("article", body))
        if odds(0.5):
            out.append(part("side", f"<h3>{rng.choice(_LINKS)}</h3><ul>{links(rng.randint(2, 6))}</ul>"
                            + (f"<p>{words(4, 40)}</p>" if marked("side") else "")))
        if odds(0.5):
            out.append(part("comments", f"<h3>{rng.choice(_TITLES)}</h3>" + "".join(
                f"<div><b>{words(1, 2, '')}</b><p>{words(2, 70)}</p></div>" for _ in range(rng.randint(1, 4)))))
        if odds(0.4):
            out.append(part("form", f"<p>{rng.choice(_FORMS)}</p>" + (f"<p>{words(3, 12)}</p>" if marked("form") else "")))
        if odds(0.3):
            out.append(advert())
        out.append(part("end", f"<p>{rng.choice(_ENDS)}</p>" + (links(rng.randint(1, 4), "span") if odds(0.5) else "")))
        return "<html><body>" + "".join(out) + "</body></html>"

    return [page(_LAYOUTS[k % len(_LAYOUTS)]) for k in range(n)]


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: the article's) of the blocks of labelled pages."""
    found = [blocks(p) for p in pages]
    return features(found), np.array([b.text.startswith(MARK) for p in found for b in p], float)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text and its code points."""
    tree = tree or fit(*labelled(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            found = [blocks(h or "") for h in b.column("html").to_pylist()]
            kept = iter(tree.keeps(features(found)).tolist())
            text = ["\n".join([x.text for x in p if next(kept)]) for p in found]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string").withColumn(
        "n_chars", F.char_length("text").cast("long"))
