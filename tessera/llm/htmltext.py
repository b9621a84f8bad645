"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags; only a list of open containers is kept,
no tree. Each block has its number of words and its link density, those of the blocks
before and after, and what the page says about its place (article or main element,
surroundings, heading, end mark, legal wording outside articles). A
decision tree that was grown on a small labelled table (``labelled_table``, pages of a
few site templates with every kind of surroundings) tells article blocks from others.
A page is one row's work: no shuffle, and memory is that of one page.

Surroundings are elements like menus, footers and comments by tag, role, class or id.
Menus, footers and the like that have their end tag, what is hidden, and comments count
as such in any case. A class name, a form or an element without its end tag is no more
than a hint: it does not count if most words of the page and its main heading are in it,
nor inside an article or main element that is no small one of the page.

Defined results: null and empty html give an empty text; broken markup is read as far
as it goes (unclosed tags, comments and quotes end with the page), in time that grows
with its length; script, style and similar elements are never text; white space of a
block becomes single spaces; very long pages are read whole; repeated rows are rows of
their own; an empty table gives an empty result; an input column ``text`` is replaced,
names that begin with ``_tessera`` are reserved.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "button", "math", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "picture", "source", "nobr"}
BREAK = {"br", "img", "wbr", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
AROUND = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "fieldset"}
#: Marks of an element: a hint, surroundings if it has its end tag, surroundings in any case; and an article or main element.
HINT, CLOSED, SURE, ARTICLE = 1, 2, 3, 4
ROLES = {"navigation", "contentinfo", "complementary", "banner", "search", "form", "dialog", "alert", "menu", "menubar"}
WORDS = set(
    "nav navbar navigation menu menubar sidebar side footer foot masthead banner cookie cookies consent gdpr notice notices alert popup modal overlay ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login search breadcrumb breadcrumbs pagination pager widget widgets toolbar skip copyright legal outbrain taboola teaser".split()
)
COMMENT = {"comment", "comments", "reply", "replies"}
LEGAL = re.compile(r"^\s*(?:©|\(c\)|copyright\b|advertisement\b|sponsored\b|all rights reserved)|\ball rights reserved\b|\bcookies?\b.*\b(?:accept|agree|consent)\b", re.I)
END = re.compile(r"[.!?…:;。！？][\"'”’)\]]*$")

FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "inside", "around", "heading", "item", "ended", "legal", "page_has_article", "around_before", "around_after")


def _marked(tag: str, attrs: str, inside: bool) -> int:
    """How an element is marked as surroundings of the article; 0 if it is not."""
    mark = 0
    if tag in AROUND or (tag == "header" and not inside):
        mark = HINT if tag in ("form", "header", "fieldset") else CLOSED
    if not attrs or tag in ("html", "body", "main") or tag in INLINE:
        return mark
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in PART.findall(one)}
                if parts & {"has", "with", "no", "without"}:
                    continue
                if parts & COMMENT:
                    return SURE
                if tag != "article" and (parts & WORDS or ("header" in parts and not inside and not parts & {"article", "post", "entry", "story", "page"})):
                    mark = max(mark, HINT)
        elif name == "role":
            if value.lower() in ROLES:
                mark = max(mark, CLOSED)
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return SURE
        elif name == "hidden" or value.lower() == "true":
            return SURE
    return mark


class _Places:
    """The marked elements of a page, each with the one around it, and what lies in them."""

    def __init__(self):
        self.up, self.mark, self.inside = [-1], [0], [False]
        self.closed, self.words, self.main_heading = [True], [0], [False]

    def add(self, up: int, mark: int, inside: bool) -> int:
        for x, v in ((self.up, up), (self.mark, mark), (self.inside, inside), (self.closed, False), (self.words, 0), (self.main_heading, False)):
            x.append(v)
        return len(self.up) - 1

    def surrounding(self) -> list[bool]:
        """Whether what lies in each element counts as surroundings."""
        for i in range(len(self.up) - 1, 0, -1):
            self.words[self.up[i]] += self.words[i]
            self.main_heading[self.up[i]] |= self.main_heading[i]
        large = max((w for w, m in zip(self.words, self.mark, strict=True) if m == ARTICLE), default=0) / 2
        large = max(large, self.words[0] / 5)
        sure, hint = [False], [False]
        for up, mark, closed, words, heading in list(zip(self.up, self.mark, self.closed, self.words, self.main_heading, strict=True))[1:]:
            sure.append(sure[up] or mark == SURE or (mark == CLOSED and closed))
            if mark == ARTICLE:
                hint.append(hint[up] and words < large)
            else:
                most = 2 * words > self.words[0] and (heading or not self.main_heading[0])
                hint.append(hint[up] or (mark != SURE and not most))
        return [a or b for a, b in zip(sure, hint, strict=True)]


def blocks(page: str | None) -> list[tuple]:
    """(text, words, link words, inside article, surroundings, heading, list item or cell) of the blocks in page order."""
    if not page:
        return []
    out: list[tuple] = []
    buf: list[str] = []
    linked: list[str] = []
    places = _Places()
    open_: list[tuple[str, int]] = []  # tag and place of the containers that are open
    count: dict[str, int] = {}  # how many of each tag are open
    links = place = 0
    kind = ""

    def flush():
        if buf:
            text = SPACE.sub(" ", _html.unescape("".join(buf))).strip()
            if text:
                n = text.count(" ") + 1
                k = len(_html.unescape(" ".join(linked)).split()) if linked else 0
                places.words[place] += n
                if kind == "h1":
                    places.main_heading[place] = True
                out.append((text, n, min(k, n), place, kind[:1] == "h" and kind[1:].isdigit(), kind in ("li", "td", "th", "dt", "dd", "option")))
            buf.clear()
            linked.clear()

    def pop(ended: bool) -> int:
        tag, own = open_.pop()
        count[tag] -= 1
        outer = open_[-1][1] if open_ else 0
        if ended and own != outer:
            places.closed[own] = True
        return outer

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                buf.append(s)
                if links:
                    linked.append(s)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                flush()
                if count.get(tag):
                    while open_[-1][0] != tag:
                        pop(False)
                    place = pop(True)
                kind = open_[-1][0] if open_ else ""
                links = 0
            continue
        if tag in RAW:
            if tag == "title":
                flush()
            if not m[3].rstrip().endswith("/"):
                close = _raw_end(tag).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "a":
            links = 1
        elif tag in BREAK:
            buf.append(" ")
        elif tag not in INLINE:
            flush()
            links = 0
            if tag in VOID:
                continue
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and open_ and open_[-1][0] == tag:
                place = pop(True)
            article = tag in ("article", "main")
            inside = places.inside[place] or article
            mark = _marked(tag, m[3], inside) or (ARTICLE if article else 0)
            if mark:
                place = places.add(place, mark, inside)
            open_.append((tag, place))
            count[tag] = count.get(tag, 0) + 1
            kind = tag
    flush()
    around = places.surrounding()
    return [(text, n, k, places.inside[at], around[at], heading, item) for text, n, k, at, heading, item in out]


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def features(bs: list[tuple]) -> np.ndarray:
    n = len(bs)
    x = np.zeros((n, len(FEATURES)), dtype=np.float32)
    if not n:
        return x
    w = np.array([b[1] for b in bs], dtype=np.float32)
    link = np.array([b[2] for b in bs], dtype=np.float32) / w
    around = np.array([b[4] for b in bs], dtype=np.float32)
    x[:, 0], x[:, 1] = w, link
    x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = w[:-1], link[:-1], w[1:], link[1:]
    x[:, 6] = [b[3] for b in bs]
    x[:, 7] = around
    x[:, 8] = [b[5] for b in bs]
    x[:, 9] = [b[6] for b in bs]
    x[:, 10] = [END.search(b[0]) is not None for b in bs]
    x[:, 11] = [not b[3] and LEGAL.search(b[0]) is not None for b in bs]
    x[:, 12] = x[:, 6].max()
    x[1:, 13], x[:-1, 14] = around[:-1], around[1:]
    return x


def labelled_table(pages: int = 240, seed: int = 1) -> list[tuple[str, set[str]]]:
    """(html, article blocks) of invented pages of three site templates: with article elements, with class names, with neither."""
    rng = random.Random(seed)
    serial = iter(range(10**9))

    def words(a, b, dot=True):
        k = rng.randint(a, b)
        s = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(k))
        return s.capitalize() + f" q{next(serial)}" + ("." if dot else "")

    def menu(k):
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 2, False)}</a></li>' for i in range(k)) + "</ul>"

    out = []
    for i in range(pages):
        style, good = i % 3, set()

        def text(a, b, dot=True, good=good):
            s = words(a, b, dot)
            good.add(s)
            return s

        body = f"<h1>{text(3, 9, rng.random() < 0.3)}</h1>"
        for _ in range(rng.randint(3, 14)):
            r = rng.random()
            if r < 0.62:
                body += f"<p>{text(4, 110)}</p>"
            elif r < 0.72:
                body += f"<p>{text(1, 3)}</p>"
            elif r < 0.80:
                body += f"<h2>{text(2, 7, False)}</h2><p>{text(10, 60)}</p>"
            elif r < 0.86:
                body += "<ul>" + "".join(f"<li>{text(4, 16, rng.random() < 0.5)}</li>" for _ in range(3)) + "</ul>" + f"<p>{text(8, 60)}</p>"
            elif r < 0.93:
                s, t, u = words(6, 30, False), words(1, 3, False), words(6, 30)
                good.add(f"{s} {t} {u}")
                body += f'<p>{s} <a href="/x">{t}</a> {u}</p>'
            else:
                body += f"<blockquote>{text(6, 50)}</blockquote><p>{text(5, 40)}</p>"
        named = style < 2
        box = lambda tag, name, s: f"<{tag}>{s}</{tag}>" if style == 0 and tag != "div" else (f'<div class="{name}">{s}</div>' if named else f"<div>{s}</div>")
        ad = box("div", rng.choice(["ad", "advert-box", "sponsored"]), f"{'' if named else 'Advertisement '}{words(4, 18)}")
        related = box("aside", rng.choice(["sidebar", "related-links"]), f"<h3>{words(1, 2, False)}</h3>{menu(4)}" + (f"<p>{words(6, 30)}</p>" if named else ""))
        notice = box("div", rng.choice(["cookie-notice", "notice"]), f"We use cookies. Please accept. {words(3, 20)}")
        form = f"<form><p>{words(2, 10)}</p><input name=q><label>{words(1, 2, False)}</label></form>"
        comments = box("div", "comments", "".join(f"<p>{words(3, 50)}</p>" for _ in range(3))) if named else ""
        foot = box("footer", "footer", f"&copy; {words(2, 14)}")
        head = box("header", "masthead", words(2, 8, rng.random() < 0.5) if named else f'<a href="/">{words(1, 3, False)}</a>')
        inner = body + (comments if rng.random() < 0.5 else "")
        art = f"<article>{inner}</article>" if style == 0 else (f'<div class="content">{inner}</div>' if style == 1 else f"<div>{inner}</div>")
        parts = [head, box("nav", "menu", menu(rng.randint(4, 9)))] + [x for x in (notice, ad, form) if rng.random() < 0.5] + [art]
        parts += [x for x in (ad, related, form, comments) if rng.random() < 0.5 and x not in inner] + [foot]
        if i % 8 == 3:  # a form, a misleading class name or a menu without its end around everything
            parts = [rng.choice(['<form id="aspnetForm">', '<div class="layout-social">', '<div class="news-alert-story">', f"<nav>{menu(3)}"]), *parts]
        if i % 8 == 5:  # cards of other articles beside this one
            parts.insert(-1, box("aside", "related", "".join(f"<article><h3>{words(2, 5, False)}</h3></article>" for _ in range(3))) if named else "")
        out.append((f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(parts)}</body></html>", good))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, leaf: int = 4) -> list[tuple]:
    """Decision tree by Gini impurity: nodes (feature, threshold, left, right, share of ones); feature -1 in leaves."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, d: int) -> int:
        at, ones = len(nodes), y[rows].sum()
        share = float(ones / len(rows))
        nodes.append((-1, 0.0, -1, -1, share))
        if d == 0 or ones in (0, len(rows)) or len(rows) < 2 * leaf:
            return at
        best = (len(rows) * share * (1 - share) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            o = np.argsort(x[rows, f], kind="stable")
            v, c = x[rows[o], f], np.cumsum(y[rows[o]])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= leaf) & (k <= len(rows) - leaf)]
            if not len(k):
                continue
            a, b = c[k - 1], ones - c[k - 1]
            m = len(rows) - k
            cost = a * (1 - a / k) + b * (1 - b / m)
            i = int(np.argmin(cost))
            if cost[i] < best[0]:
                best = (float(cost[i]), f, float((v[k[i]] + v[k[i] - 1]) / 2))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            left = build(rows[low], d - 1)
            nodes[at] = (best[1], best[2], left, build(rows[~low], d - 1), share)
        return at

    build(np.arange(len(y)), depth)
    return nodes


def trained(table: list[tuple[str, set[str]]] | None = None) -> list[np.ndarray]:
    """The tree as arrays: feature, threshold, left, right, share."""
    xs, ys = [], []
    for page, good in table or labelled_table():
        bs = blocks(page)
        xs.append(features(bs))
        ys.append(np.array([b[0] in good for b in bs], dtype=np.float64))
    nodes = grow(np.concatenate(xs), np.concatenate(ys))
    return [np.array([n[i] for n in nodes]) for i in range(5)]


def predict(tree: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, share = tree
    at = np.zeros(len(x), dtype=np.int64)
    while len(x):
        f = feature[at]
        go = f >= 0
        if not go.any():
            break
        low = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
        at = np.where(go, np.where(low, left[at], right[at]), at)
    return share[at] >= 0.5


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns and ``text`` of each page."""
    small_batches(pages.sparkSession)
    tree = trained()
    keep = [c for c in keep if c != "text"]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            each = [blocks(h.as_py()) for h in b.column("_tessera_html")]
            x = [features(bs) for bs in each]
            good = predict(tree, np.concatenate(x)) if x else np.zeros(0, bool)
            texts, at = [], 0
            for bs in each:
                texts.append("\n".join(t[0] for t, g in zip(bs, good[at : at + len(bs)], strict=True) if g))
                at += len(bs)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return pages.select(*keep, F.col(html_col).alias("_tessera_html")).mapInArrow(run, schema)


def op6_html(spark, sf_dir):
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
