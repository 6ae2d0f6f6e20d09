"""Main text of web pages by gradient-boosted trees over DOM nodes.

A lenient parser makes a tree of a page's elements. Every element with text gets
features: its tag and attribute tokens and its ancestors', depth, the size and density of
its subtree, its links, and its siblings. Boosted trees, trained here on made pages, give
each node a probability of belonging to the article. Decoding then chooses the most
likely consistent set: a dropped node drops all below it, so no descendant contradicts an
ancestor. What is kept becomes blocks, in page order. Never judged but always dropped: comments, the
head, scripts, styles, noscript, templates, frames, form controls' own text (textarea,
select, option, datalist, button), svg, and what stands in canvas, audio and video for
browsers without them. The text of math and the fallback of object are judged like others.

Defined results: a null or empty html, and a page without kept text, have the text "" and
n_chars 0; repeated rows are extracted row by row; unclosed and stray tags, truncated
pages and broken references do not fail; a head without its end tag ends where something
begins that cannot stand in it, and an svg without one before the next element of HTML or
an outer end tag; null ids and urls keep their rows.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidy
from .html_pages import MARK, labelled_pages

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe head title textarea select option button svg canvas audio video datalist".split())
#: What can stand in a head; anything else that opens, and any text, ends an open one.
HEAD = frozenset("base head html link meta noscript script style template title".split())
#: An opening tag closes the nearest open one of these, up to one of the second set.
CLOSES = {
    "p": ({"p"}, BLOCKS - {"p"}),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
SVG_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style)(?=[\s/>])[^>]*+(?<!/)>(?:(?!</?svg[\s/>]).)*?</(?P=raw)(?=[\s/>])[^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)",
    re.S | re.I,
)
#: Elements of HTML that end an svg in which they open, but not in one of the second set.
LEAVES_SVG = BLOCKS | frozenset("b big br code em embed head i img nobr ruby s small span strong strike sub sup tt u var".split())
HOLDS_HTML = frozenset("foreignobject desc title".split())
ATTRS = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Beginnings of attribute tokens that are features; at most 62.
STEMS = "nav menu breadcrumb head mast brand foot copyright legal colophon side widget rail relat recommend ad ads advert adsby sponsor promo banner cookie consent gdpr privacy noti alert popup modal overlay newsletter subscri paywall message dialog search login signup contact form comment repl respon disc disq user share social article post entry story content body text main top topbar bar bottom".split()
EXACT = {"ad", "ads", "head", "foot", "nav", "side", "text", "body", "form", "post", "main", "top", "bar"}
TAGS = "p h1 h2 h3 h4 li ul ol div section article main nav header footer aside form table td a span b blockquote pre figure figcaption label dialog body ins dl".split()
TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_masks: dict[str, int] = {}


def stem_mask(attrs: str) -> int:
    """Which stems an element's attribute tokens begin with, as bits."""
    mask = _masks.get(attrs)
    if mask is None:
        mask = 0
        for m in ATTRS.finditer(attrs):
            for name in SPLIT_NAME.findall(m[2] or m[3] or m[4] or ""):
                name = name.lower()
                for i, stem in enumerate(STEMS):
                    if name == stem or (stem not in EXACT and name.startswith(stem)) or (stem in EXACT and len(stem) > 3 and name.startswith(stem)) or (stem == "head" and name.startswith("header")) or (stem == "foot" and name.startswith("footer")) or (stem == "nav" and name.startswith("nav")) or (stem == "side" and name.startswith("sidebar")):
                        mask |= 1 << i
        if len(_masks) < 50_000:
            _masks[attrs] = mask
    return mask


def svg_end(source: str, at: int, outer: set[str]) -> int:
    """Where the svg whose content begins at a place ends: after its end tag, or before the
    first tag that shows that it was not closed (an element of HTML opens, an outer one ends)."""
    inner = ["svg"]
    for m in SVG_TOKEN.finditer(source, at):
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in inner:
                while inner.pop() != tag:
                    pass
                if not inner:
                    return m.end()
            elif tag in outer or tag in ("body", "html"):
                return m.start()
        elif tag in LEAVES_SVG and HOLDS_HTML.isdisjoint(inner):
            return m.start()
        elif tag not in VOID and not m["attrs"].endswith("/"):
            inner.append(tag)
    return len(source)


class Page:
    """A parsed page: element arrays in page order, and texts with their element and block."""

    __slots__ = ("parent", "tag", "stems", "above", "above_tags", "depth", "end", "texts")

    def __init__(self, source: str):
        self.parent, self.tag, self.stems, self.above, self.above_tags, self.depth, self.end = [-1], ["html"], [0], [0], [0], [0], [0]
        self.texts: list[tuple[int, str, int]] = []
        stack, at, block = [0], 0, 0
        hidden = 0  # depth of the stack at which unseen content began
        tokens = TOKEN.finditer(source)
        while (m := next(tokens, None)) is not None:
            tag = (m["tag"] or m["tag2"] or m["raw"] or "").lower()
            closing = m["end"] or m["end2"]
            # An open head has nothing but the root above it and nothing open in it.
            if self.tag[stack[-1]] == "head" and (source[at : m.start()].strip() or (tag in ("body", "html", "br") if closing else tag and tag not in HEAD)):
                self.end[stack.pop()] = len(self.tag)
                hidden = 0
            if m.start() > at and not hidden:
                self.text(stack[-1], source[at : m.start()], block)
            at = m.end()
            if not tag or m["raw"]:
                continue
            if closing:
                if tag in BLOCKS:
                    block += 1
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name == tag:
                        for i in stack[k:]:
                            self.end[i] = len(self.tag)
                        del stack[k:]
                        if hidden and len(stack) < hidden:
                            hidden = 0
                        break
                    if name in BLOCKS and tag not in BLOCKS:
                        break  # an inline end tag does not close a block
                continue
            if tag == "svg":
                if not (m["attrs"] or m["attrs2"] or "").endswith("/"):
                    at = svg_end(source, at, {self.tag[i] for i in stack[1:]})
                    tokens = TOKEN.finditer(source, at)
                continue
            if tag == "br":
                if not hidden:
                    self.text(stack[-1], " ", block)
                continue
            if tag in BLOCKS:
                block += 1
            if tag in VOID or tag == "html" or (tag == "head" and len(self.tag) > 1):
                continue  # a head after other elements is a stray tag
            if tag in CLOSES or tag in BLOCKS:
                own, until = CLOSES.get(tag, CLOSES["p"])
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in own:
                        for i in stack[k:]:
                            self.end[i] = len(self.tag)
                        del stack[k:]
                        if hidden and len(stack) < hidden:
                            hidden = 0
                        break
                    if name in until:
                        break
            up, i = stack[-1], len(self.tag)
            self.parent.append(up)
            self.tag.append(tag)
            self.stems.append(stem_mask(m["attrs"] or m["attrs2"] or "") if tag != "body" else 0)
            self.above.append(self.above[up] | self.stems[up])
            self.above_tags.append(self.above_tags[up] | TAG_BIT.get(self.tag[up], 0))
            self.depth.append(self.depth[up] + 1)
            self.end.append(0)
            if (m["attrs"] or m["attrs2"] or "").endswith("/") and tag not in BLOCKS:
                self.end[i] = len(self.tag)
                continue
            stack.append(i)
            if tag in UNSEEN and not hidden:
                hidden = len(stack)
        if self.tag[stack[-1]] == "head" and source[at:].strip():
            self.end[stack.pop()] = len(self.tag)
            hidden = 0
        if at < len(source) and not hidden:
            self.text(stack[-1], source[at:], block)
        for i in stack:
            self.end[i] = len(self.tag)

    def text(self, node: int, raw: str, block: int) -> None:
        self.texts.append((node, html.unescape(raw) if "&" in raw else raw, block))


def bits(masks: np.ndarray, n: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(n, dtype=np.int64)) & 1).astype(np.float32)


def features(pages: list[Page]):
    """A function that gives the rows of nodes a..b of all pages, and whether each node has
    text below and is judged. Only a few numbers are held for each node; the wide rows are
    made for as many nodes as are asked for."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    join = lambda name, kind=np.int64: np.array([x for p in pages for x in getattr(p, name)], kind)
    n = int(sizes.sum())
    parent, end, depth = join("parent"), join("end") + base, join("depth", np.float32)
    parent = np.where(parent < 0, np.arange(n), parent + base)
    tags = np.array([TAG_BIT.get(t, 0) for p in pages for t in p.tag], np.int64)
    links = np.array([t == "a" for p in pages for t in p.tag])
    blocks = np.array([t in BLOCKS for p in pages for t in p.tag], np.float64)
    own = np.zeros((n, 5))  # characters, words, marks of sentences, linked characters, texts
    start = np.cumsum(sizes) - sizes
    at, rows = [], []
    for s, p in zip(start.tolist(), pages):
        for node, text, _ in p.texts:
            k = len(text.strip())
            if k:
                linked = p.tag[node] == "a" or bool(p.above_tags[node] & TAG_BIT["a"])
                at.append(s + node)
                rows.append((k, text.count(" ") + 1, text.count(".") + text.count(",") + text.count("?"), k if linked else 0, 1))
    if at:
        np.add.at(own, np.array(at), np.array(rows, float))
    idx = np.arange(n)
    sums = np.concatenate([np.zeros((1, 7)), np.cumsum(np.column_stack([own, links, blocks]), axis=0)])
    sub = sums[end] - sums[idx]
    page_first, page_end = np.repeat(start, sizes), np.repeat(start + sizes, sizes)
    whole = sums[page_end] - sums[page_first]
    chars = sub[:, 0]
    inner = end - idx
    order = np.lexsort((idx, parent))
    is_root = idx == page_first
    prev, nxt = np.full(n, -1), np.full(n, -1)
    o = order[~is_root[order]]
    same = parent[o[1:]] == parent[o[:-1]] if len(o) > 1 else np.zeros(0, bool)
    prev[o[1:][same]], nxt[o[:-1][same]] = o[:-1][same], o[1:][same]
    kids = np.bincount(parent[~is_root], minlength=n).astype(float)
    p_chars = np.bincount(parent[~is_root], weights=(tags[~is_root] & TAG_BIT["p"] > 0) * chars[~is_root], minlength=n)
    log = lambda x: np.log1p(np.maximum(x, 0))
    size_at = lambda j: np.where(j >= 0, log(chars[j]), -1)
    before = (sums[idx] - sums[page_first])[:, 0]
    rank = np.zeros(n)
    if len(o):
        new = np.concatenate([[True], ~same])
        first = np.flatnonzero(new)
        rank[o] = np.arange(len(o)) - np.repeat(first, np.diff(np.concatenate([first, [len(o)]])))
    dense = [
        depth, log(chars), log(own[:, 0]), log(sub[:, 1]), sub[:, 3] / np.maximum(chars, 1), chars / inner, log(inner), sub[:, 2] / np.maximum(sub[:, 1], 1),
        chars / np.maximum(sub[:, 4], 1), chars / np.maximum(whole[:, 0], 1), before / np.maximum(whole[:, 0], 1), log(kids), log(kids[parent]), rank, size_at(prev), size_at(nxt),
        log(chars[parent]), chars / np.maximum(chars[parent], 1), sub[parent, 3] / np.maximum(chars[parent], 1), log(p_chars), log(p_chars[parent]), log(sub[:, 6]), log(sub[:, 5]), log(whole[:, 0]),
    ]
    near = lambda mask, j: np.where(j >= 0, mask[j], 0)
    stems, above = join("stems"), join("above")
    below = np.zeros(n)  # article-like tokens below a container
    below = (lambda c: c[end] - c[idx] - (stems & GOOD != 0))(np.concatenate([[0], np.cumsum(stems & GOOD != 0)]))
    above_tags = join("above_tags")
    dense = [c.astype(np.float32) for c in (*dense, log(below))]
    before_tags = near(tags, prev)

    def rows(a: int, b: int) -> np.ndarray:
        s, u, t, v = stems[a:b], above[a:b], tags[a:b], above_tags[a:b]
        roles = [np.bitwise_count(m).astype(np.float32) for m in (s & GOOD, s & ~GOOD, u & GOOD, u & ~GOOD, v & ASIDE, t & ASIDE)]
        return np.concatenate([np.column_stack([*(c[a:b] for c in dense), *roles]), bits(t, len(TAGS)), bits(v, len(TAGS)), bits(s, len(STEMS)), bits(u, len(STEMS)), bits(before_tags[a:b], 7)], axis=1)

    # Inline elements that say nothing of their role go with what they stand in.
    return rows, (chars > 0) & ((blocks > 0) | (stems != 0))


#: Nodes whose wide rows are held at a time (some 900 bytes each).
NODES_AT_ONCE = 50_000
GOOD = sum(1 << STEMS.index(s) for s in ("article", "post", "entry", "story", "content", "text", "main"))
ASIDE = sum(TAG_BIT[t] for t in ("nav", "header", "footer", "aside", "form", "dialog", "ins"))


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 24, penalty: float = 2.0):
        n, m = x.shape
        self.depth = depth
        flags = np.array([set(np.unique(x[:, j])) <= {0.0, 1.0} for j in range(m)])
        own, order = np.flatnonzero(flags), np.concatenate([np.flatnonzero(~flags), np.flatnonzero(flags)])
        wide = np.flatnonzero(~flags)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in wide]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in zip(wide, cuts)]).astype(np.int64)
        shift = binned + np.arange(len(wide)) * bins
        at_row, at_flag = np.nonzero(x[:, own])  # few flags of a node are set
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        logit = np.full(n, self.bias)
        nodes = (1 << depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf, np.float32), np.zeros((trees, nodes + 1))
        rows = np.arange(n)
        for t in range(trees):
            p = 1 / (1 + np.exp(-logit))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            gw, hw = np.repeat(g, len(wide)), np.repeat(h, len(wide))
            at = np.zeros(n, np.int64)  # node in its level
            for level in range(depth):
                width = 1 << level
                flat = (at[:, None] * (len(wide) * bins) + shift).ravel()
                # Sums left of each cut; for a flag all rows of the node without those that have it.
                gl = np.bincount(flat, gw, width * len(wide) * bins).reshape(width, len(wide), bins).cumsum(axis=2)
                hl = np.bincount(flat, hw, width * len(wide) * bins).reshape(width, len(wide), bins).cumsum(axis=2)
                gt, ht = np.bincount(at, g, width)[:, None], np.bincount(at, h, width)[:, None]
                place = at[at_row] * len(own) + at_flag
                gl = np.concatenate([gl.reshape(width, -1), gt - np.bincount(place, g[at_row], width * len(own)).reshape(width, -1)], axis=1)
                hl = np.concatenate([hl.reshape(width, -1), ht - np.bincount(place, h[at_row], width * len(own)).reshape(width, -1)], axis=1)
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (np.maximum(ht - hl, 0) + penalty) - gt**2 / (ht + penalty)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                best, first = gain.argmax(axis=1), width - 1
                for k, j in enumerate(best.tolist()):
                    if gain[k, j] <= 1e-6:
                        continue
                    f = j // bins if j < len(wide) * bins else len(wide) + j - len(wide) * bins
                    if f >= len(wide) or j % bins < len(cuts[f]):
                        self.feature[t, first + k] = order[f]
                        self.cut[t, first + k] = 0.5 if f >= len(wide) else cuts[f][j % bins]
                at = 2 * at + (x[rows, self.feature[t, first + at]] > self.cut[t, first + at])
            sums, weights = np.bincount(at, g, nodes + 1), np.bincount(at, h, nodes + 1)
            self.leaf[t] = rate * sums / (weights + penalty)
            logit += self.leaf[t][at]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = at + (1 << level) - 1
                at = 2 * at + (x[rows, f[k]] > c[k])
            out += leaf[at]
        return out


TRAINING_PAGES, TRAINING_SEED = 1200, 3
_models: dict[tuple[int, int], Boosted] = {}


def trained(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Boosted:
    """The model, trained once a process on made pages."""
    if (pages, seed) not in _models:
        parsed = [Page(s) for s in labelled_pages(pages, seed)]
        rows, has = features(parsed)
        x = rows(0, len(has))
        truth = []
        for p in parsed:
            good, bad = np.zeros(len(p.tag) + 1), np.zeros(len(p.tag) + 1)
            for node, text, _ in p.texts:
                (bad if MARK in text else good)[node + 1] += len(text.strip())
            good, bad = good.cumsum(), bad.cumsum()
            end = np.array(p.end)
            truth.append(good[end] - good[:-1] > bad[end] - bad[:-1])
        y = np.concatenate(truth).astype(float)
        _models[pages, seed] = Boosted(x[has], y[has])
    return _models[pages, seed]


def decode(page: Page, logits: list[float], has: list[bool]) -> list[bool]:
    """The consistent choice of kept nodes with the largest likelihood."""
    n = len(page.tag)
    keep_gain, drop_gain = [0.0] * n, [0.0] * n  # best with the node open; with all below dropped
    kept_open = [False] * n
    for i in range(n - 1, -1, -1):
        z = logits[i] if has[i] else 0.0
        # log p and log (1 - p), each against the other's even odds
        lk, ld = (-np.log1p(np.exp(-z)), -np.log1p(np.exp(z))) if has[i] and -30 < z < 30 else ((min(z, 0.0), min(-z, 0.0)) if has[i] else (0.0, 0.0))
        keep_gain[i] += lk
        drop_gain[i] += ld
        kept_open[i] = keep_gain[i] >= drop_gain[i]
        up = page.parent[i]
        if up >= 0:
            keep_gain[up] += max(keep_gain[i], drop_gain[i])
            drop_gain[up] += drop_gain[i]
    out = [False] * n
    out[0] = True
    for i in range(1, n):
        out[i] = out[page.parent[i]] and kept_open[i]
    return out


def main_text(page: Page, kept: list[bool]) -> str:
    blocks: list[str] = []
    last, run = None, []
    for node, text, block in page.texts:
        if block != last:
            blocks.append("".join(run))
            last, run = block, []
        if kept[node]:
            run.append(text)
    blocks.append("".join(run))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(sources: list, model: Boosted) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    rows, has = features(pages)
    logits = np.zeros(len(has))
    for a in range(0, len(has), NODES_AT_ONCE):
        some = has[a : a + NODES_AT_ONCE]
        if some.any():
            logits[a : a + NODES_AT_ONCE][some] = model.logits(rows(a, a + len(some))[some])
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        out.append(main_text(p, decode(p, logits[at : at + n].tolist(), has[at : at + n].tolist())))
        at += n
    return out


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points)."""
    model = trained()

    def run(batches):
        for batch in batches:
            for start, end, sources in pieces(batch.column(2)):
                texts = extract(sources, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return read.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
