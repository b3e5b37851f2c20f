"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree; each is content or not.  The model multiplies a potential per element
(logistic in its features: tag, names in its class and id, share of text in links, text length, sentence marks) and
one per parent-child pair (how often a content parent has a content child, and so on; boxes, text elements and other parts apart).  Sum-product message passing,
once up and once down the tree, gives each element's marginal; the text of elements more likely content than not is
the main text, one line per block in page order.

A class or id counts as the name of another part only as a whole (``comments``, ``site-header``); where such a word
only occurs in it (``share-price``, ``comments-on-the-war``) it is a weak hint, and the ids of headings are anchors, not
names.

Training pages label themselves by evidence other than those names: a page with an ``article`` or ``main`` element (or
such a role) has no content outside it; inside, text that stands on pages of at least ``RECURS`` different headings is
boilerplate, and so are text mostly in links and what is in HTML's own elements for other parts; elements that only a
name speaks against are left out of the training.  A bounded sample of such pages (``TRAIN_PAGES``) is
parsed, and each block counts twice, once as if its page marked no main element, so that tags, lengths and links carry
weight of their own.  Pair potentials are smoothed counts, and feature weights are fitted by gradient steps on the logistic likelihood under a Gaussian prior around ``PRIOR``, so that what
the sample doesn't show keeps a plausible value.

Text of scripts, styles, forms' controls and the like is never text.  Character references are decoded; white space
inside a block (line breaks too) becomes one space.

Rows are independent: one narrow Arrow stage.  Defined results: NULL and empty pages have empty text; pages without
any tag are one block of text; unclosed, stray and deeply nested tags are repaired (messages run without recursion);
repeated rows give repeated results; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_PAGES = 400
RECURS = 3

#: HTML's own lists of elements.
BLOCKS = frozenset(("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr"
                    " td th blockquote pre figure figcaption header footer nav aside form fieldset address hgroup"
                    " details summary center caption dialog search menu hr").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset(("script style head title noscript template svg canvas iframe object button select option"
                    " textarea input label datalist audio video map noembed noframes rp").split())
CLOSES_P = BLOCKS - {"html", "body"} - frozenset("td th tr thead tbody tfoot caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption caption summary address".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
        "th": ("tr", "table"), "option": ("select",)}
#: Words in a class, id or role that name a page's other parts, and those that name its text.
OTHER = frozenset(("nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail widget footer foot header"
                   " masthead banner topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay ad ads"
                   " advert adverts advertisement sponsor sponsored promo promoted social share sharing related"
                   " recommended newsletter subscribe signup login form search comment comments reply replies discussion"
                   " disqus pagination pager copyright legal skip tags complementary contentinfo").split())
MAIN = frozenset("article content main post entry story body text page prose articlebody maincontent".split())
#: Words that only say where or what box, beside those of a name.
PLACE = frozenset(("site page main global primary secondary top bottom left right upper lower inner outer box block list"
                   " item items section area wrap wrapper container content row col column bar panel unit slot zone group"
                   " user reader readers button buttons icon icons tools post posts article articles link links text body module widget view").split())

#: Prior weights: before training, and where the sample is silent.
PRIOR = {"bias": 0.0, "tag:article": 3.0, "tag:main": 2.0, "tag:nav": -9.0, "tag:footer": -9.0, "tag:header": -3.0,
         "tag:aside": -9.0, "tag:form": -9.0, "tag:menu": -9.0, "tag:dialog": -9.0, "tag:search": -9.0,
         "tag:address": -1.0, "tag:p": 1.0, "tag:h1": 1.5, "tag:h2": 1.0, "tag:h3": 1.0, "tag:h4": 0.8,
         "tag:blockquote": 1.0, "tag:pre": 1.0, "tag:li": 0.3, "tag:td": 0.3, "tag:dd": 0.3, "other": -9.0,
         "hint": -0.7, "main": 4.0, "links": -3.0, "long": 0.8, "marks": 0.6, "in_other": -6.0, "in_main": 2.5}
#: Smoothing counts of (parent, child) states: parents and children mostly agree.
PAIRS = ((8.0, 2.0), (1.0, 9.0))
#: The same for children named as other parts, which say nothing about what they stand in.
PART_PAIRS = ((9.0, 1.0), (9.0, 1.0))

# An unquoted value goes on to white space or the tag's end; a quote in it or in a name opens nothing.
_NAMED = r"[^\s/>=<][^\s/>=<]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>][^\s<>]*+)?)?"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_NAMED})*+)>|<[!?][^>]*>?", re.S)
_ATTR = re.compile(r"([^\s/>=<][^\s/>=<]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>][^\s<>]*+))?)?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    tag: str
    parent: int
    cues: frozenset = frozenset()   # of "other", "hint", "main": what its names say
    runs: list = field(default_factory=list)   # (order, text, in a link) of the element's own text
    in_main: bool = False
    in_other: bool = False


def parse(page: str | None) -> list[Block]:
    """The page's block elements, parents before children; inline elements belong to their block."""
    page = page or ""
    blocks = [Block("html", -1)]
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # open elements: tag, block, silent
    count = {"html": 1}
    links, order, at = 0, 0, 0

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            tag = stack.pop()[0]
            count[tag] -= 1
            links -= tag == "a"

    def text(raw: str) -> None:
        nonlocal order
        if raw and not stack[-1][2]:
            blocks[stack[-1][1]].runs.append((order, html.unescape(raw), links > 0))
            order += 1

    def nearest(tag: str, stops: tuple[str, ...] = ()) -> int:
        """Place of the nearest open element of a name (0: none before a stop)."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                return k
            if stack[k][0] in stops:
                return 0
        return 0

    while True:
        m = _TOKEN.search(page, at)
        text(page[at:m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag in count and count[tag] and (k := nearest(tag)):
                # an inline end tag does not close blocks opened inside it
                if tag in BLOCKS or tag in SILENT or not any(t in BLOCKS for t, _, _ in stack[k + 1:]):
                    close(k)
                elif tag == "a":
                    links = max(0, links - 1)
                    stack[k] = ("span", *stack[k][1:])
                    count["a"], count["span"] = count["a"] - 1, count.get("span", 0) + 1
            if tag in ("p", "br", "div"):
                text(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and count.get("p") and (k := nearest("p", ("td", "th", "table", "button"))):
            close(k)
        if tag in SAME and count.get(tag) and (k := nearest(tag, SAME[tag])):
            close(k)
        if tag == "dd" and count.get("dt") and (k := nearest("dt", ("dl",))):
            close(k)
        if tag in ("br", "wbr", "img", "hr"):
            text("" if tag == "wbr" else " ")
        if tag in VOID:
            continue
        parent, silent = stack[-1][1], stack[-1][2] or tag in SILENT
        block = parent
        cues: frozenset = frozenset()
        if m.group(3):
            found = [(a.lower(), b or c or d or "") for a, b, c, d in _ATTR.findall(m.group(3))]
            cues = names_of(tag, found)
            silent |= any(a == "hidden" or a == "aria-hidden" and x == "true"
                          or a == "style" and "display:none" in x.replace(" ", "").lower() for a, x in found)
        if tag in BLOCKS or "other" in cues:
            block = len(blocks)
            up = blocks[parent]
            b = Block(tag, parent, cues)
            b.in_other = up.in_other or _other(up)
            b.in_main = not b.in_other and (up.in_main or _main(up))
            blocks.append(b)
        stack.append((tag, block, silent))
        count[tag] = count.get(tag, 0) + 1
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            text(page[at:stop])
            at = stop
    return blocks


def names_of(tag: str, attributes: list[tuple[str, str]]) -> frozenset:
    """What an element's class, id, role and itemprop say it is."""
    out = set()
    for a, value in attributes:
        if a not in ("class", "id", "role", "itemprop") or a == "id" and tag in HEADINGS:
            continue
        for name in value.split():
            parts = [w.lower() for w in _WORDS.findall(name)]
            if tag in HEADINGS or "header" not in parts:  # a header is judged by where it stands
                own = OTHER.intersection(parts)
            else:
                own = OTHER.intersection(parts) - {"header"}
                out.add("header" if set(parts) <= {"header"} | PLACE else "hint")
            if tag in HEADINGS:
                own -= {"header"}
            if own:
                out.add("other" if all(w in OTHER or w in PLACE for w in parts) else "hint")
            elif MAIN.intersection(parts) and all(w in MAIN or w in PLACE for w in parts):
                out.add("main")
                if "articlebody" in ("".join(parts), name.lower()) or parts == ["main"]:
                    out.add("region")
    return frozenset(out)


def _other(b: Block) -> bool:
    return b.tag in ("nav", "footer", "aside", "form", "menu", "dialog", "search") or "other" in b.cues or (
        (b.tag == "header" or "header" in b.cues) and not b.in_main)


def _main(b: Block) -> bool:
    return b.tag in ("article", "main") or "region" in b.cues


def features(b: Block, plain: bool = False) -> dict[str, float]:
    """A block's features; ``plain``: as if the page did not mark its main element."""
    own = "".join(t for _, t, _ in b.runs)
    n = len(own.strip())
    linked = sum(len(t.strip()) for _, t, a in b.runs if a)
    out = {"bias": 1.0, f"tag:{'div' if plain and _main(b) else b.tag}": 1.0}
    if "other" in b.cues or "header" in b.cues and not b.in_main:
        out["other"] = 1.0
    elif "hint" in b.cues:
        out["hint"] = 1.0
    elif "main" in b.cues and not plain:
        out["main"] = 1.0
    if b.in_other:
        out["in_other"] = 1.0
    if b.in_main and not plain:
        out["in_main"] = 1.0
    if n:
        out["links"] = linked / n
        out["long"] = min(n, 200) / 100
        out["marks"] = min(sum(own.count(c) for c in ".,;!?"), 4) / 2
    return out


@dataclass
class Model:
    weights: dict[str, float]
    pairs: tuple  # pairs[parent state][child state], state 1: content
    texts: tuple | None = None  # the same for children that are text elements (None: as the others)
    parts: tuple | None = None  # and for those named as other parts

    def pair(self, b: Block) -> tuple:
        if self.parts and _other(b):
            return self.parts
        return self.texts if self.texts and b.tag in TEXTS else self.pairs

    def marginals(self, blocks: list[Block]) -> list[float]:
        """Chance of each block to be content: messages from the leaves to the root, then back."""
        n = len(blocks)
        own = np.ones((n, 2))
        for i, b in enumerate(blocks):
            z = sum(self.weights.get(k, 0.0) * x for k, x in features(b).items())
            own[i] = 1.0, np.exp(min(max(z, -30.0), 30.0))
        own = (own / own.sum(axis=1, keepdims=True)).tolist()
        pair = [self.pair(b) for b in blocks]
        up = [list(x) for x in own]      # own potential times the messages of the children
        sent = [[1.0, 1.0] for _ in range(n)]
        for i in range(n - 1, 0, -1):    # children come after their parents
            a, b = up[i]
            (p00, p01), (p10, p11) = pair[i]
            s0, s1 = p00 * a + p01 * b, p10 * a + p11 * b
            t = s0 + s1
            sent[i] = s0, s1 = [s0 / t, s1 / t]
            q = up[blocks[i].parent]
            q[0] *= s0
            q[1] *= s1
            t = q[0] + q[1] or 1e-300
            q[0] /= t
            q[1] /= t
        total = [[0.0, 0.0]] * n
        total[0] = up[0]
        for i in range(1, n):
            r = total[blocks[i].parent]
            (p00, p01), (p10, p11) = pair[i]
            c0, c1 = r[0] / max(sent[i][0], 1e-300), r[1] / max(sent[i][1], 1e-300)
            d0, d1 = c0 * p00 + c1 * p10, c0 * p01 + c1 * p11
            a, b = up[i][0] * d0, up[i][1] * d1
            t = a + b or 1e-300
            total[i] = [a / t, b / t]
        return [x[1] / ((x[0] + x[1]) or 1e-300) for x in total]

    def extract(self, page: str | None) -> str:
        """The main text: content blocks in page order, a line each."""
        blocks = parse(page)
        chances = self.marginals(blocks) if len(blocks) > 1 else [1.0]
        runs = sorted((o, i, t) for i, b in enumerate(blocks) if chances[i] > 0.5 for o, t, _ in b.runs)
        lines, last, part = [], None, []
        for o, i, t in runs + [(-1, None, "")]:
            # a block's text goes on only while no other block's text comes between
            if i != last and part:
                if line := _SPACE.sub(" ", "".join(part)).strip():
                    lines.append(line)
                part = []
            last = i
            part.append(t)
        return "\n".join(lines)


def _line(b: Block) -> str:
    return _SPACE.sub(" ", "".join(t for _, t, _ in b.runs)).strip()


def headings_of(pages: list[list[Block]]) -> dict[str, set]:
    """The first headings of the pages each block's text stands on."""
    seen: dict[str, set] = defaultdict(set)
    for blocks in pages:
        first = next((_line(b) for b in blocks if b.tag in HEADINGS), "")
        for b in blocks:
            if line := _line(b):
                seen[line].add(first)
    return seen


def labels_of(blocks: list[Block], seen: dict[str, set]) -> list[int | None] | None:
    """What a page says about itself (None for a block: left out; for all: no main element)."""
    if not any(_main(b) for b in blocks):
        return None
    out: list[int | None] = []
    inside: list[bool] = []
    for b in blocks:
        up = b.parent >= 0 and inside[b.parent]
        here = up or b.parent >= 0 and _main(b)
        if b.tag in ("nav", "footer", "aside", "form", "menu", "dialog", "search"):
            here = False
        inside.append(here)
        line = _line(b)
        linked = sum(len(t.strip()) for _, t, a in b.runs if a)
        if not here or line and (2 * linked > len(line) or len(seen[line]) >= RECURS):
            out.append(0)
        else:
            out.append(None if _other(b) or b.in_other else 1)
    return out


def fit(pages: list[str | None], steps: int = 200, strength: float = 4.0) -> Model:
    """Weights and pair potentials from the pages that label themselves."""
    counts = np.array([PAIRS, PAIRS, PART_PAIRS])  # of boxes, of text elements, of other parts
    rows, ys = [], []
    parsed = [parse(page) for page in pages]
    seen = headings_of(parsed)
    for blocks in parsed:
        labels = labels_of(blocks, seen)
        if labels is None:
            continue
        for b, y in zip(blocks, labels):
            if y is None:
                continue
            rows += features(b), features(b, plain=True)
            ys += y, y
            if b.parent >= 0 and labels[b.parent] is not None:
                counts[2 if _other(b) else int(b.tag in TEXTS), labels[b.parent], y] += 1
    names = sorted(set(PRIOR).union(*rows)) if rows else sorted(PRIOR)
    at = {k: i for i, k in enumerate(names)}
    prior = np.array([PRIOR.get(k, 0.0) for k in names])
    w = prior.copy()
    if rows:
        x = np.zeros((len(rows), len(names)))
        for r, f in enumerate(rows):
            for k, v in f.items():
                x[r, at[k]] = v
        y = np.array(ys, float)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 0.5 * (x.T @ (p - y) / len(y) + strength * (w - prior) / len(y))
    # a pair's potential is its rate, bounded so that a strong element can still differ from its parent
    boxes, texts, parts = np.clip(counts / counts.sum(axis=2, keepdims=True), 0.05, 0.95)
    return Model(dict(zip(names, w.tolist())), *(tuple(map(tuple, x.tolist())) for x in (boxes, texts, parts)))


def train(pages: DataFrame, limit: int = TRAIN_PAGES, html_col: str = "html") -> Model:
    """Fit on a sample of about ``limit`` pages."""
    n = pages.count()
    got = (pages.select(F.col(html_col).alias("html")).sample(fraction=min(1.0, limit / max(n, 1)), seed=5)
           .limit(2 * limit).collect())
    return fit([r.html for r in got])


def extract_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    @F.pandas_udf(T.StringType())
    def text(found: pd.Series) -> pd.Series:
        return pd.Series([model.extract(p) for p in found], dtype=object)
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
