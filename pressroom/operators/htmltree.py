"""Per-page helper for the extraction stage: a minimal element tree built with the
standard library's ``html.parser`` and a matcher for the nine selector forms the
source profiles use.  It runs inside the ``mapInArrow`` worker, one page at a time.

Tree rules (those of an ``html.parser``-backed soup):
* no implied end tags: ``<p>a<p>b</p>`` nests the second ``p`` in the first;
* an end tag closes the nearest open element of that name, or is ignored;
* void elements never open;
* text is collected with entities decoded; comments are dropped; text inside
  script / style / template / rt / rp is left out of an ancestor's text.

Selector forms: ``tag``, ``.cls``, ``tag.cls``, ``[attr]``, ``tag[attr]``,
``[attr*="v"]``, ``tag[attr*="v"]`` and descendant chains of those (``h2 a``,
``.title a``).  A descendant chain may match ancestors outside the element a search
starts from.  Anything else raises on the driver when the profile is registered.
"""

from __future__ import annotations

import bisect
import re
from html.parser import HTMLParser

from pressroom.functions.text import clean_text_py

# --- fixed values ----------------------------------------------------------------------
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr "
    "basefont bgsound command frame image isindex keygen menuitem nextid spacer".split())
TEXT_EXCLUDED_TAGS = frozenset(("script", "style", "template", "rt", "rp"))
# ---------------------------------------------------------------------------------------


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "start", "end", "depth")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.children = []
        self.start = 0
        self.end = 0

    def get(self, name, default=None):
        return self.attrs.get(name, default)

    def text(self) -> str:
        """Concatenated descendant text in document order, no separator (iterative:
        unclosed tags can nest thousands deep)."""
        out = []
        stack = [iter(self.children)]
        while stack:
            for ch in stack[-1]:
                if isinstance(ch, str):
                    out.append(ch)
                elif ch.tag not in TEXT_EXCLUDED_TAGS:
                    stack.append(iter(ch.children))
                    break
            else:
                stack.pop()
        return "".join(out)


class Document:
    """Parsed page: ``root`` plus all elements in document order."""

    def __init__(self, html: str):
        b = _Builder()
        b.feed(html or "")
        b.close()
        self.root = b.root
        self.elements = b.elements
        # subtree ranges over the document-order list: descendants of e are
        # elements[e.start + 1 : e.end]
        for i, e in enumerate(self.elements):
            e.start = i
        _close_ranges(self.root, len(self.elements))
        self.root.start, self.root.end = -1, len(self.elements)

        self._index = None
        self._texts = {}

    def descendants(self, node):
        return self.elements[node.start + 1: node.end]

    def candidates(self, key):
        """Document-order positions of the elements a selector's last part can match:
        by tag, by class token or by attribute name (one pass over the page, when first asked)."""
        if self._index is None:
            self._index = {}
            for i, e in enumerate(self.elements):
                keys = {("tag", e.tag)}
                keys.update(("attr", name) for name in e.attrs)
                keys.update(("class", c) for c in e.attrs.get("class", "").split())
                for k in keys:
                    self._index.setdefault(k, []).append(i)
        return self._index.get(key, [])

    def clean_text_of(self, node) -> str:
        """The cleaned text of an element, made once however many selectors and profiles ask for it."""
        t = self._texts.get(node.start)
        if t is None:
            t = self._texts[node.start] = clean_text_py(node.text())
        return t

    def release(self) -> None:
        """Give the page's memory back at once: parents and children refer to each other, so that a page let go of
        would stay until Python looks for such cycles."""
        for e in (self.root, *self.elements):
            e.children, e.parent = [], None
        self.elements, self._index, self._texts = [], None, {}


def _close_ranges(root, n):
    # iterative post-order: end = index after the last descendant
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            last = node.start
            for ch in node.children:
                if not isinstance(ch, str):
                    last = max(last, ch.end - 1)
            node.end = last + 1
            continue
        stack.append((node, True))
        for ch in node.children:
            if not isinstance(ch, str):
                stack.append((ch, False))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.root.start = -1
        self.cur = self.root
        self.elements = []

    def _new(self, tag, attrs):
        d = {}
        for k, v in attrs:
            d[k] = "" if v is None else v
        n = Node(tag, d, self.cur)
        self.cur.children.append(n)
        self.elements.append(n)
        return n

    def handle_starttag(self, tag, attrs):
        n = self._new(tag, attrs)
        if tag not in VOID_TAGS:
            self.cur = n

    def handle_startendtag(self, tag, attrs):
        self._new(tag, attrs)

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n is not self.root:
            if n.tag == tag:
                self.cur = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        if data:
            self.cur.children.append(data)


# ------------------------------------------------------------------------- selectors
_COMPOUND = re.compile(
    r'^(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)?'
    r'(?:\.(?P<cls>[A-Za-z0-9_-]+))?'
    r'(?:\[(?P<attr>[A-Za-z_:][A-Za-z0-9_:.-]*)(?:\*="(?P<val>[^"]*)")?\])?$')


class SelectorError(ValueError):
    pass


def _compile_compound(s: str):
    m = _COMPOUND.match(s)
    if not m or not s:
        raise SelectorError(f"unsupported selector part: {s!r}")
    tag, cls, attr, val = m.group("tag"), m.group("cls"), m.group("attr"), m.group("val")
    if tag is None and cls is None and attr is None:
        raise SelectorError(f"unsupported selector part: {s!r}")
    tag = tag.lower() if tag else None
    attr = attr.lower() if attr else None
    key = ("tag", tag) if tag else (("class", cls) if cls else ("attr", attr))

    def match(n: Node) -> bool:
        if tag is not None and n.tag != tag:
            return False
        if cls is not None and cls not in n.attrs.get("class", "").split():
            return False
        if attr is not None:
            if attr not in n.attrs:
                return False
            if val is not None:
                v = n.attrs[attr]
                if attr == "class":  # multi-valued: whitespace-normalised string
                    v = " ".join(v.split())
                if val == "" or val not in v:
                    return False
        return True
    match.key = key
    return match


def compile_selector(sel: str):
    """Return ``match(node) -> bool`` for one selector of the supported forms."""
    parts = sel.split()
    if not parts or len(parts) > 2:
        raise SelectorError(f"unsupported selector: {sel!r}")
    comps = [_compile_compound(p) for p in parts]
    last, ancestors = comps[-1], comps[:-1][::-1]

    def match(n: Node) -> bool:
        if not last(n):
            return False
        a = n.parent
        for c in ancestors:
            while a is not None and a.tag != "[document]" and not c(a):
                a = a.parent
            if a is None or a.tag == "[document]":
                return False
            a = a.parent
        return True
    match.key = last.key
    return match


def _scoped(doc: Document, node: Node, matcher):
    """Candidate elements inside ``node``'s subtree, in document order."""
    pos = doc.candidates(matcher.key)
    lo = bisect.bisect_right(pos, node.start)
    hi = bisect.bisect_left(pos, node.end)
    els = doc.elements
    for i in range(lo, hi):
        yield els[pos[i]]


def select(doc: Document, node: Node, matcher) -> list:
    return [e for e in _scoped(doc, node, matcher) if matcher(e)]


def select_one(doc: Document, node: Node, matcher):
    for e in _scoped(doc, node, matcher):
        if matcher(e):
            return e
    return None
