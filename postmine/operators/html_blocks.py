"""Page blocks (S2, G2, G3, G4, F3): HTML -> one compact row per page, then DataFrame gates.

The only Python here is the per-page parse inside ``mapInPandas`` (the standard-library
``html.parser``; no DOM library is available). A page becomes its text content, its approximate
visible text (script/style/template/noscript/head content left out, block elements on their own lines;
CSS visibility cannot be known offline), each stored once, and an array of elements with offsets into
them: matching selectors, child-element count and ranges. So nesting does not multiply texts. Only
elements that a tier can use are kept: those that match a selector, pass the child gate with enough
characters, or may serve the fallback of a page without a match. The tree builder supplies implied
``html``, ``head`` and ``body``, implied end tags, and hides ``template`` contents as a DOM does.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import non_blank, trim_ws
from . import gates as G

# Candidate selectors in list order (bit i of g2_mask = selector i).
CANDIDATE_SELECTORS = [
    "article", '[role="article"]', '[data-testid*="post"]', '[data-test-id*="post"]',
    'div[class*="post"]', 'div[class*="comment"]', 'div[class*="reply"]', "section", "main",
]
# Last-tier selector scan in list order (bit i of g3_mask).
SCAN_SELECTORS = [
    ".post", "div.Post", 'div[data-testid="post-container"]', 'div[data-test-id="post-content"]',
    "article", '[role="article"]',
]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol",
    "p", "pre", "section", "table", "ul",
}
HIDDEN = {"script", "style", "template", "noscript", "head", "title"}
HEAD_ONLY = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
BLOCK = CLOSES_P | {"li", "tr", "td", "th", "dd", "dt", "br", "body", "html", "caption", "thead", "tbody", "tfoot"}
# A start tag closes open elements of the first set, looking no further than the second.
_TABLE = {"table", "template"}
_ROWS = {"thead", "tbody", "tfoot"}
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", *_TABLE}), "dt": ({"dt", "dd"}, {"dl", *_TABLE}), "dd": ({"dt", "dd"}, {"dl", *_TABLE}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", *_TABLE}), "th": ({"td", "th"}, {"tr", *_TABLE}), "tr": ({"td", "th", "tr"}, {*_ROWS, *_TABLE}),
    **{t: ({"td", "th", "tr", *_ROWS}, _TABLE) for t in _ROWS},
}
# An end tag or an implied end of a paragraph never reaches outside these.
BARRIERS = {"td", "th", "caption", "button", "table", "template"}

# One row per usable element; ``elem_ord`` -1 is the page itself with the visible text of its body.
BLOCK_SCHEMA = (
    "page_url string, has_match boolean, elem_ord int, tag string, g2_mask int, g3_mask int, in_body boolean, "
    "n_children int, text_content string, visible_text string"
)
OUT_ROWS, OUT_CHARS = 2_000, 4 << 20  # element rows handed on together


def compile_selector(selector: str):
    """Test of a simple selector: tag, ``.class`` and ``[attribute="v"]`` / ``[attribute*="v"]``."""
    m = re.fullmatch(r'([a-z0-9]*)(?:\.([\w-]+))?(?:\[([\w-]+)(\*?)="([^"]*)"\])?', selector)
    if not m:
        raise ValueError(f"unsupported selector {selector}")
    tag, cls, attr, part, value = m.groups()

    def test(t: str, attrs: dict) -> bool:
        if tag and t != tag or cls and cls not in attrs.get("class", "").split():
            return False
        return not attr or attr in attrs and (value in attrs[attr] if part else value == attrs[attr])

    return test


class _Node:
    __slots__ = ("tag", "attrs", "n_children", "in_body", "order", "hidden", "inert", "span", "parent")

    def __init__(self, tag, attrs, parent, order):
        self.tag, self.attrs, self.n_children, self.order, self.parent = tag, attrs, 0, order, parent
        self.in_body = parent is not None and (parent.tag == "body" or parent.in_body)
        self.hidden = tag in HIDDEN or parent is not None and parent.hidden
        self.inert = tag == "template" or parent is not None and parent.inert  # its contents are no part of the page
        self.span = [0, 0, 0, 0]


class _TreeBuilder(HTMLParser):
    """Elements in document order with ranges in the running text and visible text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes, self.text, self.visible = [_Node("#document", {}, None, -1)], [], [], []
        self.n_text = self.n_visible = 0
        self.open: dict[str, int] = {}  # open elements by tag
        self.body = self.head = None

    # -- texts --
    def _show(self, s):
        self.visible.append(s)
        self.n_visible += len(s)

    def _push(self, tag, attrs):
        parent = self.stack[-1]
        node = _Node(tag, attrs, parent, len(self.nodes))
        if not parent.inert:
            parent.n_children += 1
            self.nodes.append(node)
        if tag in BLOCK and not node.hidden:
            self._show("\n")
        node.span[0], node.span[2] = self.n_text, self.n_visible
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "body":
            self.body = node
        elif tag == "head":
            self.head = node
        return node

    def _pop(self):
        node = self.stack.pop()
        self.open[node.tag] -= 1
        node.span[1], node.span[3] = self.n_text, self.n_visible
        if node.tag in BLOCK and not node.hidden:
            self._show("\n")

    def _pop_to(self, tags, barriers=()):
        """Close the innermost open element of ``tags`` unless a barrier is met first."""
        if not any(self.open.get(t) for t in tags):
            return False
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t in tags:
                while len(self.stack) > i:
                    self._pop()
                return True
            if t in barriers:
                return False
        return False

    # -- structure --
    def _ensure(self, name):
        """Open the implied parents of body or head content."""
        if not self.open.get("html"):
            self._push("html", {})
        if name == "body":
            self._pop_to({"head"})
            if self.body is None:
                self._push("body", {})

    def handle_starttag(self, tag, attrs):
        attrs = {k: (v or "") for k, v in attrs}
        if tag in ("html", "body", "head"):
            self._open_root(tag, attrs)
            return
        if self.body is None:
            self._ensure("head" if tag in HEAD_ONLY else "body")
        if tag in CLOSES_P:
            self._pop_to({"p"}, BARRIERS)
        if tag in IMPLIED_END:
            close, stop = IMPLIED_END[tag]
            while self._pop_to(close, stop):
                pass
        self._push(tag, attrs)
        if tag in VOID:
            self._pop()

    def _open_root(self, tag, attrs):
        have = {"html": bool(self.open.get("html")), "head": self.body is not None or self.head is not None, "body": self.body is not None}
        if have[tag]:
            return
        if tag != "html":
            self._ensure("head")
        if tag == "body":
            self._pop_to({"head"})
        self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash of a non-void element says nothing

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return  # later content still belongs to the body
        self._pop_to({tag}, BARRIERS - {tag} if tag not in {*_ROWS, "tr", "table", "template"} else {"table", "template"} - {tag})

    def handle_data(self, data):
        if self.body is None and len(self.stack) < 3 and not self.open.get("head"):
            if not data.strip():
                return
            self._ensure("body")
        elif self.body is None and self.stack[-1].tag == "head":
            if not data.strip():
                return
            self._ensure("body")
        if self.stack[-1].inert:
            return
        self.text.append(data)
        self.n_text += len(data)
        if not self.stack[-1].hidden:
            self._show(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # any "<![" ends at the next ">", as in browsers

    def finish(self):
        self.close()
        if self.body is None:
            self._ensure("body")
        while len(self.stack) > 1:
            self._pop()


_SOLID = re.compile(r"\S+")
_LONG_REFERENCE = re.compile(r"&#([0-9]{1000,})")


def _inner_text(raw):
    """Lines of a visible range: inner spaces collapsed, trimmed, empty lines dropped."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r\\f\\x0B\u00a0]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def parse_page(html: str, g2=None, g3=None):
    """``text, visible, body, has_match, elements``: the two buffers, the body's interval in ``visible``, and per
    usable element ``(order, tag, g2 mask, g3 mask, in_body, children, t0, t1, v0, v1, needs text)``."""
    g2 = g2 or [compile_selector(x) for x in CANDIDATE_SELECTORS]
    g3 = g3 or [compile_selector(x) for x in SCAN_SELECTORS]
    b = _TreeBuilder()
    # int() refuses thousands of digits; a number of eight is past the last code point as well
    b.feed(_LONG_REFERENCE.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'}", html or ""))
    b.finish()
    text = "".join(b.text)
    # from any place to the next character that is no white space: blank intervals without cutting them
    spans = [m.span() for m in _SOLID.finditer(text)]
    solid, runs = [s[0] for s in spans], [s[1] for s in spans]
    masks = [tuple(sum(1 << i for i, test in enumerate(tests) if test(n.tag, n.attrs)) for tests in (g2, g3)) for n in b.nodes]
    has_match = any(m[1] for m in masks)
    elems = []
    for n, (m2, m3) in zip(b.nodes, masks):
        t0, t1, v0, v1 = n.span
        parent = n.parent.span if n.parent.in_body else None
        at = bisect_right(runs, t0)
        blank = at == len(solid) or max(solid[at], t0) >= t1
        # the same text as its parent's: the parent's row stands for both in the text tiers
        own = n.in_body and not blank and not (parent and (t0, t1) == (parent[0], parent[1]) and n.n_children >= G.DENSE_MAX_CHILDREN)
        dense = own and n.n_children < G.DENSE_MAX_CHILDREN and t1 - t0 > G.DENSE_MIN_CHARS
        scan = m3 or own and not has_match
        if m2 or scan or dense:
            elems.append((n.order, n.tag, m2, m3, n.in_body, n.n_children, t0, t1, v0, v1, bool(scan or dense)))
    return text, "".join(b.visible), (b.body.span[2], b.body.span[3]), has_match, elems


def element_rows(page_url: str, html: str, g2=None, g3=None):
    """Rows of :data:`BLOCK_SCHEMA` of one page. Candidates need the visible text, and the text content only
    where that is blank; the other tiers need the text content."""
    text, visible, body, has_match, elems = parse_page(html, g2, g3)
    yield page_url, has_match, -1, None, 0, 0, False, 0, None, visible[slice(*body)]
    for order, tag, m2, m3, in_body, n, t0, t1, v0, v1, needs in elems:
        shown = visible[v0:v1] if m2 else None
        needs = needs or not shown.replace("\ufeff", "").strip()
        yield page_url, has_match, order, tag, m2, m3, in_body, n, text[t0:t1] if needs else None, shown


def page_blocks(pages: DataFrame, url_col: str = "page_url", html_col: str = "html") -> DataFrame:
    """Element rows of every page (``BLOCK_SCHEMA``). Run the URL gate (F1) before this stage: Catalyst cannot
    push predicates through ``mapInArrow``."""
    import sys

    import pyarrow as pa

    from ..session import ship_module

    ship_module(sys.modules[__name__])
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in BLOCK_SCHEMA.split(", ")])

    def run(batches):
        g2, g3 = [compile_selector(x) for x in CANDIDATE_SELECTORS], [compile_selector(x) for x in SCAN_SELECTORS]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows, size = [], 0
        for b in batches:
            for u, h in zip(b.column(0), b.column(1)):
                for row in element_rows(u.as_py(), h.as_py(), g2, g3):
                    rows.append(row)
                    size += len(row[-1] or "") + len(row[-2] or "")
                    if len(rows) >= OUT_ROWS or size >= OUT_CHARS:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)

    return pages.select(url_col, html_col).mapInArrow(run, BLOCK_SCHEMA)


def elements(blocks: DataFrame) -> DataFrame:
    """The element rows without those of the pages."""
    return blocks.filter(F.col("elem_ord") >= 0)


def page_text(pages: DataFrame, blocks: DataFrame, url_col: str = "page_url", html_col: str = "html") -> DataFrame:
    """Visible body text of each page; the html when that text is blank."""
    body = blocks.filter(F.col("elem_ord") < 0).select("page_url", _inner_text(F.col("visible_text")).alias("text"))
    p = pages.select(F.col(url_col).alias("page_url"), F.col(html_col).alias("html"))
    j = p.join(body, "page_url", "left")
    return j.select("page_url", F.when(non_blank("text"), F.col("text")).otherwise(F.coalesce("html", F.lit(""))).alias("text"))


def _numbered(first: DataFrame, text_col: str) -> DataFrame:
    """``pos`` from 1 in page order; a page is one parsed row, so its window is bounded by it."""
    w = Window.partitionBy("page_url").orderBy("o")
    return first.select("page_url", F.row_number().over(w).cast("bigint").alias("pos"), text_col)


def _selected(e: DataFrame, mask: str, n: int, *cols) -> DataFrame:
    which = F.array_compact(F.array(*[F.when(F.col(mask).bitwiseAND(1 << i) > 0, F.lit(i)) for i in range(n)]))
    return e.filter(F.col(mask) > 0).select("page_url", "elem_ord", F.explode(which).alias("sel"), *cols)


def candidates(blocks: DataFrame) -> DataFrame:
    """G2 + F2 + F3 + U1: all ordered distinct candidate blocks per page.

    Order: selector list order, then document order; then every body element (dense tier).
    Returns ``(page_url, pos, block)`` with ``pos`` 1-based.
    """
    e = elements(blocks)
    raw = F.when(non_blank("visible_text"), _inner_text(F.col("visible_text"))).otherwise(F.col("text_content"))
    sel = _selected(e, "g2_mask", len(CANDIDATE_SELECTORS), trim_ws(raw).alias("block")).filter(G.candidate_ok("block"))
    dense = e.filter(F.col("in_body") & (F.col("n_children") < G.DENSE_MAX_CHILDREN)).select(
        "page_url", "elem_ord", F.lit(len(CANDIDATE_SELECTORS)).alias("sel"), trim_ws("text_content").alias("block")
    ).filter(F.length("block") > G.DENSE_MIN_CHARS)
    first = sel.unionByName(dense).filter(F.col("block") != "").groupBy("page_url", "block").agg(F.min(F.struct("sel", "elem_ord")).alias("o"))
    return _numbered(first, "block")


def selector_scan(blocks: DataFrame) -> DataFrame:
    """Texts of the scan selectors in list/document order; a page where no element matched falls
    back to all its non-blank body-element texts. Ordered distinct, non-blank. Returns
    ``(page_url, pos, post)``."""
    e = elements(blocks)
    post = trim_ws("text_content").alias("post")
    matched = _selected(e, "g3_mask", len(SCAN_SELECTORS), post)
    body = e.filter(F.col("in_body") & ~F.col("has_match")).select("page_url", "elem_ord", F.lit(len(SCAN_SELECTORS)).alias("sel"), post)
    first = matched.unionByName(body).filter(F.col("post") != "").groupBy("page_url", "post").agg(F.min(F.struct("sel", "elem_ord")).alias("o"))
    return _numbered(first, "post")
