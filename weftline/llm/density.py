"""Main text of web pages by composite text density.

A page is parsed into a tree. For every node, C and T are the characters and tags in its
subtree, LC and LT those inside links; with the body's C and LC the density is

    C / T * log(C / LC * T / LT) / log(ln(C / notLC * LC + LC_body / C_body * C + e))

where T, LC, LT, notLC and the divisor count as 1 at least: characters per tag, adjusted for links. The
density sum of a node is the sum over its children, text lying directly in the node counting
as a child of density C / 1 like an element without links. The node of the largest sum is
found; the threshold is the least density on the path from it up to the body. From the body
down, the first nodes with at least the threshold hold content, and of each the subtree node
of the largest density sum is taken, with all its text. Of equal nodes the first wins.

Characters are those of the text with runs of white space as one space and none at its ends,
outside of ``SKIP`` elements. Text of block elements is set off by a line break.

Parsing is forgiving: void elements, implied ends of p, li, dt, dd, tr, td, th and option,
end tags without a start are ignored, open elements end with the page, a tag cut off by its end is dropped, ``>`` inside quotes,
comments and raw text elements are recognised.

Cases: a null page has null results; an empty one, or one without text, has an empty text and
density 0. A page without a body element is its own body. Pages of any length and depth are
parsed whole. Null ids and repeated rows are rows of their own; an empty table gives an empty
result. Extra columns are kept; one called like a result column is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import appended, plus, table, texts

RESULT = "content string, tag string, density_sum double, threshold double, n_nodes int, n_chars int, content_chars int"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: A tag that the page's end cuts off.
CUT = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("head script style noscript template iframe object svg select textarea".split())
RAW = frozenset("script style noscript template iframe textarea svg".split())
BLOCK = frozenset("address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A start tag ends open elements of these names, up to the nearest of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
ROOT = "#root"


class Page:
    """The tree of a page: arrays by node, in document order, so parents come first."""

    def __init__(self, html: str):
        self.tag, self.parent, self.end = [ROOT], [-1], [0]
        self.first, self.last = [0], [0]  # of each node's part of text
        self.text: list[tuple[int, str]] = []  # (node, words joined by single spaces), block ends as (-1, "")
        self._parse(html)

    def _open(self, tag: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.end.append(0)
        self.first.append(len(self.text))
        self.last.append(len(self.text))
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack, at, skip = [0], 0, 0
        low = None

        def close(k: int) -> None:
            nonlocal skip
            for i in stack[k:]:
                self.end[i], self.last[i] = len(self.tag), len(self.text)
                skip -= self.tag[i] in SKIP
            del stack[k:]

        def put(raw: str) -> None:
            if not skip:
                words = (unescape(raw) if "&" in raw else raw).split()
                if words:
                    self.text.append((stack[-1], (" " if raw[:1].isspace() else "") + " ".join(words) + (" " if raw[-1:].isspace() else "")))
                elif raw:
                    self.text.append((stack[-1], " "))

        pos, n = 0, len(html)
        while pos < n:
            m = TOKEN.search(html, pos)
            if m is None:
                rest = CUT.search(html, at)
                put(html[at : rest.start() if rest else n])
                at = n
                break
            if m.start() > at:
                put(html[at : m.start()])
            at = pos = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        close(k)
                        break
            else:
                if name in IMPLIED:
                    ends, stop = IMPLIED[name]
                    first = 0
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] in stop:
                            break
                        if self.tag[stack[k]] in ends:
                            first = k
                    if first:
                        close(first)
                elif name in CLOSES_P:
                    k = len(stack) - 1
                    while k > 0 and self.tag[stack[k]] not in CLOSES_P and self.tag[stack[k]] not in ("td", "th", "body"):
                        k -= 1
                    if k > 0 and self.tag[stack[k]] == "p":
                        close(k)
                i = self._open(name, stack[-1])
                if name in VOID or m.group(3).endswith("/"):
                    self.end[i] = i + 1
                elif name in RAW:
                    if low is None:
                        low = html.lower() if len(html.lower()) == len(html) else html
                    pos = low.find("</" + name, at)
                    self.end[i] = i + 1
                    if pos < 0:
                        at = pos = n
                    else:
                        stop = html.find(">", pos)
                        at = pos = n if stop < 0 else stop + 1
                else:
                    stack.append(i)
                    skip += name in SKIP
            if name in BLOCK and not skip:
                self.text.append((-1, ""))
        if at < n:
            put(html[at:])
        close(0)

    def words(self, node: int) -> str:
        """The text of a node's subtree, a line for each block."""
        lines, line = [], []
        for i, t in self.text[self.first[node] : self.last[node]]:
            if i == -1:
                lines.append(line)
                line = []
            else:
                line.append(t)
        lines.append(line)
        return "\n".join(s for x in lines if x and (s := " ".join("".join(x).split())))


def measures(page: Page):
    """Body, and for every node: characters, tags, link characters, link tags, density and density sum."""
    n = len(page.tag)
    own, chars, tags, lchars, ltags = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    for i, t in page.text:
        if i >= 0:
            own[i] += len(t.strip())
    link = [False] * n
    for i in range(n):
        up = page.parent[i]
        link[i] = page.tag[i] == "a" or (up >= 0 and link[up])
        chars[i] += own[i]
        if link[i]:
            lchars[i], ltags[i] = own[i], 1
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        chars[up] += chars[i]
        tags[up] += tags[i]
        lchars[up] += lchars[i]
        ltags[up] += ltags[i]
    body = page.tag.index("body") if "body" in page.tag else 0
    rate = lchars[body] / chars[body] if chars[body] else 0.0
    density, total = [0.0] * n, [float(x) for x in own]
    for i in range(n):
        c, t, lc, lt = chars[i], tags[i], lchars[i], ltags[i]
        if c:
            base = math.log(math.log(c / max(1, c - lc) * lc + rate * c + math.e))
            top = math.log(max(1.0, c / max(1, lc) * t / max(1, lt)))
            density[i] = c / t * top / max(1.0, base)
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    return body, chars, density, total


def extract(html: str) -> tuple:
    """(content, tag, density_sum, threshold, n_nodes, n_chars, content_chars) of a page."""
    page = Page(html)
    body, chars, density, total = measures(page)
    hi = page.end[body]
    if not chars[body]:
        return "", "", 0.0, 0.0, len(page.tag) - 1, 0, 0
    best = max(range(body, hi), key=lambda i: (total[i], -i))
    threshold, i = density[best], best
    while i != body:
        i = page.parent[i]
        threshold = min(threshold, density[i])
    parts, i = [], body
    while i < hi:
        if density[i] >= threshold:
            top = max(range(i, page.end[i]), key=lambda k: (total[k], -k))
            parts.append(page.words(top))
            i = page.end[i]
        else:
            i += 1
    content = "\n".join(p for p in parts if p)
    return content, page.tag[best], total[best], threshold, len(page.tag) - 1, chars[body], len(content)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the columns of ``RESULT``; one pass, no shuffle."""
    schema = plus(pages.schema, RESULT)
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                got = list(zip(*((None,) * 7 if t is None else extract(t) for t in texts(batch, html))))
                yield appended(batch, schema, {n: pa.array(v, k) for n, v, k in zip(names, got, kinds)})

    return pages.mapInArrow(run, schema)


def op5_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
