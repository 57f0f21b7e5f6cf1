import math
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from weftline.llm import density as d


class Tree(HTMLParser):
    """A plain tree of pages in which at most p and b are left open: [tag, parent, own texts, children]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.nodes, self.now = [["#root", None, [], []]], 0
        self.feed(html)
        self.close()

    def open(self, tag):
        at = self.now
        while at and self.nodes[at][0] != tag:
            at = self.nodes[at][1]
        return at

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "ul", "div", "footer") and (at := self.open("p")):
            self.now = self.nodes[at][1]
        self.nodes.append([tag, self.now, [], []])
        self.nodes[self.now][3].append(len(self.nodes) - 1)
        if tag not in d.VOID:
            self.now = len(self.nodes) - 1

    def handle_endtag(self, tag):
        if at := self.open(tag):
            self.now = self.nodes[at][1]

    def handle_data(self, data):
        at, skip = self.now, False
        while at is not None:
            skip |= self.nodes[at][0] in d.SKIP
            at = self.nodes[at][1]
        if not skip:
            self.nodes[self.now][2].append(" ".join(data.split()))

    def sums(self, i, link=False):
        link = link or self.nodes[i][0] == "a"
        own = sum(map(len, self.nodes[i][2]))
        out = [own, 1, own * link, int(link)]
        for k in self.nodes[i][3]:
            out = [a + b for a, b in zip(out, self.sums(k, link))]
        return out

    def inside(self, i):
        return [i, *(x for k in self.nodes[i][3] for x in self.inside(k))]


def brute(html):
    t = Tree(html)
    body = next((i for i, n in enumerate(t.nodes) if n[0] == "body"), 0)
    cb, _, lb, _ = t.sums(body)
    def dens(i):
        c, n, lc, lt = t.sums(i, any(t.nodes[a][0] == "a" for a in up(i)))
        if not c:
            return 0.0
        base = math.log(math.log(c / max(1, c - lc) * lc + (lb / cb if cb else 0) * c + math.e))
        top = math.log(max(1.0, c / max(1, lc) * n / max(1, lt)))
        return c / n * top / max(1.0, base)
    def up(i):
        while (i := t.nodes[i][1]) is not None:
            yield i
    def total(i):
        return sum(map(len, t.nodes[i][2])) + sum(dens(k) for k in t.nodes[i][3])
    nodes = t.inside(body)
    best = max(nodes, key=lambda i: (total(i), -i))
    threshold = min(dens(i) for i in [best, *up(best)] if i in nodes)
    def text(i):
        return "".join("".join(t.nodes[k][2]) for k in sorted(t.inside(i)))
    out = []
    def walk(i):
        if dens(i) >= threshold:
            out.append(text(max(t.inside(i), key=lambda k: (total(k), -k))))
        else:
            for k in t.nodes[i][3]:
                walk(k)
    walk(body)
    return t.nodes[best][0], total(best), threshold, out


PAGES = [
    "<html><body><nav><a href='x'>home</a> <a href='y'>news</a></nav><div id=m><p>A long enough paragraph about something of note.</p><p>Another one, with a <a href=z>link</a> inside it.</p></div><footer>fin</footer></body></html>",
    "<html><body><div><div><p>one two three</p></div><ul><li>a</li><li>b</li></ul></div><script>var x = '<p>';</script></body></html>",
    "<div>no body <b>here</b></div>",
    "<html><body><table><tr><td>cell one</td><td>cell two with more words in it</td></tr></table></body></html>",
]


@pytest.mark.parametrize("html", PAGES)
def test_against_a_plain_tree(html):
    tag, total, threshold, parts = brute(html)
    got = d.extract(html)
    assert got[1] == tag and abs(got[2] - total) < 1e-9 and abs(got[3] - threshold) < 1e-9
    squash = lambda s: sorted("".join(s.split()))  # the plain tree gives texts node by node
    assert squash(got[0]) == squash("".join(parts))


@pytest.mark.parametrize("html,content", [
    ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a</p", "a"), ("<!-- c --><p>x &amp; y</p>", "x & y"), ("<p>unclosed <b>bold", "unclosed bold"), ("</p></div>text", "text"),
    ('<p title="a > b">kept</p>', "kept"), ("<script>if (a < b) {}</script>after", "after"), ("<script>never closed", ""), ("<br/>a<br>b", "a\nb"), ("<p>one\n  two</p>", "one two"),
])
def test_forgiving(html, content):
    assert d.extract(html)[0] == content


def test_deep_and_long_pages_are_parsed_whole():
    assert d.extract("<div>" * 20_000 + "deep")[0] == "deep"
    words = " ".join(f"w{i}" for i in range(200_000))
    assert d.extract(f"<body><p>{words}</p></body>")[0] == words


def test_article_is_found_in_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    good = 0
    for r in pages:
        article = re.search("<article>(.*?)(?:</article>|<footer)", r.html, re.S).group(1)
        want, got = ("".join(x.split()) for x in (d.Page(f"<body>{article}").words(0), d.extract(r.html)[0]))
        assert want in got or got in want  # at worst one paragraph stands for it, or the page around a very short one stays
        good += got == want
    assert good >= 0.9 * len(pages)


def test_nasty_rows_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, None, "u"), (1, None, "u"), (None, "<p>x</p>", None), (2, "", "u")], "page_id bigint, html string, url string").withColumn("content", F.lit(1))
    got = d.main_text(df)
    assert sorted(str(r.content) for r in got.collect()) == ["", "None", "None", "x"] and got.count() == 4
    assert d.main_text(df.limit(0)).count() == 0


def test_query_against_the_plain_tree(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in d.op5_density(spark, sf_dir).collect()}
    assert sorted(got) == sorted(pages)
    for i, html in pages.items():
        r = got[i]
        tag, total, threshold, parts = brute(html)
        assert "".join("".join(parts).split()) == "".join((r.content or "").split()), i
        assert (r.tag, round(r.density_sum, 6), round(r.threshold, 6)) == (tag, round(total, 6), round(threshold, 6)), i
        assert (r.content, r.tag, r.density_sum, r.threshold) == d.extract(html)[:4]
