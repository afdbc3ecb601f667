"""The content of pages against a slow tree of nested nodes, literal cases, and pages that are broken, deep or long."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from sievegrid.plans import rulebook
from sievegrid.sources import page_tree

PAGES = "page_id long, url string, html string, title string, row string, tree int"


# --- a slow tree: nodes that hold nodes, read by recursion ---------------------------------------------------------
class Node:
    def __init__(self, tag, names=(), own_id=None):
        self.tag, self.names, self.own_id, self.inside = tag, list(names), own_id, []

    def all(self):
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.all()

    def texts(self):
        for x in self.inside:
            if isinstance(x, Node):
                yield from x.texts()
            elif x.strip():
                yield x.strip()

    def html(self, rng):
        attributes = (f' class="{" ".join(self.names)}"' if self.names else "") + (f" id={self.own_id}" if self.own_id else "")
        tag = self.tag.upper() if rng.random() < 0.2 else self.tag
        return f"<{tag}{attributes}>" + "".join(x.html(rng) if isinstance(x, Node) else x for x in self.inside) + f"</{tag}>"

    def pruned(self):
        out = Node(self.tag, self.names, self.own_id)
        for x in self.inside:
            called = "" if not isinstance(x, Node) else f"{' '.join(x.names)} {x.own_id or ''}".lower()
            if not isinstance(x, Node):
                out.inside.append(x)
            elif x.tag not in page_tree.DROPPED_TAGS and not any(n in called for n in page_tree.DROPPED_NAMES):
                out.inside.append(x.pruned())
        return out


def slow_contents(root, host):
    root = root.pruned()
    chars = lambda n: sum(map(len, n.texts()))
    picked = None
    for site, selectors in page_tree.SELECTORS.items():
        if site in host:
            for tag, names, own_id in selectors:
                fits = [n for n in root.all() if n.tag == tag and set(names) <= set(n.names) and own_id in (None, n.own_id)]
                if picked is None and fits and chars(fits[0]) > 100:
                    picked = fits[0]
            break
    if picked is None:
        held = [n for n in root.all() if n.tag in page_tree.CONTAINERS and sum(x.tag == "div" for x in n.all()) <= 8 and chars(n)]
        picked = max(held, key=chars, default=next((n for n in root.all() if n.tag == "body"), root))
    tables, lines = [], []

    def walk(n):
        for x in n.inside:
            if not isinstance(x, Node):
                lines.extend([x.strip()] if x.strip() else [])
            elif x.tag == "table":
                rows = [[" ".join(c.texts()) for c in r.all() if c.tag in ("td", "th")] for r in x.all() if r.tag == "tr"]
                tables.append([r for r in rows if any(r)])
            else:
                walk(x)

    walk(picked)
    return "\n".join(lines), [t for t in tables if t]


def made(rng, depth=0):
    """A random well-formed node; texts have no blanks at their ends, so each is one line."""
    tag = rng.choice(["div", "div", "div", "section", "article", "main", "p", "span", "b", "table", "nav", "aside"] if depth else ["div"])
    names = rng.sample(["x", "content", "allZoom", "side-menu", "article-content", "wide"], rng.choice([0, 0, 0, 1, 2]))
    node = Node(tag, names, rng.choice([None, None, None, None, "desContent", "topSearch"]))
    word = lambda: " ".join(rng.choice(["alpha", "beta&amp;gamma", "delta", "wörter"]) for _ in range(rng.randrange(1, 9)))
    if tag == "table":
        for _ in range(rng.randrange(3)):
            row = Node("tr")
            for _ in range(rng.randrange(3)):
                cell = Node(rng.choice(["td", "th"]))
                cell.inside.append(word())
                if depth < 4 and rng.random() < 0.2:
                    inner = made(rng, depth + 2)
                    cell.inside.append(inner)
                row.inside.append(cell)
            node.inside.append(row)
        return node
    inline = tag in ("p", "span", "b")
    for _ in range(rng.randrange(1, 6)):
        if inline or depth > 5 or rng.random() < 0.4:
            node.inside.append(word())
            node.inside.append(Node("b"))
            node.inside[-1].inside.append(word())
        else:
            node.inside.append(made(rng, depth + 1))
    return node


def text_of(node):
    for x in node.inside:
        yield from ([x] if not isinstance(x, Node) else text_of(x))


def test_contents_match_a_slow_tree(spark):
    rng = random.Random(3)
    pages, want = [], []
    for i in range(300):
        html = Node("html")
        body = Node("body")
        html.inside.append(body)
        body.inside += [made(rng) for _ in range(rng.randrange(1, 5))]
        root = Node("root")
        root.inside.append(html)
        host = rng.choice(["www.sse.com.cn", "a.szse.cn", "hkex.com.hk", "example.org"])
        pages.append((i, f"https://{host}/x", html.html(rng), "t", "r", 1))

        def plain(n):
            n.inside = [plain(x) if isinstance(x, Node) else x.replace("&amp;", "&") for x in n.inside]
            return n

        want.append(slow_contents(plain(root), host))
    out = page_tree.contents(spark.createDataFrame(pages, PAGES)).orderBy("page_id").collect()
    for r, (text, tables) in zip(out, want):
        blocks = [text] + ["\n".join("：".join(c) if len(c) == 2 else " | ".join(c) for c in ([x for x in row if x] for row in t)) for t in tables]
        assert [t.rows for t in r.tables] == tables, pages[r.page_id][2]
        assert r.text == "\n\n".join(b for b in blocks if b), pages[r.page_id][2]


def one(spark, html, url="https://example.org/"):
    return page_tree.contents(spark.createDataFrame([(1, url, html, "t", "r", 1)], PAGES)).first()


def test_nested_furniture_goes_whole(spark):
    r = one(spark, '<div id=a><div class="sidebar"><div><p>gone</div><p>gone too</div>kept<header><div>gone</div></header></div>')
    assert (r.text, r.warnings) == ("kept", ["no selector", "short"])
    assert one(spark, '<body class="has-sidebar"><p>kept</p></body>').text == "kept"


def test_nested_tables_keep_all_cells(spark):
    r = one(spark, "<div><table><tr><td>a<td>b<table><tr><td>1<td>2</table>after<td>c</table>tail</div>")
    assert [t.asDict(True) for t in r.tables] == [{"index": 0, "n_rows": 2, "n_cols": 5, "rows": [["a", "b 1 2 after", "1", "2", "c"], ["1", "2"]]}]
    assert r.text == "tail\n\na | b 1 2 after | 1 | 2 | c\n1：2"
    layout = one(spark, "<table><tr><td>menu<td><div>words<table><tr><td>x<td>9</table></div></table>")
    assert layout.text == "words\n\nx：9"  # the container lies in a cell, so only tables inside of it count


def test_site_selectors(spark):
    long, short = "long enough " * 12, "short"
    page = lambda a, b: f'<div class="allZoom">{a}</div><div class="x sse_content">{b}</div><div>{"other " * 99}</div>'
    assert one(spark, page(long, long), "http://www.SSE.com.cn/a").text == long.strip()
    assert one(spark, page(short, long), "http://sse.com.cn/a").text == long.strip()
    assert one(spark, page(short, short), "http://sse.com.cn/a").text == ("other " * 99).strip()
    assert one(spark, page(short, short), "http://sse.com.cn/a").warnings == []


def test_broken_pages(spark):
    cases = {
        None: "", "": "", "only text": "only text", "<p>a<p>b<li>c": "a\nb\nc", "<p>x <b>y<p>z": "x\ny\nz", "a < b &lt; c": "a < b < c", "<div>a</span></p></div>b": "a", "<ul><li>a<ul><li>b</ul><li>c</ul>": "a\nb\nc",
        "<b><div>a</b>b</div>c": "a\nb", "<!-- <p>no --><p>yes<!-- open": "yes", "<script>for(i=0;i<n;i++){'</p>'}</script><p>x": "x", '<p title="a>b">c': "c", "<p title='a>b' class=\"menu\">c<p>d": "d", "<title>a<p>b</title>c": "c", "<textarea>a<b</textarea>": "a<b",
        "<svg/><p>x": "x", "<img alt=a><br/>x": "x", "<td>loose</td>": "loose", "<tr><td>loose": "loose", "</div></table>x": "x", "<div><div": "", "x<": "x<", "<dl><dt>a<dd>b<dt>c</dl>": "a\nb\nc", "<nav>a<p>b</nav>c": "c", "<nav>a<div>b</nav>c": "c",
    }
    frame = spark.createDataFrame([(i, None, html, "t", "r", 1) for i, html in enumerate(cases)], PAGES)
    out = page_tree.contents(frame).orderBy("page_id").collect()
    assert [r.text for r in out] == list(cases.values())
    assert page_tree.contents(frame.where("false")).count() == 0
    assert out[0].row == "r" and out[0].tree == 1 and out[0].title == ""


def test_intervals_nest():
    rng = random.Random(1)
    for _ in range(200):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "w", "<nav>", "</nav>"]) for _ in range(60))
        tree = page_tree.parsed(html)
        spans = {e["open"]: e for e in tree["elements"]}
        for e in tree["elements"]:
            assert e["open"] < e["close"]
            if e["parent"] in spans:
                above = spans[e["parent"]]
                assert above["open"] < e["open"] and e["close"] < above["close"] and above["depth"] == e["depth"] - 1
            assert e["chars"] == sum(len(t["text"]) for t in tree["texts"] if e["open"] < t["at"] < e["close"])
            assert e["divisions"] == sum(x["tag"] == "div" and e["open"] < x["open"] < e["close"] for x in tree["elements"])


@pytest.mark.parametrize("part", ["<p ", "<div>", "</div>", '<a href="', "<b>", "<table><tr>", "<", "<!--", "<script>", "<p><b>", "<li>", "x</p>", "<svg/>", "<td>"])
def test_odd_pages_take_linear_time(part):
    start = time.perf_counter()
    page_tree.parsed(part * 50_000)
    assert time.perf_counter() - start < 10


def test_nothing_is_moved(spark):
    plan = rulebook.html_content(spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan
    assert "Exchange" not in page_tree.contents(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
