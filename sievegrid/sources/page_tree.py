"""The content of a page: an element tree as nested intervals, furniture dropped whole, one container chosen.

One fold over a page's tags numbers what opens, closes and is written, so an element is an interval of these numbers that
holds those of all elements and texts inside it. Choosing and cutting are comparisons of intervals by built-in array
functions; no page is parsed twice and none is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievegrid.functions.text import INVISIBLE, clean_text, close_cjk_gaps, host_of, is_chinese, is_question_title, normal_blanks, rendered_rows, trim_boilerplate

# Elements and names (parts of a class or id) of page furniture.
DROPPED_TAGS = ("script", "style", "noscript", "nav", "header", "footer", "iframe", "svg", "form", "button")
DROPPED_NAMES = ("nav", "menu", "breadcrumb", "sidebar", "footer", "header", "banner", "share", "related", "copyright", "search", "toolbar", "pagination")
# Where the sites of the rulebooks keep their content, in order of trial: tag, classes, id.
SELECTORS = {
    "sse.com.cn": (("div", ("allZoom",), None), ("div", ("article_opt",), None), ("div", ("sse_content",), None)),
    "cffex.com.cn": (("div", ("content", "news_content", "allcontent"), None), ("div", ("allcontent",), None), ("div", ("show_main",), None)),
    "szse.cn": (("div", ("des-content",), None), ("div", ("article-content",), None), ("div", (), "desContent")),
    "rulebook.sgx.com": (("div", ("rulebook-content",), None), ("main", (), None), ("article", (), None), ("div", (), "content")),
    "hkex.com.hk": (("div", ("content",), None), ("main", (), None)),
    "investor.gov": (("div", ("field--name-body",), None), ("article", (), None), ("main", (), None)),
}
CONTAINERS = ("div", "article", "section", "main")
# A chosen element's least text, its most nested divisions where no selector fits, texts that are too short, and what surrounds an article inside its container.
LEAST_CHARS, MOST_DIVISIONS, SHORT, SHORT_ANSWER = 100, 8, 50, 15
LEAD_MARKERS = ("微信二维码", "分享：", "分享:")
TAIL_MARKERS = ("上一篇：", "上一篇:", "下一篇：", "下一篇:", "打印本页", "关闭窗口")
BREADCRUMB = r"(?U)^(?:首页|Home)$|^[\s>]+$"

# Of the HTML standard: elements without content, elements of raw text, and which open elements an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ROWS, _CELLS = frozenset(("tbody", "thead", "tfoot")), frozenset(("td", "th"))
_ENDS = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "td": _CELLS, "th": _CELLS, "tr": _CELLS | {"tr"}} | dict.fromkeys(_ROWS, _CELLS | _ROWS | {"tr"})
_WALLS = {"li": frozenset(("ul", "ol", "menu", "table", "td", "th")), "dt": frozenset(("dl", "table", "td", "th")), "dd": frozenset(("dl", "table", "td", "th")), "option": frozenset(("select",)), "p": frozenset(("table", "td", "th", "caption", "button", "object"))}
_TABLE = frozenset(("table",))

_MARK = re.compile(r"<(?:!--|[!?]|/?[A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|=)""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}

_AT_ONCE = 64
#: Tables in a table that have rows of their own; the cells of deeper ones are texts of the cell round them.
MOST_NESTED = 8

TREE = "struct<title string, elements array<struct<tag string, names array<string>, id string, open int, close int, depth int, parent int, chars int, divisions int>>, texts array<struct<at int, text string, in_table int>>, tables array<struct<open int, close int, in_table int, rows array<array<string>>>>>"
_ARROW = pa.struct([
    ("title", pa.string()),
    ("elements", pa.list_(pa.struct([("tag", pa.string()), ("names", pa.list_(pa.string())), ("id", pa.string()), *((x, pa.int32()) for x in ("open", "close", "depth", "parent", "chars", "divisions"))]))),
    ("texts", pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string()), ("in_table", pa.int32())]))),
    ("tables", pa.list_(pa.struct([("open", pa.int32()), ("close", pa.int32()), ("in_table", pa.int32()), ("rows", pa.list_(pa.list_(pa.string())))]))),
])


class _Fold:
    """The state of one page: open elements, and what has been closed. Inside of furniture only tags are followed."""

    def __init__(self) -> None:
        self.now, self.chars, self.divisions, self.hidden, self.flat = 0, 0, 0, 0, 0
        self.stack: list[dict] = []
        self.open: dict[str, int] = {}
        self.elements: list[dict] = []
        self.texts: list[dict] = []
        self.tables: list[dict] = []
        self.open_tables: list[dict] = []
        self.rows: list[list[list[str]]] = []
        self.cells: list[list[str]] = []
        self.title: str | None = None

    def start(self, tag: str, names: list[str], own_id: str | None) -> None:
        if tag in _ENDS:
            self._close_to(_ENDS[tag], _WALLS.get(tag, _TABLE), furthest=True)
        if tag in BLOCK:
            self._close_to(frozenset(("p",)), _WALLS["p"])
        held = {"tag": tag, "names": names, "id": own_id, "open": self.now, "close": 0, "depth": len(self.stack), "parent": self.stack[-1]["open"] if self.stack else -1, "chars": self.chars, "divisions": self.divisions + (tag == "div")}
        self.now += 1
        if tag in VOID:
            return
        called = f"{' '.join(names)} {own_id or ''}".lower()
        self.hidden += bool(self.hidden or tag in DROPPED_TAGS or (tag not in ("html", "body") and any(x in called for x in DROPPED_NAMES)))
        self.stack.append(held)
        self.open[tag] = self.open.get(tag, 0) + 1
        if self.hidden:
            return
        self.elements.append(held)
        self.divisions += tag == "div"
        if tag == "table" and len(self.open_tables) == MOST_NESTED:
            self.flat += 1
        elif self.flat:
            return
        elif tag == "table":
            self.open_tables.append({"open": held["open"], "close": 0, "in_table": self._table(), "rows": []})
            self.tables.append(self.open_tables[-1])
        elif tag == "tr":
            self.rows.append([])
            for table in self.open_tables:
                table["rows"].append(self.rows[-1])
        elif tag in _CELLS:
            self.cells.append([])
            for row in self.rows:
                row.append(self.cells[-1])

    def _table(self) -> int:
        return self.open_tables[-1]["open"] if self.open_tables else -1

    def end(self, tag: str) -> None:
        if tag in BLOCK or tag in RAW:
            self._close_to(frozenset((tag,)), _TABLE if tag in _CELLS | _ROWS | {"tr", "table", "caption"} else _CELLS)
        else:
            self._close_to(frozenset((tag,)), BLOCK)

    def _close_to(self, tags: frozenset[str], walls: frozenset[str], furthest: bool = False) -> None:
        """Closes the nearest, or furthest, open element of ``tags`` that no element of ``walls`` stands before."""
        if not any(self.open.get(t) for t in tags):
            return
        found = None
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at]["tag"]
            if tag in tags:
                found = at
                if not furthest:
                    break
            elif tag in walls:
                break
        while found is not None and len(self.stack) > found:
            self._pop()

    def _pop(self) -> None:
        held = self.stack.pop()
        self.open[held["tag"]] -= 1
        if self.hidden:
            self.hidden -= 1
            self.now += 1
            return
        held.update(close=self.now, chars=self.chars - held["chars"], divisions=self.divisions - held["divisions"])
        if held["tag"] == "table" and self.flat:
            self.flat -= 1
        elif self.flat:
            pass
        elif held["tag"] == "table":
            self.open_tables.pop()["close"] = self.now
        elif held["tag"] == "tr":
            self.rows.pop()
        elif held["tag"] in _CELLS:
            self.cells.pop()
        self.now += 1

    def text(self, raw: str) -> None:
        text = unescape(raw).strip()
        if text and not self.hidden:
            self.texts.append({"at": self.now, "text": text, "in_table": self._table()})
            self.chars += len(text)
            for cell in self.cells:
                cell.append(text)
        self.now += 1

    def tree(self) -> dict:
        while self.stack:
            self._pop()
        tables = [{"open": t["open"], "close": t["close"], "in_table": t["in_table"], "rows": [[" ".join(cell) for cell in row] for row in t["rows"]]} for t in self.tables]
        return {"title": self.title or "", "elements": self.elements, "texts": self.texts, "tables": tables}


def parsed(html: str) -> dict:
    """The tree of a page, in one pass over it."""
    fold, at = _Fold(), 0
    while at < len(html):
        mark = _MARK.search(html, at)
        if mark is None:
            fold.text(html[at:])
            break
        if mark.start() > at:
            fold.text(html[at : mark.start()])
        head = mark.group()
        if head in ("<!--", "<!", "<?"):
            stop = html.find("-->" if head == "<!--" else ">", mark.end())
            at = len(html) if stop < 0 else stop + (3 if head == "<!--" else 1)
            continue
        at, names, own_id = mark.end(), [], None
        while at < len(html) and (found := _ATTRIBUTE.match(html, at)):
            at = found.end()
            name = (found[1] or "").lower()
            if name in ("class", "id"):
                value = unescape(next((x for x in found.groups()[1:] if x is not None), ""))
                names, own_id = (value.split(), own_id) if name == "class" and not names else (names, value if name == "id" and own_id is None else own_id)
        stop = html.find(">", at)
        at = len(html) if stop < 0 else stop + 1
        tag = head.lstrip("</").lower()
        if head.startswith("</"):
            fold.end(tag)
            continue
        fold.start(tag, names, own_id)
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            stop = close.start() if close else len(html)
            if tag == "title":
                fold.title = unescape(html[at:stop]).strip() if fold.title is None else fold.title
            elif tag in ("textarea", "xmp"):
                fold.text(html[at:stop])
            at = stop
        elif tag == "svg" and html.endswith("/>", 0, at):
            fold.end(tag)
    return fold.tree()


def with_tree(rows: DataFrame, html: str) -> DataFrame:
    """The given columns but ``html``, and the tree of each page; null and empty pages have an empty one."""
    rest = [c for c in rows.columns if c not in (html, "tree")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(start, _AT_ONCE) for batch in batches for start in range(0, batch.num_rows, _AT_ONCE)):
            trees = pa.array([parsed(x.as_py() or "") for x in part.column(len(rest))], _ARROW)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], trees], names=[*rest, "tree"])

    kinds = rows.select(*rest).schema
    return rows.select(*rest, html).mapInArrow(each, StructType([*kinds, *StructType.fromDDL(f"tree {TREE}")]))


def _first(elements: Column, tag: str, classes: tuple[str, ...], own_id: str | None) -> Column:
    """The first element in page order that a selector fits, null if none does."""

    def fits(e: Column) -> Column:
        out = e["tag"] == tag
        for c in classes:
            out = out & F.array_contains(e["names"], c)
        return out if own_id is None else out & e["id"].eqNullSafe(F.lit(own_id))

    return F.get(F.filter(elements, fits), F.lit(0))


def _span(e: Column) -> Column:
    return F.when(e.isNotNull(), F.struct(e["open"].alias("open"), e["close"].alias("close")))


def chosen(elements: Column, host: Column, selectors: dict = SELECTORS) -> Column:
    """(open, close) of a page's content.

    The first selector of the host's site whose first element has over ``LEAST_CHARS`` characters; else the container of
    most text, the first of equals, among those with ``MOST_DIVISIONS`` nested divisions at most; else the body, or all.
    """
    of_site = F.lit(None)
    for site, own in reversed(selectors.items()):
        tried = [_first(elements, *s) for s in own]
        best = F.coalesce(*[_span(F.when(e["chars"] > LEAST_CHARS, e)) for e in tried])
        of_site = F.when(F.contains(host, F.lit(site)), best).otherwise(of_site)
    held = F.filter(elements, lambda e: e["tag"].isin(*CONTAINERS) & (e["divisions"] <= MOST_DIVISIONS) & (e["chars"] > 0))
    most = F.array_max(F.transform(held, lambda e: F.struct(e["chars"].alias("chars"), (-e["open"]).alias("back"), e["close"].alias("close"))))
    longest = F.when(most.isNotNull(), F.struct((-most["back"]).alias("open"), most["close"].alias("close")))
    everything = F.struct(F.lit(-1).alias("open"), F.lit(2**31 - 1).alias("close"))
    return F.coalesce(of_site, longest, _span(_first(elements, "body", (), None)), everything)


def without_breadcrumbs(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~F.trim(line).rlike(BREADCRUMB)), "\n")


def cleaned_cell(x: Column) -> Column:
    """As other texts, but a number alone is no page number here."""
    return normal_blanks(close_cjk_gaps(F.regexp_replace(x, INVISIBLE, "")))


def contents(pages: DataFrame, html: str = "html", url: str = "url", selectors: dict = SELECTORS) -> DataFrame:
    """The given columns but the page itself, with title, text, lang, tables (index, n_rows, n_cols, rows) and warnings.

    Each written piece of the content is a line; its outermost tables are taken out and follow as lines of cells. A row or a cell of a
    nested table is also one of the tables round it, so no cell is lost; from the ninth level on cells are texts of the cell round
    them. Given columns of these names are replaced.

    Defined results: a null or empty page has an empty text and the warning ``short``; a null URL has no site; pages without
    any tag are one text; unclosed elements end with the page; repeated rows give equal rows.
    """
    made = ("title", "text", "lang", "tables", "warnings")
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns if c not in (*made, html)]).alias("row"), host_of(pages[url]).alias("host"), pages[html].alias("html"))
    rows = with_tree(rows, "html").select("row", "host", "tree.title", "tree.texts", "tree.tables", chosen(F.col("tree.elements"), F.col("host"), selectors).alias("span"))
    low, high = F.col("span.open"), F.col("span.close")
    texts = F.filter("texts", lambda t: (t["at"] > low) & (t["at"] < high) & (t["in_table"] <= low))
    outer = F.filter("tables", lambda t: (t["open"] > low) & (t["close"] < high) & (t["in_table"] <= low))
    cleaned = F.transform(outer, lambda t: F.filter(F.transform(t["rows"], lambda r: F.transform(r, cleaned_cell)), lambda r: F.exists(r, lambda c: c != "")))
    rows = rows.select("row", "host", clean_text(F.col("title")).alias("title"), F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("body"), cleaned.alias("cells"))
    numbered = F.transform("cells", lambda r, i: F.struct(i.alias("index"), F.size(r).alias("n_rows"), F.array_max(F.transform(r, lambda c: F.size(c))).alias("n_cols"), r.alias("rows")))
    chinese = is_chinese(F.coalesce(F.nullif("body", F.lit("")), "title"))
    rows = rows.select("row", "host", "title", F.when(chinese, clean_text(F.col("body"))).otherwise(clean_text(F.col("body"), cjk=False)).alias("body"), chinese.alias("chinese"), F.filter(numbered, lambda t: t["n_rows"] > 0).alias("tables"))
    body = F.trim(without_breadcrumbs(trim_boilerplate(F.col("body"), TAIL_MARKERS, LEAD_MARKERS)), F.lit(" \n"))
    parts = F.filter(F.concat(F.array(body), F.transform("tables", lambda t: rendered_rows(t["rows"]))), lambda x: x != "")
    rows = rows.select("row", "host", "title", F.array_join(parts, "\n\n").alias("text"), "chinese", "tables")
    least = F.when(is_question_title(F.col("title")), SHORT_ANSWER).otherwise(SHORT)
    known = F.lit(False)
    for site in selectors:
        known = known | F.contains("host", F.lit(site))
    warnings = F.filter(F.array(F.when((F.col("host") != "") & ~known, "no selector"), F.when(F.char_length("text") < least, "short")), lambda x: x.isNotNull())
    return rows.select("row.*", "title", "text", F.when(F.col("chinese"), "zh").otherwise("en").alias("lang"), "tables", warnings.alias("warnings"))
