"""Title, text, tables and links of HTML by built-in regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegrid.functions.text import rendered_rows, strip, text_or_empty

# Elements that never hold content, and names of page furniture.
DROPPED = ("script", "style", "noscript", "template", "nav", "footer", "header", "form", "aside", "iframe")
FURNITURE = "ad|ads|advert|banner|breadcrumb|comment|cookie|footer|menu|nav|pagination|related|share|sidebar"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def without(html: Column, *tags: str) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", " ")
    return html


def unescaped(x: Column) -> Column:
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def plain(html: Column) -> Column:
    """Text without tags, blanks run together."""
    return strip(F.regexp_replace(unescaped(F.regexp_replace(html, "(?s)<[^>]*>", " ")), r"(?U)\s+", " "))


def title(html: Column) -> Column:
    return plain(F.regexp_extract(text_or_empty(html), "(?is)<title[^>]*>(.*?)</title>", 1))


def paragraphs(html: Column) -> Column:
    """Texts of headings, paragraphs, list items and cells of a page without its furniture, in order."""
    body = without(F.regexp_replace(text_or_empty(html), "(?s)<!--.*?-->", " "), *DROPPED)
    body = F.regexp_replace(body, f"(?is)<div\\b[^>]*\\b(?:class|id)\\s*=\\s*[\"'][^\"']*\\b(?:{FURNITURE})\\b[^\"']*[\"'][^>]*>[^<]*</div>", " ")
    parts = F.split(F.regexp_replace(body, "(?is)<head\\b.*?</head>", " "), r"(?i)</?(?:p|h[1-6]|li|td|th|tr|div|article|section|ul|ol|table|blockquote|body|html|main)\b[^>]*>", -1)
    return F.filter(F.transform(parts, plain), lambda p: p != "")


def tables(html: Column) -> Column:
    """Cells of each table: arrays of rows of texts."""
    found = F.regexp_extract_all(text_or_empty(html), F.lit("(?is)<table\\b[^>]*>(.*?)</table>"), F.lit(1))
    rows = lambda t: F.regexp_extract_all(t, F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain)
    return F.transform(found, lambda t: F.transform(rows(t), cells))


def text_with_tables(html: Column) -> Column:
    """Paragraphs of the page without its tables, then the tables as lines."""
    body = F.array_join(paragraphs(without(text_or_empty(html), "table")), "\n")
    lines = F.array_join(F.transform(tables(html), rendered_rows), "\n\n")
    return F.concat_ws("\n\n", F.nullif(body, F.lit("")), F.nullif(lines, F.lit("")))
