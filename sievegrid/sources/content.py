"""Checks, decoding and link extraction of fetched files (columns of the binaryFile source)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from sievegrid.functions.text import host_of, strip, text_or_empty
from sievegrid.operators.dedup import first_by

# How the accepted formats announce themselves, and the length of a known block page.
TYPES = {"pdf": ("application/pdf", "application/octet-stream"), "html": ("text/html", "application/xhtml"), "doc": ("application/msword", "application/octet-stream"), "docx": ("application/vnd", "application/octet-stream", "application/zip")}
MAGIC = {"pdf": "25504446", "doc": "D0CF11E0", "docx": "504B0304"}
BLOCKED_LENGTHS = (10648,)
LEAST_HTML = 512


def rejection(content: Column, content_type: Column, expect: Column) -> Column:
    """Why a body isn't what was asked for, null if it is; the first reason in order counts."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    kind = F.lower(text_or_empty(content_type))
    reason = F.when(size == 0, "empty").when(size.isin(*BLOCKED_LENGTHS), "blocked")
    for fmt, starts in TYPES.items():
        fits = F.lit(False)
        for s in starts:
            fits = fits | F.startswith(kind, F.lit(s))
        reason = reason.when((expect == fmt) & (kind != "") & ~fits, "content_type")
    head = F.hex(F.substring(content, 1, 1024))
    for fmt, magic in MAGIC.items():
        reason = reason.when((expect == fmt) & ~F.contains(head, F.lit(magic)), "magic")
    return reason.when((expect == "html") & (size < LEAST_HTML), "too_short")


@pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes: the first of UTF-8, GB18030 and GBK that reads them, else UTF-8 with replacements.

    Spark decodes neither of the Chinese encodings, hence an Arrow UDF.
    """

    def one(b):
        if b is None:
            return None
        for name in ("utf-8", "gb18030", "gbk"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                pass
        return bytes(b).decode("utf-8", "replace")

    return content.map(one)


def links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """(base, url, title, ord): absolute links of each page, the first of each address kept."""
    found = F.regexp_extract_all(text_or_empty(F.col(html)), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"'#][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(F.col(base).alias("base"), F.posexplode(found).alias("ord", "anchor"))
    href = F.regexp_extract("anchor", r"(?is)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)
    root = F.regexp_extract("base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace("base", "[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    scheme = F.regexp_extract("base", "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    url = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))
    title = strip(F.regexp_replace(F.regexp_replace("anchor", "(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    return first_by(rows.select("base", url.alias("url"), title.alias("title"), "ord"), ["base", "url"], ["ord"])


def same_site(found: DataFrame) -> DataFrame:
    return found.where(host_of(F.col("url")) == host_of(F.col("base")))
