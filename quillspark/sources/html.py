"""Stored pages: titles, visible text, addresses and their checks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements left out, and elements whose text is kept.
DROPPED = {"script", "style", "noscript", "nav", "aside", "footer", "header"}
KEPT = {"h1", "h2", "h3", "p", "li", "blockquote", "td", "th", "pre"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "col", "area", "base", "wbr"}


class _Page(HTMLParser):
    """Collects, for each candidate root, the text of kept elements (an element within another gives its text twice) and all text."""

    def __init__(self) -> None:
        super().__init__()
        self.path: list[str] = []
        self.open: list[list] = []
        self.parts: list[tuple[int, set[str], list[str]]] = []
        self.all: list[tuple[set[str], str]] = []
        self.roots: set[str] = set()

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        self.path.append(tag)
        if tag in ("article", "main", "body"):
            self.roots.add(tag)
        if tag in KEPT and not DROPPED & set(self.path):
            part = (len(self.path), set(self.path), [])
            self.parts.append(part)
            self.open.append(part)

    def handle_endtag(self, tag):
        if tag in self.path:
            while self.path:
                t = self.path.pop()
                self.open = [p for p in self.open if p[0] <= len(self.path)]
                if t == tag:
                    break

    def handle_data(self, data):
        if DROPPED & set(self.path):
            return
        self.all.append((set(self.path), data))
        for p in self.open:
            p[2].append(data)


def visible_text(html: str | None) -> str | None:
    """Text of headings, paragraphs, list items and cells of the article, else of main, body or all; blank-line separated."""
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    root = next((r for r in ("article", "main", "body") if r in page.roots), None)
    flat = lambda xs: re.sub(r"\s+", " ", " ".join(xs)).strip()
    parts = [flat(p[2]) for p in page.parts if root is None or root in p[1]]
    parts = [p for p in parts if p]
    return "\n\n".join(parts) if parts else flat([t for path, t in page.all if root is None or root in path])


def _visible(s: pd.Series) -> pd.Series:
    return s.map(visible_text, na_action="ignore")


def visible(col) -> Column:
    """visible_text over a column, in Arrow batches."""
    return F.pandas_udf(_visible, StringType())(col)


def title(html: Column, url: Column) -> Column:
    """The title element, else the first h1, else the address."""
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""), r"\s+", " ")), F.lit(""))
    return F.coalesce(inner("title"), inner("h1"), url)


def valid_url(url: Column) -> Column:
    """Whether an address has scheme http or https and a host."""
    u = F.trim(url)
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & (F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")) != ""), F.lit(False))


def file_name(url: Column, default: str = "document.pdf") -> Column:
    """The last segment of an address's path, decoded, else the default."""
    path = F.try_parse_url(F.trim(url), F.lit("PATH"))
    return F.coalesce(F.nullif(F.trim(F.try_url_decode(F.regexp_extract(path, "([^/]*)$", 1))), F.lit("")), F.lit(default))


def looks_like_pdf(content_type: Column, head: Column, url: Column) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit("")))
    return F.coalesce(F.lower(content_type).startswith("application/pdf"), F.lit(False)) | F.coalesce(head.startswith("%PDF"), F.lit(False)) | path.endswith(".pdf")


def upload_error(size: Column, head: Column, name: Column, most: int) -> Column:
    """The code an upload is refused with, checked in order: 413 too large, 400 not a PDF, 400 another extension; null if it is taken."""
    return F.when(size > most, 413).when(~F.coalesce(head.startswith("%PDF"), F.lit(False)), 400).when(~F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False)), 400)
