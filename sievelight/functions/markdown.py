"""HTML to Markdown with the standard parser, as an Arrow UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = {"script", "style", "head", "template", "noscript"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "table", "tr", "form", "figure", "blockquote", "ul", "ol", "dl"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped, self.links, self.lists, self.pre = 0, [], [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIP:
            self.skipped += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            given = dict(attrs)
            self.out.append(f"![{given.get('alt') or ''}]({given.get('src') or ''})")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "li":
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] else "- "))
            if self.lists and self.lists[-1]:
                self.lists[-1] += 1
        elif tag in _BLOCK:
            self.out.append("\n\n")
        if tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else 0)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n\n")
        elif tag in _BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    writer = _Writer()
    writer.feed(html)
    writer.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(writer.out))).strip()


def page_text(body: Column, content_type: Column) -> Column:
    """Markdown of what is HTML by its header or its first character; other bodies as they are."""

    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(to_markdown)

    is_html = F.coalesce(F.contains(F.lower(content_type), F.lit("html")), F.lit(False)) | F.startswith(F.ltrim(body), F.lit("<"))
    return F.when(is_html, F.coalesce(convert(body), body)).otherwise(body)
