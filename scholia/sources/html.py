"""Sections of web pages: a tokeniser of its own, a fold over its tokens, and both as a table function that is joined laterally to a table of pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Tags whose content is left out.
SKIPPED = {"script", "style", "head", "noscript", "template", "svg", "nav", "footer", "aside", "form"}
#: Tags that begin a line.
BLOCKS = {"p", "div", "section", "article", "header", "li", "ul", "ol", "tr", "table", "blockquote", "pre", "figure", "figcaption"}
#: Tags that end a line, where they are written with a slash.
BREAKS = {"br", "hr"}
#: What holds no markup: all up to its end tag is text.
RAW = {"script", "style"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)                                   # comment
      | <[!?][^>]*(?:>|\Z)                                  # declaration
      | <(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)>
    """,
    re.DOTALL | re.VERBOSE,
)


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(kind, value): text; open, close or slash (an open tag that ends in a slash) with the tag's name in small letters."""
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", html.unescape(page[at:])
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()])
        at, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            continue
        yield "close" if m["end"] else "slash" if m["rest"].endswith("/") else "open", tag
        if tag in RAW and not m["end"] and not m["rest"].endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = close.start() if close else len(page)
            if stop > at:
                yield "text", page[at:stop]
            at = stop


def tidy(text: str) -> str:
    """Single spaces, none at lines' ends, one empty line at most between lines, none at the ends."""
    lines = [" ".join(re.split(r"[ \t\r\f\v]+", x)).strip() for x in text.splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def sections(page: str) -> Iterator[tuple[int, int, str | None, str]]:
    """(ord, level, title, text), one section after the other: a section a heading; what precedes the first has no title. A heading's words are in its title and its text; sections of nothing are left out.

    Content of SKIPPED tags is left out by depth, so one that never ends takes the rest; so are titles of pages. Only what BLOCKS, BREAKS and the ends of headings say makes a new line.
    """
    depth, in_heading, in_title, n = 0, False, False, 0
    level, title, text = 1, [], []

    def done() -> tuple[str | None, str] | None:
        name, body = "".join(title).strip() or None, tidy("".join(text))
        return (name, body) if name or body else None

    for kind, value in tokens(page):
        heading = len(value) == 2 and value[0] == "h" and value[1] in "123456" and kind != "text"
        if kind in ("open", "slash") and heading and not depth:
            if found := done():
                yield n, level, *found
                n += 1
            level, title, text, in_heading = int(value[1]), [], [], kind == "open" or in_heading
            if kind == "slash":
                text.append("\n")
                in_heading = False
        elif kind == "text":
            if not depth and not in_title:
                text.append(value)
                if in_heading:
                    title.append(value)
        elif value in SKIPPED:
            depth = max(0, depth + {"open": 1, "close": -1, "slash": 0}[kind])
        elif depth:
            continue
        elif value == "title":
            in_title = kind == "open"
        elif kind == "close":
            if heading:
                in_heading = False
                text.append("\n")
        elif value in BLOCKS and kind == "open" or value in BREAKS and kind == "slash":
            text.append("\n")
    if found := done():
        yield n, level, *found


class HtmlSections:
    """Table function: a page's sections, given out one at a time. A second argument caps their number."""

    @staticmethod
    def analyze(page: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if page.dataType != StringType():
            raise ValueError("the page must be a string")
        if most is not None and not (most.isConstantExpression and (most.value is None or most.value >= 0)):
            raise ValueError("the cap on sections must be a constant, 0 or more")
        return AnalyzeResult(StructType().add("ord", IntegerType()).add("level", IntegerType()).add("title", StringType()).add("text", StringType()))

    def eval(self, page: str, most: int | None = None):
        for row in sections(page or ""):
            if most is not None and row[0] >= most:
                return
            yield row


def html_sections(pages: DataFrame, html_column: str = "html", max_pages: int | None = None) -> DataFrame:
    """pages' other columns with ord, level, title, text of each section; pages without sections, null ones among them, have no rows."""
    split = F.udtf(HtmlSections)
    args = [F.col("_page").outer(), *([F.lit(max_pages)] if max_pages is not None else [])]
    return pages.withColumnRenamed(html_column, "_page").lateralJoin(split(*args)).drop("_page")
