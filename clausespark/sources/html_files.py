"""HTML documents as rows: reading files and flattening pages to ordered elements."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import text as X

ELEMENT_SCHEMA = (
    "doc_id {key}, pos int, tag string, classes array<string>, id string, src string, text string, spaced string, has_img boolean, "
    "parent_anchor string, label string, context string, html string, "
    "cells array<struct<row:int,is_header:boolean,text:string,row_span:int,col_span:int>>"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
_SPACE = re.compile(r"\s+")
_TABLE_NO = (re.compile(K.TABLE_LABEL_A, re.I), re.compile(K.TABLE_LABEL_B, re.I))
_APPENDIX_NO = re.compile(K.APPENDIX_REF, re.I)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and repaired text; undecodable bytes are dropped."""
    return _decoded(spark.read.format("binaryFile").load(path))


def read_page_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files as the same rows as ``read_pages``."""
    return _decoded(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path))


def _decoded(files: DataFrame) -> DataFrame:
    raw = files.select(F.col("path").alias("doc_id"), "content")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return raw.select("doc_id", X.repair_mojibake(text).alias("html"))


class _Node:
    """An element. Everything below it is a slice of the page's lists of elements and of strings.

    ``hidden`` counts the script-like elements around it; strings of its own level of hiding are its text.
    ``anchor`` and ``block`` are the nearest enclosing a and div.
    """

    __slots__ = ("page", "tag", "attrs", "parent", "start", "end", "index", "last", "first_string", "last_string", "hidden", "anchor", "block", "elements", "place", "divs", "div_place", "text")

    def __init__(self, page: "_Page", tag: str, attrs: dict, parent: "_Node | None", start: int):
        self.page, self.tag, self.attrs, self.parent, self.start, self.end = page, tag, attrs, parent, start, None
        self.index, self.last, self.first_string, self.last_string = len(page.elements), None, len(page.strings), None
        self.elements, self.divs, self.text = [], [], None
        self.hidden = self.place = self.div_place = 0
        self.anchor = self.block = None
        if parent is not None:
            self.hidden = parent.hidden + (tag in _SILENT)
            self.anchor = parent if parent.tag == "a" else parent.anchor
            self.block = parent if parent.tag == "div" else parent.block
            self.place, self.div_place = len(parent.elements), len(parent.divs)
            parent.elements.append(self)
            if tag == "div":
                parent.divs.append(self)

    def close(self) -> None:
        self.last, self.last_string = len(self.page.elements), len(self.page.strings)

    def walk(self) -> list["_Node"]:
        """All elements below, in document order."""
        return self.page.elements[self.index + 1 : self.last]

    def strings(self) -> list[str]:
        return [s for hidden, s in self.page.strings[self.first_string : self.last_string] if hidden == self.hidden]

    def spaced(self) -> str:
        if self.text is None:
            self.text = _clean(" ".join(s.strip() for s in self.strings() if s.strip()))
        return self.text

    def has_image(self) -> bool:
        return self.page.images[self.last] > self.page.images[self.index + 1]


class _Page(HTMLParser):
    """Elements and strings of a page in document order; no step depends on depth or on the number of siblings."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Node] = []
        self.strings: list[tuple[int, str]] = []
        self.open: Counter[str] = Counter()
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.root = self.top = _Node(self, "", {}, None, 0)
        self.elements.append(self.root)
        self.feed(html)
        self.close()
        while self.top is not None:
            self._leave()
        self.images = [0]
        for n in self.elements:
            self.images.append(self.images[-1] + (n.tag == "img"))

    def _at(self) -> int:
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def _leave(self) -> None:
        self.top.close()
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def handle_starttag(self, tag, attrs):
        node = _Node(self, tag, dict(attrs), self.top, self._at())
        self.elements.append(node)
        if tag in _VOID:
            node.close()
        else:
            self.open[tag] += 1
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open[tag] <= 0:
            return
        while self.top.tag != tag:
            self._leave()
        self.top.end = self._at() + len(tag) + 3
        self._leave()

    def handle_data(self, data):
        self.strings.append((self.top.hidden, data))


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def _classes(node: _Node) -> list[str]:
    return (node.attrs.get("class") or "").split()


def _label(table: _Node) -> str:
    """Caption, else the nearest of four earlier siblings that speaks of a table or an appendix."""
    for c in table.walk():
        if c.tag == "caption":
            if c.spaced():
                return c.spaced()
            break
    for mate in reversed(table.parent.elements[max(0, table.place - 4) : table.place]):
        text, classes = mate.spaced(), {c.upper() for c in _classes(mate)}
        titled = "ACT_TITLE_APPL" in classes or any(c.startswith("APPL_BANNER") for c in classes)
        named = "jadval" in text.lower() or any(r.search(text) for r in _TABLE_NO) or _APPENDIX_NO.search(text)
        if text and (titled or named):
            return text
    return ""


def _context(img: _Node) -> str:
    """Up to three distinct texts around an image: its block, three blocks before, two after."""
    block = img.block
    if block is None:
        return ""
    divs, at = block.parent.divs, block.div_place
    near = [block, *reversed(divs[max(0, at - 3) : at]), *divs[at + 1 : at + 3]]
    out: dict[str, str] = {}
    for node in near:
        text = "" if node.has_image() else node.spaced()
        if not text or text.lower().startswith(("http://", "https://")):
            continue
        out.setdefault(text[:220].lower(), text[:220])
    return " | ".join(list(out.values())[:3])


def _span(value: str | None) -> int:
    try:
        return max(int(value or 1), 1) if int(value or 1) > 0 else 1
    except ValueError:
        return 1


def _cells(table: _Node) -> list[dict]:
    out, row = [], 0
    for tr in table.walk():
        if tr.tag != "tr":
            continue
        cells = [c for c in tr.walk() if c.tag in ("th", "td")]
        row += bool(cells)
        for c in cells:
            out.append(
                {
                    "row": row, "is_header": c.tag == "th", "text": c.spaced(),
                    "row_span": _span(c.attrs.get("rowspan")), "col_span": _span(c.attrs.get("colspan")),
                }
            )
    return out


class Element(NamedTuple):
    """A div, a, table or img of a page; the fields of ``ELEMENT_SCHEMA``."""

    doc_id: object
    pos: int
    tag: str
    classes: list[str]
    id: str | None
    src: str | None
    text: str
    spaced: str
    has_img: bool
    parent_anchor: str | None
    label: str | None
    context: str | None
    html: str | None
    cells: list[dict] | None


def names_appendix(text: str | None) -> bool:
    return bool(_APPENDIX_NO.search(text or ""))


def names_table(text: str | None) -> bool:
    return any(r.search(text or "") for r in _TABLE_NO)


def elements(doc_id, html: str) -> Iterator[Element]:
    pos = 0
    for n in _Page(html).root.walk():
        if n.tag not in ("div", "a", "table", "img"):
            continue
        pos += 1
        table = n.tag == "table"
        yield Element(
            doc_id, pos, n.tag, _classes(n), n.attrs.get("id"), _clean(n.attrs.get("src") or "") or None,
            _clean("".join(n.strings())), n.spaced(), n.has_image(),
            n.anchor.attrs.get("id") if n.anchor is not None else None,
            _label(n) if table else None, _context(n) if n.tag == "img" else None,
            html[n.start : n.end] if table else None, _cells(n) if table else None,
        )


def flatten(pages: DataFrame) -> DataFrame:
    """Ordered div, a, table and img elements of every page (doc_id, html); pages are parsed one by one."""
    schema = ELEMENT_SCHEMA.format(key=pages.schema["doc_id"].dataType.simpleString())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for doc_id, html in zip(frame["doc_id"], frame["html"]):
                rows = list(elements(doc_id, html or ""))
                if rows:
                    yield pd.DataFrame(rows, columns=Element._fields)

    return pages.select("doc_id", "html").mapInPandas(parse, schema)
