"""Rendered pages to documents: title, summary, basic information, sections and images.

Spark has no HTML parser, so a page's markup is read by the standard library's, in Python; what is done with
the parts is column expressions or plain functions on them. A page that asks for a security check has none.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from graphloom.functions.plain import clean_text
from graphloom.schema import SECTION

# Names in the pages' markup.
SUMMARY_CLASS, SUMMARY_MODULE = "lemma-summary", "lemmaSummary"
HEADING_TAGS, HEADING_CLASS, HEADING_PART = {"h2", "h3", "h4"}, "para-title", "title"
PARAGRAPH_CLASS = "para"
INFO_NAME, INFO_VALUE = {"basicInfo-item", "name"}, {"basicInfo-item", "value"}
SECURITY = ("百度安全验证", "seccaptcha")
COLONS = ":： "
IMAGES = 12
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNREAD = {"script", "style", "template"}
#: A character reference, or an ampersand that opens none: a reference ends in a semicolon.
REFERENCE = re.compile("&((?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)?")

PARTS = T.StructType(
    [
        T.StructField("page_title", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("basic_info", T.MapType(T.StringType(), T.StringType())),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("heading", T.BooleanType()), T.StructField("text", T.StringType())]))),
        T.StructField("images", T.ArrayType(T.StringType())),
    ]
)


def is_summary(classes: list[str], attributes: dict[str, str]) -> bool:
    return SUMMARY_CLASS in classes or attributes.get("label-module") == SUMMARY_MODULE


def is_heading(tag: str, classes: list[str]) -> bool:
    return tag in HEADING_TAGS or HEADING_CLASS in classes or any(HEADING_PART in c for c in classes)


def is_paragraph(tag: str, classes: list[str]) -> bool:
    return tag == "p" or PARAGRAPH_CLASS in classes


class Parts(HTMLParser):
    """Collects the texts of the elements that matter, in the order in which they open."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.meta, self.images, self.within_summary = "", [], 0
        self.summaries: list[bool] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        attributes = {k: v or "" for k, v in attrs}
        classes = attributes.get("class", "").split()
        if tag == "meta" and attributes.get("name") == "description" and not self.meta:
            self.meta = attributes.get("content", "")
        if tag == "img" and (address := attributes.get("data-src") or attributes.get("src")):
            self.images.append(address)
        if tag in VOID:
            return
        summary, role = is_summary(classes, attributes), None
        if tag in ("title", "h1"):
            role = tag
        elif summary:
            role = "summary"
        elif tag == "dt" and INFO_NAME <= set(classes):
            role = "name"
        elif tag == "dd" and INFO_VALUE <= set(classes):
            role = "value"
        elif not self.within_summary and is_heading(tag, classes):
            role = "heading"
        elif not self.within_summary and is_paragraph(tag, classes):
            role = "paragraph"
        texts: list[str] | None = None
        if role:
            texts = []
            self.found.append((role, texts))
        self.open.append((tag, texts))
        self.summaries.append(summary)
        self.within_summary += summary

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _ in self.open):
            while self.open:
                name, _ = self.open.pop()
                self.within_summary -= self.summaries.pop()
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not any(name in UNREAD for name, _ in self.open):
            for _, texts in self.open:
                if texts is not None:
                    texts.append(text)


def bare_ampersands(page: str) -> str:
    """The page with each ampersand that opens no reference as one, so that the parser reads it as it stands."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", page)


def parts(page: str | None, url: str | None = None) -> dict:
    """The parts of a page; image addresses are made absolute by ``url``. A null page has none.

    The parser decodes references, once.
    """
    parser = Parts()
    parser.feed(bare_ampersands(page or ""))
    parser.close()
    clean = lambda text: clean_text(text, decoded=True)
    of = lambda role, between="\n": [clean(between.join(texts)) for r, texts in parser.found if r == role]
    first = lambda found: next(iter(found), "")
    info = {k.strip(COLONS): v for k, v in zip(of("name", ""), of("value", "")) if k.strip(COLONS) and v}
    lines = [{"heading": r == "heading", "text": clean(("" if r == "heading" else "\n").join(t))} for r, t in parser.found if r in ("heading", "paragraph")]
    images = [urljoin(url or "", f"https:{i}" if i.startswith("//") else i) for i in parser.images if not i.startswith("data:")]
    return {
        "page_title": first(of("title", "")),
        "title": first(of("h1", "")),
        "summary": first(of("summary")) or clean(parser.meta),
        "basic_info": info,
        "lines": [x for x in lines if x["text"]],
        "images": list(dict.fromkeys(images))[:IMAGES],
    }


#: ``parts`` of a column of pages, some at a time: an Arrow batch would hold 10,000 pages and their parts at once.
page_parts = F.udf(parts, PARTS, useArrow=False)


def is_security_page(title: Column, html: Column) -> Column:
    return F.contains(title, F.lit(SECURITY[0])) | F.contains(html, F.lit(SECURITY[0])) | F.contains(html, F.lit(SECURITY[1]))


@pandas_udf(T.StringType())
def quoted(text: pd.Series) -> pd.Series:
    """Percent-coded for a path; Spark's own function writes a blank as a plus sign."""
    return text.map(lambda t: None if t is None else quote(t))


@pandas_udf(T.StringType())
def joined_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else urljoin(b or "", x) for b, x in zip(base, link)])


def sections(lines: Column, default: str) -> Column:
    """Sections of a page's lines: each heading opens one, paragraphs before the first go to ``default``; those without content go."""
    section = F.struct(F.lit(default).alias("heading"), F.lit("").alias("content"))

    def step(state: Column, line: Column) -> Column:
        last = F.element_at(state, -1)
        grown = F.struct(last["heading"].alias("heading"), F.concat(last["content"], F.when(last["content"] == "", "").otherwise("\n"), line["text"]).alias("content"))
        opened = F.concat(state, F.array(F.struct(F.btrim(line["text"], F.lit(COLONS)).alias("heading"), F.lit("").alias("content"))))
        return F.when(line["heading"], opened).otherwise(F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(grown)))

    whole = F.aggregate(lines, F.array(section).cast(T.ArrayType(SECTION)), step)
    return F.filter(whole, lambda s: s["content"] != "")


def document(keyword: Column, page: Column, url: Column, default: str) -> Column:
    """The document of a page (a struct), or null for a page that asks for a security check."""
    p = page_parts(page, url)
    made = F.struct(
        keyword.alias("keyword"),
        F.coalesce(F.nullif(p["title"], F.lit("")), keyword).alias("title"),
        url.alias("source_url"),
        p["summary"].alias("summary"),
        p["basic_info"].alias("basic_info"),
        sections(p["lines"], default).alias("sections"),
        p["images"].alias("images"),
        F.lit("html").alias("content_source"),
    )
    return F.when(~is_security_page(p["page_title"], page), made)
