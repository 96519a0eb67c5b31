"""HTML to text, fields and links, parsed with the standard library in Arrow batches."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analyzer import small_batches

SKIPPED = frozenset(("script", "style", "select"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Links to such files are not followed.
BINARY = tuple(".jpg .jpeg .png .gif .svg .ico .css .js .zip .gz .rar .exe .mp3 .mp4 .avi .mov .doc .docx .xls .xlsx .ppt .pptx".split())
_CDATA = re.compile(r"<!\[cdata\[(.*?)\]\]>", re.IGNORECASE | re.DOTALL)


class _Text(HTMLParser):
    """Collects text outside dropped elements, and chosen attributes."""

    def __init__(self, dropped: frozenset[str], attrs: frozenset[tuple[str, str]]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.wanted = dropped, attrs
        self.depth = 0
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        for name, value in attrs:
            if value and (tag, name) in self.wanted:
                self.parts.append(" " + re.sub(r"https?://|ftp://|\.", " ", value) + " ")
        if tag in self.dropped and tag not in _VOID:
            self.depth += 1
        self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.dropped and tag not in _VOID:
            self.depth -= 1

    def handle_endtag(self, tag):
        if tag in self.dropped and self.depth:
            self.depth -= 1
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def text_of(source: str, dropped: tuple[str, ...] = (), attrs: tuple[str, ...] = ()) -> str:
    """Text of an HTML fragment without the dropped elements; ``attrs`` are element=attribute pairs to keep."""
    if "cdata" in dropped:
        source = _CDATA.sub(" ", source)
    p = _Text(frozenset(dropped), frozenset(tuple(a.split("=", 1)) for a in attrs))
    p.feed(source)
    p.close()
    return "".join(p.parts)


def to_text(source: Column, dropped: tuple[str, ...] = (), attrs: tuple[str, ...] = ()) -> Column:
    """text_of as a Column."""
    small_batches(SparkSession.active())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: text_of(x, dropped, attrs), na_action="ignore")

    return run(source)


def strip_tags(source: Column) -> Column:
    """Tags removed after a blank is set on their outer side; in the JVM."""
    spaced = F.replace(F.replace(source, F.lit("<"), F.lit(" <")), F.lit(">"), F.lit("> "))
    return F.regexp_replace(spaced, "<[^>]*>", "")


#: Attribute of any element that names the category of its page.
CATEGORY = "data-category"


class _Page(HTMLParser):
    """Title, text, description, language, category and links of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.body, self.meta, self.lang, self.category = "", [], "", "", ""
        self.links: list[tuple[str, bool]] = []
        self.skip = 0
        self.in_title = self.in_body = False
        self.anchor: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = (a.get("lang") or "").lower()
        elif tag == "title":
            self.in_title = True
        elif tag == "body":
            self.in_body = True
        elif tag in SKIPPED:
            self.skip += 1
        elif tag == "meta" and (a.get("name") == "description" or a.get("property") == "og:description"):
            if len(a.get("content") or "") > len(self.meta):
                self.meta = a["content"]
        elif tag == "a" and a.get("href"):
            self.links.append((a["href"], a.get("rel") == "nofollow"))
        elif tag in ("iframe", "frame") and a.get("src"):
            self.links.append((a["src"], False))
        if a.get(CATEGORY):
            self.category = a[CATEGORY]
        self.body.append(" ")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in SKIPPED and self.skip:
            self.skip -= 1
        self.body.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.in_body and not self.skip:
            self.body.append(data)


def _followed(href: str) -> str | None:
    href = urldefrag(href.strip())[0]
    low = href.lower()
    if not href or low.startswith(("javascript:", "mailto:", "tel:", "data:")) or low.partition("?")[0].endswith(BINARY):
        return None
    return href


def parse_page(source: str, honor_nofollow: bool = True) -> dict:
    """Fields of a page; links in order of appearance, once each, as written but for fragments."""
    p = _Page()
    p.feed(source)
    p.close()
    links = [x for h, no in p.links if not (honor_nofollow and no) for x in [_followed(h)] if x]
    text = re.sub(r"\s+", " ", "".join(p.body)).strip()
    return {"title": re.sub(r"\s+", " ", p.title).strip(), "content": text, "meta": p.meta.strip(), "lang": p.lang, "category": p.category, "links": list(dict.fromkeys(links))}


PAGE = T.StructType([T.StructField(k, T.StringType()) for k in ("title", "content", "meta", "lang", "category")] + [T.StructField("links", T.ArrayType(T.StringType()))])


def page_fields(source: Column, honor_nofollow: bool = True) -> Column:
    """parse_page as a struct Column; NULL pages give empty fields."""
    small_batches(SparkSession.active())

    @F.pandas_udf(PAGE)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(x or "", honor_nofollow) for x in s], columns=[f.name for f in PAGE])

    return run(source)


def hrefs(source: Column) -> Column:
    """Distinct link targets of anchors with quoted attributes, fragments cut, by regular expressions in the JVM."""
    found = F.regexp_extract_all(source, F.lit(r'<a [^>]*href="([^"#]+)[^"]*"'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda h: ~F.lower(h).rlike(r"^(javascript|mailto|tel|data):")))


def snapshot(text: Column, size: int = 5000) -> Column:
    """The first characters of a text with white space collapsed."""
    return F.trim(F.regexp_replace(F.substring(text, 1, size), r"\s+", " "))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Entities decoded."""
    return s.map(html.unescape, na_action="ignore")
