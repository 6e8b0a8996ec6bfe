"""Articles of web pages, by configurable tags and classes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import ship

# Titles of pages that are errors, tags without an end.
ERROR_TITLES = ("网络原因或无此页面", "请稍后尝试", "页面不存在", "访问出错")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")


@dataclass(frozen=True)
class Selectors:
    """``tag`` or ``tag.class`` of the page's main part (empty: all of it), its articles, their title and their body (empty: the article).

    With ``closed``, a character reference ends with a semicolon, and one without stays
    as text; else it is read as HTML has it (``&amp`` is ``&``).
    """

    main: str = "main.article-content"
    article: str = "article.content-section"
    title: str = "h2.content-heading"
    any_title: str = "h2"
    body: str = "div.content-body"
    paragraph: str = "p"
    closed: bool = False


class _Reader(HTMLParser):
    def __init__(self, s: Selectors):
        super().__init__(convert_charrefs=True)
        self.s, self.open, self.found = s, [], []
        self.article, self.into = None, []  # what text goes into: kind, depth, runs of text, place among the paragraphs

    @staticmethod
    def _is(tag: str, classes: list[str], selector: str) -> bool:
        name, _, cls = selector.partition(".")
        return tag == name and (not cls or cls in classes)

    def _inside(self, selector: str) -> bool:
        return not selector or any(self._is(t, c, selector) for t, c in self.open)

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag in _VOID:
            return
        self.open.append((tag, classes))
        s = self.s
        if self.article is None:
            if self._is(tag, classes, s.article) and self._inside(s.main):
                self.article = {"depth": len(self.open), "best": None, "any": None, "p": []}
            return
        for kind, selector in (("best", s.title), ("any", s.any_title)):
            if self.article[kind] is None and self._is(tag, classes, selector):
                self.article[kind] = ""
                self.into.append((kind, len(self.open), [], 0))
        if self._is(tag, classes, s.paragraph) and self._inside(s.body):  # also one in another that was left open
            self.into.append(("p", len(self.open), [], len(self.article["p"])))
            self.article["p"].append("")

    def handle_data(self, data):
        if self.into and not any(t in ("script", "style") for t, _ in self.open):
            for x in self.into:
                x[2].append(data.strip())

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        del self.open[at:]
        while self.into and len(self.open) < self.into[-1][1]:
            kind, _, parts, place = self.into.pop()
            if kind == "p":
                self.article["p"][place] = "".join(parts)
            else:
                self.article[kind] = "".join(parts)
        if self.article and len(self.open) < self.article["depth"]:
            a, self.article = self.article, None
            self.found.append((a["best"] if a["best"] is not None else a["any"] or "", "\n".join(a["p"])))


def _closed(page: str) -> str:
    """``page`` with an escaped ampersand wherever it begins no known reference that a semicolon ends."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + (m[1] or ""), page)


def articles_of(page: str | None, selectors: Selectors) -> list[tuple[str, str]]:
    """``(title, body)`` of each article of a page."""
    r = _Reader(selectors)
    r.feed(_closed(page or "") if selectors.closed else page or "")
    r.close()
    while r.open:  # tags that the page leaves open
        r.handle_endtag(r.open[-1][0])
    return r.found


def extract(pages: DataFrame, key: str, selectors: Selectors = Selectors()) -> DataFrame:  # noqa: B008
    """``key, order_in_broadcast, title, full_text`` of all articles of ``pages (key, html)``; order counts from 1, before any filter."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *a) for k, h in zip(b[key], b["html"], strict=True) for i, a in enumerate(articles_of(h, selectors), 1)]
            yield pd.DataFrame(rows, columns=[key, "order_in_broadcast", "title", "full_text"])

    return pages.select(key, "html").mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, order_in_broadcast int, title string, full_text string")


def usable(articles: DataFrame, least: int = 20) -> DataFrame:
    """Articles with a title that is no error message and a body of some length."""
    wrong = F.lit(False)
    for marker in ERROR_TITLES:
        wrong = wrong | F.contains("title", F.lit(marker))
    return articles.where((F.trim("title") != "") & (F.length("full_text") >= least) & ~wrong)
