"""Pages and tables of HTML, read with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("p div section article main li tr h1 h2 h3 h4 h5 h6 table ul ol br".split())
#: Elements that are no content.
SKIPPED = set("script style nav header footer form aside noscript".split())


class Tables(HTMLParser):
    """All tables of a page as lists of rows of (text, links, colspan, rowspan)."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[list]]] = []
        self.open: list[list] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table":
            self.open.append([])
            self.cell = None
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            number = lambda n: max(1, min(1000, int(a.get(n) or 1))) if str(a.get(n) or 1).isdigit() else 1
            self.cell = ["", [], number("colspan"), number("rowspan")]
            self.open[-1][-1].append(self.cell)
        elif tag == "a" and self.cell is not None and a.get("href"):
            self.cell[1].append(a["href"])

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.tables.append(self.open.pop())
            self.cell = None
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data


def grid(rows: list[list[list]]) -> list[list[str]]:
    """Cells in their places: a cell that spans rows or columns stands in each of them."""
    return [[text for text, _ in row] for row in linked_grid(rows)]


def linked_grid(rows: list[list[list]]) -> list[list[tuple[str, list[str]]]]:
    """The same with each cell's links."""
    taken: dict[tuple[int, int], tuple[str, list[str]]] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, links, colspan, rowspan in row:
            while (r, c) in taken:
                c += 1
            for i in range(min(rowspan, len(rows) - r)):
                for j in range(colspan):
                    taken[r + i, c + j] = (" ".join(text.split()), links)
            c += colspan
    width = max((c + 1 for _, c in taken), default=0)
    return [[taken.get((r, c), ("", [])) for c in range(width)] for r in range(len(rows))]


def cells(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, table, row, col, cell) of all tables; a table that repeats one of the same page is dropped."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf[id_col], pdf[html], strict=True):
                if not text:
                    continue
                parser = Tables()
                parser.feed(text)
                seen: list[list[list[str]]] = []
                for t in parser.tables:
                    g = grid(t)
                    if g and g not in seen:
                        seen.append(g)
                        out += [(i, len(seen) - 1, r, c, x) for r, row in enumerate(g) for c, x in enumerate(row)]
            yield pd.DataFrame(out, columns=["id", "table", "row", "col", "cell"])

    return df.select(id_col, html).mapInPandas(run, f"id {kind}, table int, row int, col int, cell string")


class Page(HTMLParser):
    """Text of the main element, or of the article, or of the body; and all links."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[str] = []
        self.text = {"main": "", "article": "", "body": ""}
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag not in VOID:
            self.stack.append(tag)
        if tag in BLOCK:
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag in BLOCK:
            self.handle_data("\n")

    def handle_data(self, data: str) -> None:
        if not SKIPPED & set(self.stack):
            for name in ("main", "article"):
                if name in self.stack:
                    self.text[name] += data
            self.text["body"] += data


def main_text(text: str, least: int = 50) -> tuple[str, list[str]]:
    """The first of main, article and body with more than ``least`` characters, and the page's links."""
    page = Page()
    page.feed(text)
    tidy = lambda s: re.sub(r"\n{2,}", "\n", "\n".join(" ".join(x.split()) for x in s.split("\n"))).strip()
    found = [tidy(page.text[n]) for n in ("main", "article", "body")]
    return next((t for t in found if len(t) > least), found[-1]), page.links


def same_section(links: list[str], url: str) -> list[str]:
    """Pages beside this one: links one level below the page's own folder on its host, without query, fragment, typed files and repeats."""
    here = urlsplit(url)
    folder = here.path.rstrip("/").rsplit("/", 1)[0] + "/"
    out: dict[str, None] = {}
    for link in links:
        full = urlsplit(urljoin(url, link))
        name = full.path.removeprefix(folder).strip("/")
        beside = full.scheme in ("http", "https") and full.netloc == here.netloc and full.path.startswith(folder) and name and "/" not in name
        if beside and full.path.rstrip("/") != here.path.rstrip("/") and not re.search(r"\.(pdf|docx?|xlsx?|zip|jpe?g|png)$", full.path.lower()):
            out.setdefault(full._replace(query="", fragment="").geturl())
    return list(out)


def pages(df: DataFrame, url_col: str, html: str) -> DataFrame:
    """(url, text, links) of pages: main text and same-section links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, text in zip(pdf[url_col], pdf[html], strict=True):
                body, links = main_text(text or "")
                out.append((url, body, same_section(links, url or "")))
            yield pd.DataFrame(out, columns=["url", "text", "links"])

    return df.select(url_col, html).mapInPandas(run, "url string, text string, links array<string>")


# What a column's heading says, and the column it is (fixed values).
COLUMNS = [(r"^(s\.?\s*no|sr\.?\s*no|sl\.?\s*no|serial)", "s_no"), (r"\bis\b.*\bno|is number|indian standard|^standard", "is_number"), (r"notification|quality control order|\bqco\b|order|gazette", "order"), (r"product|item|goods", "product")]


def table_rows(df: DataFrame, url_col: str, html: str) -> DataFrame:
    """(url, table, row, own, cells, links): the rows of all tables with spans filled in; own is the number of cells a row has itself, links
    are absolute. A table that repeats one of the same page counts once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, text in zip(pdf[url_col], pdf[html], strict=True):
                parser = Tables()
                parser.feed(text or "")
                seen: dict[str, None] = {}
                for t in parser.tables:
                    g = linked_grid(t)
                    if g and (said := repr([[x for x, _ in row] for row in g])) not in seen:
                        seen[said] = None
                        for r, row in enumerate(g):
                            links = dict.fromkeys(urljoin(url or "", x) for _, own in row for x in own if not x.startswith(("mailto:", "javascript:")))
                            out.append((url, len(seen) - 1, r, len(t[r]), [x for x, _ in row], list(links)))
            yield pd.DataFrame(out, columns=["url", "table", "row", "own", "cells", "links"])

    return df.select(url_col, html).mapInPandas(run, "url string, table int, row int, own int, cells array<string>, links array<string>")


def column_names(heads: Column) -> Column:
    """Names of columns: the known one that a heading says if no earlier one does, else its words; repeats are numbered."""
    known = lambda h: F.coalesce(*(F.when(F.lower(F.trim(h)).rlike(p), F.lit(n)) for p, n in COLUMNS))
    words = lambda h: F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower(h), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40), F.lit("")), F.lit("col"))
    once = F.transform(heads, lambda h, k: F.when(known(h).isNotNull() & ~F.exists(F.slice(heads, F.lit(1), k), lambda x: known(x) == known(h)), known(h)).otherwise(words(h)))
    earlier = lambda n, k: F.size(F.filter(F.slice(once, F.lit(1), k), lambda x: x == n))
    return F.transform(once, lambda n, k: F.when(earlier(n, k) > 0, F.concat(n, F.lit("_"), (earlier(n, k) + 1).cast("string"))).otherwise(n))


def scraped(df: DataFrame, url_col: str, html: str) -> DataFrame:
    """(url, category, fields, links): the records of all tables of pages.

    A table's first row of two cells and more names its columns. A row whose first two cells are one is the heading of a group, carried
    forward to the rows below (a footnote, which begins with a star, isn't). Rows that agree in number, product and serial number, or in all
    fields if they have neither, are one; the first stays. Windows run over the rows of one table, and of one page's records.
    """
    rows = table_rows(df, url_col, html)
    heads = rows.where("own >= 2").groupBy("url", "table").agg(F.min(F.struct("row", "cells")).alias("head"))
    below = rows.join(heads, ["url", "table"]).where("row > head.row").withColumn("first", F.col("cells")[0])
    group = (F.size("cells") >= 2) & (F.col("first") != "") & (F.col("first") == F.col("cells")[1]) & ~F.col("first").rlike(r"^\d+\.?$")
    w = Window.partitionBy("url", "table").orderBy("row")
    title = F.last(F.when(group & ~F.col("first").startswith("*"), F.col("first")), ignorenulls=True).over(w)
    r = below.withColumns({"category": F.coalesce(title, F.lit("")), "group": group}).where(~F.col("group") & F.exists("cells", lambda x: x != ""))
    n = F.least(F.size("head.cells"), F.size("cells"))
    r = r.withColumn("fields", F.map_from_arrays(F.slice(column_names(F.col("head.cells")), F.lit(1), n), F.slice("cells", F.lit(1), n)))
    field = lambda c: F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit(""))
    key = F.when((field("is_number") != "") | (field("product") != ""), F.array(field("is_number"), field("product"), field("s_no"))).otherwise(F.concat(F.array(F.lit(""), "category"), "cells"))
    k = F.row_number().over(Window.partitionBy("url", key).orderBy("table", "row"))
    return r.withColumn("k", k).where("k = 1").select("url", "category", "fields", "links")


class Markdown(HTMLParser):
    """A page's content as markdown: headings, paragraphs, lists, tables and links; what is no content is left out."""

    def __init__(self, url: str) -> None:
        super().__init__()
        self.url, self.stack, self.out, self.hidden = url, [], [], 0
        self.link: tuple[str, int] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in VOID:
            self.out.append("\n" if tag in ("br", "hr") and not self.hidden else "")
            return
        self.stack.append((tag, tag in SKIPPED or tag == "iframe" or "breadcrumb" in (a.get("class") or "")))
        self.hidden += self.stack[-1][1]
        if self.hidden:
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag == "a" and a.get("href"):
            self.link = (urljoin(self.url, a["href"]), len(self.out))
        elif tag in BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, _ in self.stack):
            return
        while True:
            t, skipped = self.stack.pop()
            if not self.hidden:
                if t == "a" and self.link:
                    text = " ".join("".join(self.out[self.link[1] :]).split())
                    self.out[self.link[1] :] = [f"[{text}]({self.link[0]})" if text else ""]
                    self.link = None
                elif t in ("td", "th"):
                    self.out.append(" |")
                elif t in BLOCK and t not in ("li", "tr"):
                    self.out.append("\n\n")
            self.hidden -= skipped
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            said = re.sub(r"\s+", " ", data)
            self.out.append(" " + said.strip() if self.stack and self.stack[-1][0] in ("td", "th") else said)


def markdown(df: DataFrame, url_col: str, html: str) -> DataFrame:
    """(url, markdown) of pages. Lists that begin with "Home" are breadcrumbs and left out; null pages have an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, text in zip(pdf[url_col], pdf[html], strict=True):
                page = Markdown(url or "")
                page.feed(re.sub(r"(?is)<(ul|ol)\b[^>]*>\s*<li\b[^>]*>\s*(?:<a\b[^>]*>)?\s*Home\s*<.*?</\1>", "", text or ""))
                lines = [x.strip() for x in "".join(page.out).split("\n")]
                out.append((url, re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()))
            yield pd.DataFrame(out, columns=["url", "markdown"])

    return df.select(url_col, html).mapInPandas(run, "url string, markdown string")
