"""Fields of raw pages by a tolerant parser, one pass a page."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Node:
    """An element: tag, attributes and, in order, its text and elements."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str | None]) -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []

    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, tag: str, of_class: str | None = None) -> Iterator[Node]:
        """Elements of a tag and, if given, of all the classes of a blank-separated list."""
        wanted = (of_class or "").split()
        return (n for n in self.walk() if n.tag == tag and all(c in n.classes() for c in wanted))

    def first(self, tag: str, of_class: str | None = None) -> Node | None:
        return next(self.all(tag, of_class), None)

    def strings(self, without: Callable[[Node], bool] = lambda node: False) -> Iterator[str]:
        """Non-blank texts below, each stripped, scripts left out."""
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                if item.strip():
                    yield item.strip()
            elif item.tag not in SILENT and not without(item):
                todo += reversed(item.children)

    def text(self, separator: str = "", without: Callable[[Node], bool] = lambda node: False) -> str:
        return separator.join(self.strings(without))


class _Builder(HTMLParser):
    """A tree of whatever is given: an end tag closes the nearest open element of its name, a paragraph the one before.

    How many elements of each name are open is counted, so that stray end tags cost nothing.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def _close(self, tag: str) -> None:
        while True:
            node = self.open.pop()
            self.count[node.tag] -= 1
            if node.tag == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open[-1].tag == "p":
            self._close("p")
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        if self.count.get(tag):
            self._close(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def paragraphs(node: Node | None) -> str | None:
    """The non-empty paragraphs of an element, joined by empty lines; null if it has none."""
    found = [t for t in (p.text() for p in node.all("p")) if t] if node is not None else []
    return "\n\n".join(found) or None


def section_text(root: Node, outer: str | None, inner: str | None = None, tag: str = "div") -> str | None:
    """H1/H2: the paragraphs of the section: the first `tag` of class `inner` in that of class `outer`, either being
    optional. A section without paragraphs gives its whole text without read-more and read-less buttons. Null without
    the section or any text."""
    at: Node | None = root
    for of_class in (outer, inner):
        if of_class is not None and at is not None:
            at = at.first(tag, of_class)
    if at is None:
        return None
    if next(at.all("p"), None) is not None:
        return paragraphs(at)
    return at.text(" ", lambda n: n.tag == "span" and bool({"read-more", "read-less"} & set(n.classes()))) or None


def cell_links(root: Node, cell: str | None, link: str | None = None) -> list[str]:
    """H3/H5: the first link, of class `link` if given, of each table cell of class `cell`; all links without a class."""
    if cell is None:
        return [a.attributes["href"] for a in root.all("a", link) if a.attributes.get("href")]
    found = (td.first("a", link) for td in root.all("td", cell))
    return [a.attributes["href"] for a in found if a is not None and a.attributes.get("href") is not None]


def ranked_record(root: Node) -> dict[str, str | None] | None:
    """H4: rank ("N/A" without one), name, description and region of a page whose main section has a header, an
    information section and a region; None for any other page."""
    main = root.first("section", "main-content")
    header = main.first("header", "header") if main else None
    name = header.first("h1") if header else None
    info = main.first("section", "infomation") if main else None
    region = main.first("p", "region") if main else None
    span = region.first("span") if region else None
    detail = main.first("div", "details") if main else None
    if None in (name, info, span, detail):
        return None
    rank = detail.first("span", "rank")
    return {"rank": rank.text() if rank else "N/A", "name": name.text(), "description": paragraphs(info) or "", "region": span.text()}


def pane_record(root: Node) -> dict[str, str | None] | None:
    """H6: rank, name, description and country of a page of panes, with defaults for what it lacks: the country from
    the first two panes, the description from the third or, if that has no text, the fourth. None without panes or
    country."""
    panes = list(root.all("div", "pane-content"))
    countries = (p.first("div", "institution-info__country clearfix") for p in panes[:2])
    country = next((c for c in countries if c is not None and c.first("a") is not None), None)
    if country is None:
        return None
    name, rank = root.first("h1", "institution-info__title"), root.first("span", "institution-info__ranking-number")
    text = next((t for t in map(paragraphs, panes[2:4]) if t), None)
    return {
        "rank": rank.text() if rank else "Rank not found",
        "name": name.text() if name else "Name not found",
        "description": text or "Description not found",
        "country": country.text(),
    }


def parse(html: str | None, section: str | None = None, script: str | None = None) -> tuple[str | None, str | None, str | None, list[str]]:
    """(description, h1, embedded state, links) of a page. Without a section the whole page is one."""
    root = tree(html)
    head = next((t for t in (h.text(" ") for h in root.all("h1")) if t), None)
    state = next((s for s in root.all("script") if script is not None and s.attributes.get("id") == script), None)
    return section_text(root, section), head, "".join(c for c in state.children if isinstance(c, str)) if state else None, cell_links(root, None)


def _by_page(pages: DataFrame, schema: str, columns: list[str], rows: Callable[[int, Node], list[tuple]]) -> DataFrame:
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(page_id, *row) for page_id, html in zip(pdf.page_id, pdf.html) for row in rows(page_id, tree(html))]
            yield pd.DataFrame(found, columns=["page_id", *columns])

    return pages.select("page_id", "html").mapInPandas(run, schema)


def page_fields(pages: DataFrame, section: str | None = None, inner: str | None = None) -> DataFrame:
    """H1/H2: (page_id, title, description, n_links) of each page."""

    def rows(_: int, root: Node) -> list[tuple]:
        head = next((t for t in (h.text(" ") for h in root.all("h1")) if t), None)
        return [(head, section_text(root, section, inner), len(cell_links(root, None)))]

    return _by_page(pages, "page_id long, title string, description string, n_links long", ["title", "description", "n_links"], rows)


def page_links(pages: DataFrame, cell: str | None = None, link: str | None = None, base: str = "") -> DataFrame:
    """H3/H5: (page_id, pos, link), links that are not absolute behind the base URL, repaired as `repaired` does."""
    rows = _by_page(pages, "page_id long, pos int, link string", ["pos", "link"], lambda _, root: list(enumerate(cell_links(root, cell, link))))
    return rows.withColumn("link", repaired(absolute(F.col("link"), base)))


def absolute(link: Column, base: str) -> Column:
    """H7: a link that does not begin with "http" behind the base URL."""
    return F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(base), link))


def repaired(link: Column) -> Column:
    """H5: no blanks, and no archive marker before the path."""
    return F.replace(F.replace(link, F.lit(" "), F.lit("")), F.lit("mp_/"), F.lit("/"))


def ranked_pages(pages: DataFrame) -> DataFrame:
    """H4: one row for each page that is such a record."""
    fields = ["rank", "name", "description", "region"]
    return _by_page(pages, "page_id long, rank string, name string, description string, region string", fields,
                    lambda _, root: [tuple(r[f] for f in fields)] if (r := ranked_record(root)) else [])


def pane_pages(pages: DataFrame) -> DataFrame:
    """H6: one row for each page that is such a record."""
    fields = ["rank", "name", "description", "country"]
    return _by_page(pages, "page_id long, rank string, name string, description string, country string", fields,
                    lambda _, root: [tuple(r[f] for f in fields)] if (r := pane_record(root)) else [])


def usable_records(records: DataFrame, name: str = "name", url: str = "url", rank: str = "rank") -> DataFrame:
    """H8: records with a name and a URL whose rank is not "Reporter"."""
    filled = (F.length(name) > 0) & (F.length(url) > 0)
    return records.filter(filled & F.coalesce(F.col(rank) != "Reporter", F.lit(True)))


def embedded_rows(pages: DataFrame, path: tuple[str, ...], schema: str, script: str = "__NEXT_DATA__") -> DataFrame:
    """Rows of the array at `path` of the JSON in the page's state script; pages without such an array give none."""

    def rows(_: int, root: Node) -> list[tuple]:
        node = next((s for s in root.all("script") if s.attributes.get("id") == script), None)
        try:
            at = json.loads("".join(c for c in node.children if isinstance(c, str))) if node else None
        except ValueError:
            at = None
        for key in path:
            at = at.get(key) if isinstance(at, dict) else None
        return [(json.dumps(r),) for r in (at if isinstance(at, list) else [])]

    found = _by_page(pages, "page_id long, row string", ["row"], rows)
    return found.select("page_id", F.from_json("row", schema).alias("r")).select("page_id", "r.*")
