"""Leaves, tables and images of HTML pages, by a standard-library parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SPACE = re.compile(r"\s+")
CHART = re.compile(r"chart|graph", re.I)


def decoded(data: bytes | str | None) -> str:
    return data.decode("utf-8", "ignore") if isinstance(data, bytes) else data or ""


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif isinstance(node, Node):
                yield node
                stack.append(iter(node.children))

    def text(self) -> str:
        out, stack = [], [iter(self.children)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif isinstance(node, Node):
                stack.append(iter(node.children))
            else:
                out.append(node)
        return SPACE.sub(" ", "".join(out).replace("\xa0", " ")).strip()


class Tree(HTMLParser):
    """Elements as they are written: an end tag closes the nearest open element of its name."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("tr", "td", "th", "li", "p"):
            stop = {"tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "li": ("ul", "ol"), "p": ("div", "td", "li", "body")}[tag]
            ends = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "p": ("p",)}[tag]
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in stop:
                    break
                if self.open[i].tag in ends:
                    del self.open[i:]
                    if tag != "tr":
                        break
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)


def leaves(page: str, drop_tables: bool = True) -> list[tuple[int, str, str]]:
    """(idx, tag, text) of paragraphs, and of div and li without a div or p inside. Empty ones keep their idx but go."""
    tree = Tree(page).root
    if drop_tables:
        for node in [tree, *tree.walk()]:
            node.children = [c for c in node.children if not (isinstance(c, Node) and c.tag == "table")]
    found = [n for n in tree.walk() if n.tag == "p" or n.tag in ("div", "li") and not any(c.tag in ("div", "p") for c in n.walk())]
    return [(i, n.tag, t) for i, n in enumerate(found) if (t := n.text())]


def span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "")
    return max(1, min(int(value), 1000)) if value.isdigit() else 1


def table_grid(table: Node) -> list[list[str | None]]:
    """Body rows with col- and rowspans filled in. Rows in thead, or of header cells alone at the top, name columns and are no rows."""
    rows, head = [], set()
    for node in table.walk():
        if node.tag == "thead":
            head.update(id(n) for n in node.walk() if n.tag == "tr")
        if node.tag == "tr":
            rows.append(node)
    grid, pending = [], {}
    for row in rows:
        cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
        line, at = [], 0

        def take(at: int) -> int:
            while at in pending:
                text, left = pending[at]
                line.append(text)
                pending[at] = (text, left - 1)
                if left == 1:
                    del pending[at]
                at += 1
            return at

        for cell in cells:
            at = take(at)
            for _ in range(span(cell, "colspan")):
                text = cell.text() or None
                line.append(text)
                if span(cell, "rowspan") > 1:
                    pending[at] = (text, span(cell, "rowspan") - 1)
                at += 1
        take(at)
        names = id(row) in head or cells and not grid and all(c.tag == "th" for c in cells)
        if not names and line:
            grid.append(line)
    width = max(map(len, grid), default=0)
    return [r + [None] * (width - len(r)) for r in grid]


def tables(page: str) -> list[list[list[str | None]]]:
    return [table_grid(n) for n in Tree(page).root.walk() if n.tag == "table"]


def chart_images(page: str, base: str) -> list[tuple[str, str]]:
    """(url, alt text) of images whose source names a chart or graph."""
    found = (n.attrs for n in Tree(page).root.walk() if n.tag == "img" and CHART.search(n.attrs.get("src", "")))
    return [(urljoin(base, a["src"]), a.get("alt", "").strip()) for a in found]


def parsed(pages: DataFrame, parse, columns: str, html: str, *keep: str) -> DataFrame:
    """mapInArrow of parse(text, row) -> tuples of columns; a page that can't be parsed gives one row with error alone."""
    keep = keep or tuple(c for c in pages.columns if c != html)
    source = pages.select(html, *keep)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in source.dtypes if c != html), columns, "error string"])
    names = [*keep, *(c.split()[0] for c in re.split(r",\s*(?![^<]*>)", columns)), "error"]
    kinds = [*(source.schema[c].dataType for c in keep)]
    empty = len(names) - len(keep) - 1

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                own = [row[c] for c in keep]
                try:
                    rows += [(*own, *x, None) for x in parse(decoded(row[html]), row)]
                except Exception as e:  # one bad page must not end the run; it is reported
                    rows.append((*own, *[None] * empty, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    assert len(kinds) == len(keep)
    return source.mapInArrow(run, schema)


def html_leaves(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    return parsed(pages, lambda page, row: leaves(page), "idx int, tag string, text string", html, *keep)


def html_tables(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """(keep, table_index, rows) of every table of a page."""
    return parsed(pages, lambda page, row: list(enumerate(tables(page))), "table_index int, rows array<array<string>>", html, *keep)


def chart_refs(pages: DataFrame, html: str = "html", url: str = "url", *keep: str) -> DataFrame:
    """(keep, ref_index, image_url, alt_text, mime): known images are skipped by an anti join, after the index is given."""
    keep = keep or tuple(c for c in pages.columns if c != html)
    found = parsed(pages, lambda page, row: [(i, *x) for i, x in enumerate(chart_images(page, row[url]))], "ref_index int, image_url string, alt_text string", html, *keep)
    return found.withColumn("mime", image_mime("image_url"))


def image_mime(url: str):
    suffix = F.lower(F.regexp_extract(url, r"\.([A-Za-z]+)(?:[?#].*)?$", 1))
    return F.when(suffix == "png", "image/png").when(suffix == "gif", "image/gif").when(suffix == "webp", "image/webp").otherwise("image/jpeg")
