"""Main text of web pages: blocks are classified by their own figures, short ones by their neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: Elements by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form button select option menu dialog head object audio video canvas".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice newsletter subscribe subscription popup modal "
    "overlay comment comments commentlist disqus replies respond share sharing social related recommended recommendations widget "
    "pagination pager login signup toolbar skip".split()
)
HEADERS = frozenset("header hgroup".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article main section div select".split())
#: Frequent function words of the languages read.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was "
    "were which who will with you au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas "
    "plus pour que qui sa se ses son sur un une vous aber als am auch auf aus bei das dass dem den der des die ein eine einen er es "
    "für hat ich im ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wir wird zu zum zur al como con del el "
    "ella ellos esta este ha hay la las lo los más me mi muy no nos o para pero por se sin su sus te tu una uno y ya".split()
)
#: Characters of a short and of a long block; shares of stop words and of linked characters.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKED = 0.15, 0.30, 0.33

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<[!?][^>]*+>?"
    r"|</([a-zA-Z][^\s/>]*)[^>]*+>?"
    r"|<([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
LETTERS = re.compile(r"[^\W\d_]+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    linked: int
    inside: int  # number of the article or main element around it, 0: none
    excluded: bool
    label: bool | None = None


@dataclass
class Open:
    tag: str
    inside: int
    excluded: bool
    link: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)

    def end_block(self, top: Open) -> None:
        if not self.parts:
            return
        text = " ".join("".join(x for x, _ in self.parts).split())
        if text:
            linked = sum(len("".join(x.split())) for x, link in self.parts if link)
            self.blocks.append(Block(text, linked, top.inside, top.excluded))
        self.parts = []


def is_boilerplate(tag: str, attributes: str, inside: int) -> bool:
    if tag in BOILERPLATE_TAGS or tag in HEADERS and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id") and any(x.lower() in BOILERPLATE_NAMES for x in NAME_PARTS.findall(value)):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The text blocks in page order, with the facts that the rules need."""
    out, stack, articles, at = Page(), [Open("", 0, False, False)], 0, 0
    while at < len(page):
        m = MARKUP.search(page, at)
        top = stack[-1]
        upto = m.start() if m else len(page)
        if upto > at:
            out.parts.append((html.unescape(page[at:upto]), top.link))
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag not in INLINE:
                out.end_block(stack[-1])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag == "table" and tag != "table" and tag in INLINE:
                    break
            continue
        tag, attributes = (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
        if not tag:
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag not in ("svg", "math"):
                out.end_block(top)
            continue
        if tag == "br":
            out.parts.append((" ", False))
        if tag not in INLINE:
            out.end_block(top)
            if stack[-1].tag == "p":
                stack.pop()
            elif any(x.tag == "p" for x in stack[-4:]):
                # a block ends an open paragraph and what is open in it
                while stack[-1].tag in INLINE and len(stack) > 1:
                    stack.pop()
                if stack[-1].tag == "p":
                    stack.pop()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in IMPLIED.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            continue
        top = stack[-1]
        inside = top.inside
        if tag in ("article", "main") and not inside:
            articles += 1
            inside = articles
        bad = top.excluded or is_boilerplate(tag, attributes, inside)
        stack.append(Open(tag, inside, bad, top.link or tag == "a"))
    out.end_block(stack[-1])
    return out.blocks


def decide(block: Block) -> bool | None:
    """The label that a block's own figures give: main text, boilerplate, or None if they don't tell."""
    if block.excluded:
        return False
    size = len(block.text)
    linked = block.linked / max(1, size)
    if linked > LINKED:
        return None if block.inside and size >= SHORT else False
    words = [w.lower() for w in LETTERS.findall(block.text)]
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if size < SHORT:
        return None
    if stops >= STOP_HIGH or stops >= STOP_LOW and (size >= LONG or block.inside):
        return True
    return None if block.inside or stops >= STOP_LOW else False


def main_blocks(page: str) -> list[str]:
    blocks = blocks_of(page)
    for b in blocks:
        b.label = decide(b)
    decided = [b.label for b in blocks]
    near: list[list[tuple[int, bool] | None]] = []
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        seen: dict[int, tuple[int, bool]] = {}
        found: list[tuple[int, bool] | None] = [None] * len(blocks)
        for i in order:
            b = blocks[i]
            # an article's blocks look only at each other, and what its element excludes tells nothing of its neighbours
            found[i] = seen.get(b.inside)
            if decided[i] is not None and not b.excluded:
                seen[b.inside] = (i, decided[i])
        near.append(found)
    for i, b in enumerate(blocks):
        if b.label is None:
            sides = sorted((abs(x[0] - i), x[1]) for x in (near[0][i], near[1][i]) if x)
            if not sides:
                b.label = True
            elif b.inside:
                b.label = any(x for _, x in sides)
            else:
                b.label = sides[0][1] if len(sides) == 1 or sides[0][0] != sides[1][0] else sides[0][1] and sides[1][1]
    return [b.text for b in blocks if b.label]


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(main_blocks(x.as_py())) for x in batch.column(2)]
        sizes = pa.array(map(len, texts), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), sizes], ["id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: (id, url, text, n_chars).

    text joins the main blocks in page order by line feeds, each with its white space turned into
    single spaces; it is empty where no block is main text, or where the page is null or empty.
    Null ids and urls stay null; repeated rows give repeated results. Other columns are ignored.
    """
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    out = source.mapInArrow(extract, "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
