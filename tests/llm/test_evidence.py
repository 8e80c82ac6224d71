"""Operators that SQL can't express, held against plain versions on whole tables or on many random texts."""

import base64
import html
import os
import random
import re
from collections import Counter

import pytest
from test_lines_and_quality import brute, words
from test_near_duplicates import brute as near_brute
from test_near_duplicates import family

from lodestar.llm import near_duplicates as N
from lodestar.llm import queries
from lodestar.llm.line_dedup import dedup_lines
from lodestar.llm.quality import clean_lines
from lodestar.llm.secrets import KINDS, confirmed_spans

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")

BLOCK = r"(?:p|div|h[1-6]|li|ul|ol|br|section|table|tr|td|th|blockquote|pre|figure|figcaption|dl|dt|dd)"


def article(page):
    """What stands in the article element, less what is no text of it: cut out by tags alone."""
    page = re.sub(r"(?is)<!--.*?-->", "", page or "")
    page = re.sub(r"(?is)<(script|style|noscript|form|aside|nav|header|footer)\b.*?</\1\s*>", "", page)
    out = []
    for inner in re.findall(r"(?is)<article\b[^>]*>(.*?)(?:</article>|\Z)", page):
        for part in re.split(rf"(?i)</?{BLOCK}\b[^>]*>", inner):
            if text := " ".join(html.unescape(re.sub(r"(?s)<[^>]*>", "", part)).split()):
                out.append(text)
    return "\n".join(out)


@tables
def test_main_text_of_all_pages_is_that_of_their_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    out = queries.QUERIES["op9_html_text"](spark, DIR).collect()
    assert len(out) == len(pages) and all(r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in out)


# --- secrets


def element(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + content


def some_key(rng):
    return element(0x30, element(2, b"\0") + element(0x30, element(6, b"\x2b\x65\x70")) + element(4, rng.randbytes(rng.randrange(24, 200))))


def parsed(data, at=0):
    """(tag, start, end) of the element at a place; None if it doesn't fit. Written for this test alone."""
    if at + 2 > len(data):
        return None
    n, start = data[at + 1], at + 2
    if n >= 128:
        k = n - 128
        if not 1 <= k <= 4 or start + k > len(data) or data[start] == 0:
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
        if n < 128:
            return None
    return (data[at], start, start + n) if start + n <= len(data) else None


def is_pkcs8(data):
    top = parsed(data)
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    found, at = [], top[1]
    while at < top[2]:
        one = parsed(data, at)
        if not one or one[2] > top[2]:
            return False
        found.append(one)
        at = one[2]
    if [t for t, _, _ in found[:3]] != [2, 0x30, 4] or data[found[0][1] : found[0][2]] not in (b"\0", b"\1"):
        return False
    at, inner = found[1][1], []
    while at < found[1][2]:
        one = parsed(data, at)
        if not one or one[2] > found[1][2]:
            return False
        inner.append(one)
        at = one[2]
    return bool(inner) and inner[0][0] == 6 and found[2][2] - found[2][1] >= 16


def test_decoded_keys_are_those_of_a_plain_decoder():
    """Keys in base64 and hex, whole, cut, with a byte changed or more after them, among other runs."""
    rng, found = random.Random(6), Counter()
    for _ in range(1500):
        parts, at, want = [], 0, set()
        for _ in range(rng.randrange(1, 4)):
            data = bytearray(some_key(rng))
            way = rng.randrange(6)
            if way == 1:
                data = data[: rng.randrange(31, len(data))]
            elif way == 2:
                data[rng.randrange(min(12, len(data)))] ^= 1 << rng.randrange(8)
            elif way == 3:
                data += rng.randbytes(rng.randrange(1, 4))
            elif way == 4:
                data = bytearray(rng.randbytes(len(data)))
            run = bytes(data).hex() if rng.random() < 0.3 else base64.b64encode(bytes(data)).decode()
            decoded = bytes(data) if len(run) >= 40 else b""
            if is_pkcs8(decoded):
                want.add((at, KINDS.index("der"), at + len(run)))
            gap = rng.choice([" ", ", ", " é ", ' "'])
            parts.append(run + gap)
            at += len(parts[-1])
        got = {s for s in confirmed_spans("".join(parts)) if KINDS[s[1]] == "der"}
        assert got == want, "".join(parts)
        found[bool(want)] += 1
    assert min(found.values()) > 200


# --- lines


@tables
def test_lines_of_a_table_link_as_all_pairs_do(spark):
    """All lines of the documents, each a text: what goes is what brute force over all pairs of them removes."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    lines = sorted({" ".join(words(x)) for r in rows for x in (r["text"] or "").split("\n") if len(words(x)) > 1})
    lines = [(i, x) for i, x in enumerate(lines)]
    # of pairs of unlike lengths or words none can link: these are told apart before edits are counted
    bags = [(len(x.split()), Counter(x.split())) for _, x in lines]
    near = set()
    for i in range(len(lines)):
        for j in range(i):
            (n, a), (m, b) = bags[i], bags[j]
            if min(n, m) >= 0.8 * max(n, m) and sum((a & b).values()) >= 0.8 * max(n, m) - 1e-9:
                near |= {i, j}
    want = brute([lines[i] for i in sorted(near)])
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    out = {r["doc_id"]: r["n_lines_removed"] for r in dedup_lines(docs).collect()}
    gone = {i for i, text in want.items() if not text}
    assert len(lines) > 1000 and {i for i, n in out.items() if n} == gone and gone


# --- near duplicates and quality


@pytest.mark.parametrize("many", [2, 10])
def test_classes_of_many_copies_get_their_component_where_they_are(docs, monkeypatch, many):
    monkeypatch.setattr(N, "MANY", many)
    rng = random.Random(3)
    texts = [*family(rng, 20, 80, 4)]
    rows = [(i, t) for i, t in enumerate(texts + [texts[3]] * 40 + [texts[7]] * 5)] + [(900 + i, None) for i in range(30)] + [(950 + i, "") for i in range(30)]
    out = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs(rows)).collect()}
    assert out == near_brute(rows, 5, 80)


def test_the_length_from_which_lines_are_paragraphs_is_a_parameter(docs):
    long = "this is a line of prose that goes on " * 6 + "without an end"
    rows = docs([(1, "\n".join([long, "A line that ends. " * 8]))])
    assert clean_lines(rows).first()["n_lines_removed"] == 0
    assert clean_lines(rows, long_line=None).first()["n_lines_removed"] == 1 == clean_lines(rows, long_line=60).first()["n_lines_removed"]
