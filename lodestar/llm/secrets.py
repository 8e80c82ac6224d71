"""Secret scan: pattern spans, and spans whose decoded structure is that of a key or a signed token."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: The kinds of spans in their order, and their patterns.
KINDS = ("assign", "access", "hex", "pem", "openssh", "der", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api_key", "apikey")
#: A body goes up to the next five hyphens, so header lines may have some.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/]{40,}|[A-Za-z0-9_-]{40,})={0,2}(?![A-Za-z0-9+/_=-])")
HEXADECIMAL = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Za-z])")
#: Runs of either alphabet with nothing but a line break between them.
PIECE = re.compile(r"[A-Za-z0-9+/_-]++={0,2}+")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-]){PIECE.pattern}(?:[\x20\t]*+\r?\n[\x20\t]*+{PIECE.pattern})++")
MAGIC = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes | None:
    """The bytes, or None if the text is no base64 of either alphabet."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text.translate({45: 43, 95: 47}) + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unhex(text: str) -> bytes | None:
    try:
        return bytes.fromhex(text)
    except ValueError:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill data exactly, None if a length doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_key_der(data: bytes) -> bool:
    """A private key of PKCS#1, PKCS#8 (plain or encrypted) or SEC 1, by its nested elements."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(top[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags[:9] == [2] * 9 and len(parts[1][1]) >= 32:
        return True
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1") and (inner := der_items(parts[1][1])):
        return inner[0][0] == 6 and len(parts[2][1]) >= 16
    if tags[:2] == [2, 4] and parts[0][1] == b"\1":
        return len(parts[1][1]) in (24, 28, 32, 48, 66)
    if tags == [0x30, 4] and (inner := der_items(parts[0][1])):
        return inner[0][0] == 6 and len(parts[1][1]) >= 16
    return False


def is_openssh(data: bytes) -> bool:
    """An OpenSSH private key: its magic, then fields whose lengths fill the rest."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out = data[at + 4 : at + 4 + n]
        at += 4 + n
        return out

    if any(field() is None for _ in range(3)):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= count <= 16 and all(field() is not None for _ in range(count + 1)) and at == len(data)


def is_token(head: str, body: str, signature: str) -> bool:
    """A signed token: its header names an algorithm, its body is an object, its signature has bytes."""
    if not head.startswith("ey"):
        return False
    try:
        one, two = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(one, dict) or not isinstance(one.get("alg"), str):
        return False
    if "enc" in one:
        return False
    sealed = unbase64(signature)
    return isinstance(two, dict) and (one["alg"].lower() == "none" or sealed is not None and len(sealed) >= 16)


def decoded_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "openssh" if is_openssh(data) else "der" if is_key_der(data) else None


def bytes_needed(data: bytes) -> int:
    """How long a key that begins with data is, as far as data tells: more than it has if a length is still to come, 0 if it is none."""
    if data[:1] == b"\x30" and len(data) >= 6:
        n = data[1] & 0x7F
        if not data[1] & 0x80:
            return 2 + n
        return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else 0
    if not data.startswith(MAGIC):
        return 0
    at, fields = len(MAGIC), 3
    for is_count in (True, False):
        for _ in range(fields):
            if at + 4 > len(data):
                return at + 4
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        if is_count:
            if at + 4 > len(data):
                return at + 4
            fields, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
            if not 2 <= fields <= 17:
                return 0
    return at


def wrapped_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of keys in base64 or hex that go over several lines, also where line breaks are escaped.

    A key may begin with any run of a chain of lines, and its own lengths say where it ends, so
    that words on the lines before and after it do no harm.
    """
    out = []
    flat = text.replace("\\r", "  ").replace("\\n", "\n ") if "\\" in text else text
    for chain in WRAPPED.finditer(flat):
        if chain.end() - chain.start() < 40:
            continue
        pieces = list(PIECE.finditer(flat, chain.start(), chain.end()))
        runs = [p[0].rstrip("=") for p in pieces]
        ends, after = [0, *accumulate(map(len, runs))], 0
        for i in range(len(pieces) - 1):
            for decode, bits in ((unbase64, 6), (unhex, 4)):
                need, have, last = len(MAGIC), b"", i
                while i >= after and need > len(have):
                    chars = -(-8 * need // bits)
                    last = bisect_left(ends, ends[i] + chars) - 1
                    if last >= len(pieces) or not (have := decode("".join(runs[i : last + 1])[:chars])):
                        break
                    need = bytes_needed(have)
                else:
                    whole = need == len(have) and last > i and ends[last + 1] == ends[i] + -(-8 * need // bits)
                    if whole and (kind := decoded_kind(decode("".join(p[0] for p in pieces[i : last + 1])))):
                        out.append((pieces[i].start(), KINDS.index(kind), pieces[last].end()))
                        after = last + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the pattern kinds. Matches that fail are dropped without a retry."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    place = {k: i for i, k in enumerate(KINDS)}
    for m in PEM.finditer(text):
        lines = m[2].replace("\\r", "").replace("\\n", "\n").splitlines()
        data = unbase64("".join(x for x in lines if ":" not in x).replace(" ", "").replace("\t", ""))
        if decoded_kind(data) or data and "ENCRYPTED" in m[2] and len(data) % 8 == 0:
            out.append((m.start(), place["pem"], m.end()))
    inside = [(a, b) for a, _, b in out]
    for m in TOKEN.finditer(text) if "ey" in text else ():
        if is_token(m[1], m[2], m[3]):
            out.append((m.start(), place["token"], m.end()))
    for pattern, decode in ((ENCODED, unbase64), (HEXADECIMAL, unhex)):
        for m in pattern.finditer(text):
            if (kind := decoded_kind(decode(m[0]))) and not any(a <= m.start() < b for a, b in inside):
                out.append((m.start(), place[kind], m.end()))
    out += [x for x in wrapped_spans(text) if not any(a <= x[0] < b for a, b in inside)]
    return list(dict.fromkeys(out))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, digests, spans = [], ([], [], []), [], []
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            base, more = [], []
            if len(text) >= 12:
                base = base_spans(text)
                more = confirmed_spans(text)
            ids.append(i.as_py())
            for k, column in enumerate(counts):
                column.append(sum(x[1] == k for x in base))
            digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            spans.append(spans_text(base + more))
        arrays = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, n_assign, n_access, n_hex, base_sha256, spans).

    spans joins kind:start:end, in code points, by start and kind. Beside the pattern kinds it has
    base64 and hex runs, also over several lines, that decode to a private key (der, openssh), key blocks between their
    marks (pem) and signed tokens (token); what doesn't decode to such a structure is not
    reported. A null text counts as empty; null ids stay null; repeated rows give repeated
    results. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return source.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced, overlapping spans as one."""
    out, at = [], 0
    for a, _, b in sorted(base_spans(text) + confirmed_spans(text)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
