import base64
import hashlib
import json
import math
import random
import re

import pyarrow as pa
import pytest

from lodestar.llm import secrets as S
from lodestar.llm.decontaminate import Items, budget, code_points, decontaminate, find_passages
from lodestar.llm.html_text import main_blocks, main_text
from lodestar.llm.pii import KINDS, disclosing_terms, find_personal_data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in d) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    return {"email": True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(kind, m[0]))


def written(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def test_personal_data_equals_plain_regular_expressions(docs):
    rng = random.Random(2)
    alphabet = ["a", "b.", "@", "x@y.zz", "1", "23", ".", "255", "256", "1.2.3.4", "-", " ", "+1 (555) 123-4567", "4111 1111 1111 1111", "é", "\n", "_", "😀"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(400)] + [(1000, "a@b.c " * 700), (1001, "7" * 5000), (1002, "1." * 3000)]
    for r, (_, t) in zip(find_personal_data(docs(rows)).orderBy("doc_id").collect(), rows, strict=True):
        want = written(base(t), KINDS)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(x[1] == i for x in base(t)) for i in range(4)]


def test_terms_that_go_with_an_entity_go(docs):
    noise = [(100 + i, f"filler words number {i} and the common mail terms stand here") for i in range(50)]
    rows = [(1, "ask Smithson joe@x.org now"), (2, "mail of smithson, joe@x.org again"), (3, "the common mail is for ann@y.org"), *noise]
    out = {r["doc_id"]: r for r in find_personal_data(docs(rows)).collect()}
    assert out[1]["spans"] == "remove:4:12,email:13:22" and out[1]["sanitised"] == "ask  [EMAIL] now"
    assert out[2]["spans"] == "remove:8:16,email:18:27" and out[3]["spans"] == "email:23:32" and out[100]["spans"] == ""


def test_terms_far_from_their_entity_in_its_line_go(docs):
    far = lambda k: " ".join(f"w{k}{chr(97 + i)}x" for i in range(40))
    noise = [(100 + i, f"filler words number {i} and more of them stand here") for i in range(50)]
    rows = [(1, f"Smithson {far(1)} joe@x.org"), (2, f"joe@x.org {far(2)} smithson"), (3, f"joe@x.org {far(3)} Smithson's"), *noise]
    out = {r["doc_id"]: r["spans"] for r in find_personal_data(docs(rows)).collect()}
    assert out[1].startswith("remove:0:8,") and out[2].split(",")[1].startswith("remove:") and "remove" not in out[3] + out[100]


def test_terms_go_from_texts_without_their_entity(docs):
    noise = [(100 + i, f"filler words number {i} and more of them stand here") for i in range(300)]
    rows = [(i, f"number{'abcdefghijklmnopqrstuvwxyz'[i]} of Smithson joe@x.org") for i in range(1, 20)] + [(50, "Then (Smithson) left."), (50, "Then (Smithson) left."), *noise]
    out = [r for r in find_personal_data(docs(rows)).collect() if r["doc_id"] == 50]
    assert [(r["n_email"], r["spans"], r["sanitised"]) for r in out] == [(0, "remove:6:14", "Then () left.")] * 2


def test_many_entities_and_terms_of_a_line(spark):
    lines = ["x " + " ".join(f"e{i}@x.org term{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(300)) + tail for tail in (" one", " two")]
    source = spark.createDataFrame([(i, t) for i, t in enumerate(lines + [f"noise {i}" for i in range(60)])], "id long, text string")
    out = disclosing_terms(source, source.where("id < 2").select("text"))
    assert out.select("term").distinct().count() >= 300 and {round(r[0], 6) for r in out.select("disclosure").distinct().collect()} == {1.0}


def plain_disclosures(texts):
    """term -> disclosure of the e-mail address it discloses most, by counting every pair over all distinct lines."""
    at = {}
    for line in {x for t in texts for x in t.split("\n")}:
        words = line.split(" ")
        for w in set(words):
            at.setdefault(w, set()).add(line)
    n, out = len({x for t in texts for x in t.split("\n")}), {}
    for e in (w for w in at if "@" in w and 2 <= len(at[w]) < n):
        for t in (w for w in at if "@" not in w and len(w) >= 3):
            if (both := len(at[e] & at[t])) >= 2:
                value = math.log2(n * both / (len(at[e]) * len(at[t]))) / math.log2(n / len(at[e]))
                if value >= 0.85:
                    out[t] = max(out.get(t, 0), value)
    return out


def random_mail(seed):
    """Texts of lines; names go with an address always, mostly or now and then, also far off in a long line, and without it."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 5))) for _ in range(120)]
    texts = []
    for i in range(260):
        lines = []
        for _ in range(rng.randint(1, 3)):
            line = rng.choices(words, k=rng.randint(3, 40))
            who, sort = rng.randrange(12), rng.random()
            if sort < 0.3:
                line.insert(0, f"{'klmnopqrstuv'[who]}@mail.org")
                line += [f"name{'klmnopqrstuv'[who]}"] * (rng.random() < 0.9) + [f"town{'klmnopqrstuv'[who // 3 * 3]}"] * (rng.random() < 0.7)
            elif sort < 0.36:
                line.append(f"name{'klmnopqrstuv'[who % 5]}")
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    return texts + rng.choices(texts, k=60)


@pytest.mark.parametrize("seed", range(3))
def test_disclosure_equals_counts_of_all_pairs(spark, seed):
    texts = random_mail(seed)
    want = plain_disclosures(texts)
    assert len(want) >= 5 and any(v >= 0.95 for v in want.values()) and any(v < 0.95 for v in want.values())
    source = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["term"]: r["disclosure"] for r in disclosing_terms(source, source.where("text like '%@%'").select("text")).collect()}
    assert got == pytest.approx(want)


def test_terms_are_marked_in_every_text(spark, docs):
    texts = random_mail(7)
    want = plain_disclosures(texts)
    rows = find_personal_data(docs(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    seen = set()
    for r in rows:
        text, at, spans, out = texts[r["doc_id"]], 0, [], []
        for m in re.finditer(r"\S+", text):
            kind = "email" if "@" in m[0] else None if m[0] not in want else "remove" if want[m[0]] >= 0.95 else "generalise"
            if kind:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
                out += [text[at : m.start()], {"email": "[EMAIL]", "remove": "", "generalise": "[TERM]"}[kind]]
                at = m.end()
                seen.add((kind, "@" in text))
        assert r["spans"] == ",".join(spans)
        assert r["sanitised"] == ("".join(out) + text[at:] if spans else None)
    assert {("remove", True), ("generalise", True), ("generalise", False)} <= seen


def test_scans_take_odd_rows(odd, empty):
    for scan in (find_personal_data, S.find_secrets):
        rows = scan(odd).collect()
        assert len(rows) == odd.count() and {r["base_sha256"] for r in rows if r["doc_id"] in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}
        assert scan(empty).collect() == []


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets_equal_plain_regular_expressions(docs):
    rng = random.Random(4)
    alphabet = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "abc", "AKIA", "0123456789ABCDEF", "deadbeef", "é", "\n", ".", "ſecret", "x" * 30]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))) for i in range(500)]
    out = S.find_secrets(docs(rows)).orderBy("doc_id").collect()
    for r, (_, t) in zip(out, rows, strict=True):
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r["base_sha256"] == hashlib.sha256(written(sorted(want), S.KINDS).encode()).hexdigest(), t


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | len(n := len(body).to_bytes((len(body).bit_length() + 7) // 8, "big"))]) + n
    return bytes([tag]) + size + body


PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(range(32)))))
RSA = der(0x30, der(2, b"\0"), der(2, b"\1" * 128), *(der(2, b"\1\2\3") for _ in range(7)))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"pub" * 10, b"priv" * 20))


def url64(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


TOKEN = ".".join([url64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url64(b'{"sub":"1"}'), url64(bytes(range(32)))])


@pytest.mark.parametrize(
    "text, kind",
    [
        (base64.b64encode(PKCS8).decode(), "der"), (RSA.hex(), "der"), (RSA.hex().upper(), "der"), (base64.b64encode(SSH).decode(), "openssh"), (TOKEN, "token"),
        ("-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(PKCS8).decode() + "-----END PRIVATE KEY-----", "pem"),
    ],
)
def test_structures_are_confirmed(text, kind):
    spans = S.confirmed_spans(f"see {text} there")
    assert (4, S.KINDS.index(kind), 4 + len(text)) in spans


def wrapped(text, width=64, end="\n"):
    return end.join(text[i : i + width] for i in range(0, len(text), width))


SEALED = base64.b64encode(bytes(range(1, 161))).decode()


@pytest.mark.parametrize(
    "text, kind",
    [
        (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0F' * 16}\n\n{wrapped(SEALED)}\n-----END RSA PRIVATE KEY-----", "pem"),
        (f"-----BEGIN RSA PRIVATE KEY-----\\nProc-Type: 4,ENCRYPTED\\nDEK-Info: AES-128-CBC,00\\n\\n{wrapped(SEALED, end=chr(92) + 'n')}\\n-----END RSA PRIVATE KEY-----", "pem"),
        (wrapped(base64.b64encode(RSA).decode()), "der"), (wrapped(base64.b64encode(RSA).decode().rstrip("="), 76, "\r\n  "), "der"),
        (wrapped(base64.b64encode(RSA).decode(), end="\\n"), "der"), (wrapped(base64.b64encode(PKCS8).decode(), 16), "der"),
        (wrapped(RSA.hex(), 32), "der"), (wrapped(RSA.hex().upper(), 60), "der"), (wrapped(base64.b64encode(SSH).decode()), "openssh"),
    ],
)
def test_structures_over_several_lines_are_confirmed(text, kind):
    for before, after in (("see ", " there"), ("the\nkey\n", "\nand\nmore")):
        assert S.confirmed_spans(before + text + after) == [(len(before), S.KINDS.index(kind), len(before) + len(text))]
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["id", "text"])
    assert f"{kind}:0:{len(text)}" in next(S.scan(iter([batch]))).column(5)[0].as_py()


@pytest.mark.parametrize("text", [wrapped(base64.b64encode(RSA[:-3]).decode()), wrapped(base64.b64encode(bytes(300)).decode()), "word\n" * 3000, f"-----BEGIN PRIVATE KEY-----\n{SEALED}\n-----END PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----" * 3000])
def test_lines_that_do_not_decode_are_not_reported(text):
    assert S.confirmed_spans(text) == []


@pytest.mark.parametrize("text", [base64.b64encode(PKCS8[:-1] + b"xx").decode(), RSA.hex()[:-2], base64.b64encode(SSH + b"x").decode(), TOKEN.replace("e", "f", 1), base64.b64encode(bytes(60)).decode(), "ab" * 40, "x.y.z"])
def test_what_does_not_decode_is_not_reported(text):
    assert S.confirmed_spans(f"see {text} there") == []


def test_redaction_leaves_no_secret():
    assert S.redact(f"a {TOKEN} b password=hunter22") == "a [SECRET] b [SECRET]"


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_passages_equal_brute_force(spark, docs):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh  ") for _ in range(n))
    items = [(i, text(rng.randrange(30, 200))) for i in range(12)] + [(50, None), (51, ""), (52, "abc"), (53, "fg hdeabcd a"), (54, "abcdefgh hgfedcba abcde")]
    rows = []
    for i in range(120):
        x = list(items[rng.randrange(12)][1])
        for _ in range(rng.choice([0, 1, 3, 8, 15, 25])):
            p = rng.randrange(len(x))
            x[p : p + rng.randrange(2)] = rng.choice(["", "Z", "q"])
        rows.append((i, text(rng.randrange(80)) + "".join(x) + text(rng.randrange(80))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in find_passages(docs(rows), bench).collect():
        got[r["doc_id"], r["item_id"]] = min(got.get((r["doc_id"], r["item_id"]), 99), r["edits"])
    known, want = Items(items), {}
    for i, t in rows:
        for k, item in [*zip(known.ids, known.codes, strict=True), *((k, item) for k, item, _ in known.short)]:
            if (e := edit_distance_inside(item.tolist(), code_points(t, known.fold).tolist())) <= budget(len(item)):
                want[i, k] = e
    assert got == want and len(want) > 40 and {53, 54} <= {k for k, _, _ in known.short}
    blocks = {(r["doc_id"], r["item_id"]) for r in find_passages(docs(rows), bench, block_chars=300).collect()}
    assert blocks == set(want)
    assert {r["doc_id"] for r in decontaminate(docs(rows), bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_passages_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "Same   text\nhere, twice over.")], "item_id long, text string")
    found = find_passages(odd, bench).collect()
    assert {r["doc_id"] for r in found} == {5} and found[0]["start"] == 0
    assert decontaminate(odd, bench).count() == odd.count() - 2
    assert find_passages(empty, bench).collect() == [] and find_passages(odd, bench.limit(0)).collect() == []


PROSE = "The cat is on the mat and it was there for a long time with the others who had come from the sea to see it."


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f"<nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>{PROSE}<p>Short.</article><footer>&copy; x</footer>", ["Title & more", PROSE, "Short."]),
        (f"<div class=sidebar><p>{PROSE}</p></div><div id=main><p>{PROSE} x</p><p>End.</p></div><div class='user-comments'><p>{PROSE}</div>", [PROSE + " x", "End."]),
        ("<article><p>one</p><aside>no</aside><form>no</form><script>var t='</p>';</script><p>two<br>three</p>", ["one", "two three"]),
        ("<!-- <p>no</p> --><p>a &lt; b &#233; &nbsp; c</p>", ["a < b é c"]),
        ("<p>un<b>clo", ["unclo"]),
        ("<article><div class='ad'>buy</div><p>text", ["text"]),
        ("", []),
        ("plain text, no markup", ["plain text, no markup"]),
    ],
)
def test_main_blocks(page, blocks):
    assert main_blocks(page) == blocks


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<p>x"), (3, "w", "<div>" * 3000 + "deep"), (3, "w", "<" * 50000)], "page_id long, url string, html string")
    out = main_text(pages).collect()
    assert len(out) == 5 and [(r["text"], r["n_chars"]) for r in out[:4]] == [("", 0), ("", 0), ("x", 1), ("deep", 4)]
    assert main_text(pages.limit(0)).collect() == []


def test_scan_of_an_empty_batch():
    batch = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["id", "text"])
    assert next(S.scan(iter([batch]))).num_rows == 0
