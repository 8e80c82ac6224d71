import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import line_dedup
from lodestar.llm.line_dedup import block_keys, dedup_lines, half_keys, simhashes
from lodestar.llm.quality import clean_lines


def words(line):
    import re

    return [w.lower() for w in re.split(r"[\x20\x09-\x0D]+", line) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    seen = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if ws := words(line):
                seen.setdefault(" ".join(ws), []).append((i, p))
    keys = list(seen)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            a, b = keys[i].split(), keys[j].split()
            most = max(len(a), len(b))
            if min(len(a), len(b)) >= 0.8 * most and distance(a, b) <= int(0.2 * most + 1e-9):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    kept = {}
    for k, key in enumerate(keys):
        f = find(k)
        kept[f] = min([*seen[key], *([kept[f]] if f in kept else [])])
    stay = set(kept.values())
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not words(x) or (i, p) in stay) for i, t in rows}


def test_lines_equal_brute_force(docs):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (3, 40, 60, 80, 120, 200)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(5)):
            line = rng.choice(base).split()
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = f"x{rng.randrange(50)}"
            lines.append(" ".join(line).upper() if rng.random() < 0.2 else "  ".join(line))
        rows.append((i, "\n".join([*lines, "", "own line %d." % i])))
    out = {r["doc_id"]: r for r in dedup_lines(docs(rows)).collect()}
    assert {i: r["text"] for i, r in out.items()} == brute(rows)
    assert sum(r["n_lines_removed"] for r in out.values()) > 20


def plain_simhash(ws):
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in set(ws)]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))  # ties go to 0


def test_simhash_of_lines_of_any_length(spark):
    rng = random.Random(7)
    lines = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (1, 2, 5, 80, 16_383, 16_384, 40_000)] + [list("abacabad")]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, words array<string>")
    assert {r["id"]: (r["size"], r["sim"] % 2**64) for r in simhashes(df).collect()} == {i: (len(x), plain_simhash(x)) for i, x in enumerate(lines)}


def some_word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))


def edited(rng, line, share):
    near = list(line)
    for _ in range(max(1, int(share * len(line) + 1e-9))):
        at, kind = rng.randrange(len(near)), rng.choice("rrrid")
        near[at : at + (kind != "i")] = [] if kind == "d" and len(near) > 4 else [some_word(rng)]
    return near


@pytest.mark.parametrize("least, most, share, recall", [(5, 9, 0.2, 1), (10, 14, 0.1, 0.98), (10, 14, 0.2, 0.84), (15, 24, 0.2, 0.92), (25, 80, 0.1, 0.99), (25, 80, 0.2, 0.97)])
def test_edited_lines_share_a_key(spark, least, most, share, recall):
    rng, rows = random.Random(most), []
    for _ in range(400):
        line = [some_word(rng) for _ in range(rng.randrange(least, most + 1))]
        rows.append((line, edited(rng, line, share)))
    lines = spark.createDataFrame([(2 * i + k, line) for i, pair in enumerate(rows) for k, line in enumerate(pair)], "line long, words array<string>")
    keys = {i: set() for i in range(2 * len(rows))}
    blocks = block_keys(lines).where("key is not null").select("line", "key")
    for r in blocks.union(lines.select("line", F.explode(half_keys(F.col("words"))))).collect():
        keys[r["line"]].add(r["key"])
    assert sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(rows))) >= recall * len(rows)


def test_simhashes_within_three_bits_share_a_block(spark):
    rng, sims = random.Random(4), []
    for i in range(200):
        sim = rng.getrandbits(64)
        near = sim ^ sum(1 << b for b in rng.sample(range(64), i % 4))
        sims += [(2 * i + k, x - (x >> 63 << 64)) for k, x in enumerate((sim, near))]
    keys = {i: set() for i in range(len(sims))}
    for r in line_dedup.bit_keys(spark.createDataFrame(sims, "id long, sim long")).collect():
        keys[r["id"]].add(r["key"])
    assert all(len(k) == 20 for k in keys.values())
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(200)) and not any(keys[2 * i] & keys[2 * i + 2] for i in range(199))


def test_long_lines_link_by_bits_of_their_simhashes(docs, monkeypatch):
    """Where no block of words is shared. Copies of the lines don't change it."""
    rng = random.Random(12)
    line = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    near = [*line[:300], "other", *line[301:]]
    far = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    monkeypatch.setattr(line_dedup, "block_keys", lambda lines: block_keys(lines).withColumn("key", F.lit(None).cast("long")))
    out = {r["doc_id"]: r["n_lines_removed"] for r in dedup_lines(docs([(i, " ".join(x)) for i, x in enumerate((line, near, far, near, line, line))])).collect()}
    assert out == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1, 5: 1}


def test_lines_near_and_far(docs):
    rng = random.Random(9)
    line = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    six, seven = ([*line[:10], *(f"x{i}" for i in range(k)), *line[10 + k :]] for k in (6, 7))
    long = [f"w{rng.randrange(10**6)}" for _ in range(17_000)]
    texts = [line, six, seven, long, [*long[:8000], "other", *long[8000:]], ["one", "two", "three", "four"], ["one", "two", "three", "four", "five"], ["one", "two", "three"]]
    out = {r["doc_id"]: r["n_lines_removed"] for r in dedup_lines(docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0}  # the third is near the second


def test_columns_may_have_any_name(docs):
    names = ("row", "gone", "line", "key", "size", "keys", "at", "pos", "row_", "n_lines")
    df = docs([(1, "a b c d e f\nx"), (2, "A b c d e f")]).select("doc_id", "text", *(F.lit(7).alias(c) for c in names))
    out = dedup_lines(df).collect()
    assert {r["doc_id"]: (r["text"], r["row"], r["gone"], r["n_lines"]) for r in out} == {1: ("a b c d e f\nx", 7, 7, 2), 2: ("", 7, 7, 1)}


def test_odd_lines(odd, empty, docs):
    out = dedup_lines(odd).collect()
    assert len(out) == odd.count() and set(odd.columns) <= set(out[0].asDict())
    by = {r["doc_id"]: r for r in out}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[3]["text"] == " \n\t " and by[None]["n_lines"] == 1
    assert [r["n_lines_removed"] for r in out if r["doc_id"] == 5] == [0, 0]
    assert dedup_lines(empty).collect() == []
    kept = {r["doc_id"]: r["text"] for r in dedup_lines(docs([(2, "A b\nc"), (1, "c\n\na  B "), (None, "C")])).collect()}
    assert kept == {1: "c\n\na  B ", 2: "", None: ""}


def repeated(ws, n=5):
    grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
    counts = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(n)})


def test_quality_counts(docs):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 4, 5, 9, 30, 200)] + ["a b c d e a b c d e f", "é ñ #$ <x>\n\n é ñ #$ <x>", "one\vtwo\xa0three"]
    out = {r["doc_id"]: r for r in clean_lines(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        import re

        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), repeated(ws))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
    assert out[7]["n_dup_lines"] == 0 and out[0]["base_failed"]


GOOD = "This is a plain sentence of prose with some words. It goes on for a while, then stops."


@pytest.mark.parametrize(
    "line, stays",
    [
        (GOOD, True), ("Home | News | About | Contact", False), ("WIN!! NOW!! BIG!! PRIZES!!", False), ("th### is*** is$$$ no&&& ise%%% so# to# say#", False),
        ("Copyright, all rights reserved.", False), ("a line that just stops without any end", False), ("Title", True), (" ".join(["word"] * 60), True),
    ],
)
def test_line_rules(docs, line, stays):
    row = clean_lines(docs([(1, f"{GOOD}\n{line}\n{GOOD[::-1]}.")])).first()
    assert (line in row["clean_text"].split("\n")) == stays
    assert row["n_lines_removed"] == (not stays)


def test_documents_that_lose_too_much_go(docs, odd, empty):
    menu = "Home | News | About | Contact | Help | Legal"
    out = {r["doc_id"]: r["kept"] for r in clean_lines(docs([(1, f"{GOOD}\n{menu}"), (2, f"{menu}\n{menu} | More\n{GOOD[:50]}."), (3, "short")])).collect()}
    assert out == {1: True, 2: False, 3: False}
    rows = clean_lines(odd, keep_columns=True).collect()
    assert len(rows) == odd.count() and rows[0]["label"] == 2
    assert clean_lines(empty).collect() == []


@pytest.mark.parametrize("cheap", [0, 1000])
def test_pairs_of_a_bucket_that_are_far_apart_are_not_dealt_out(spark, cheap):
    """A bucket of many members, of which few are close: each round hands on the close pairs alone, and the last one the facts of close members alone."""
    from lodestar.llm import components

    members = spark.createDataFrame([(7, i) for i in range(300)] + [(8, 0), (8, 1)], "key long, id long")
    at = spark.createDataFrame([(i, 10 * i) for i in range(298)] + [(298, 1001), (299, 1002)], "id long, place long")
    wide = spark.createDataFrame([(i, "x" * 9) for i in range(300)], "id long, wide string")
    handed, dealt_out = [], []

    def verify(pairs):
        handed.append(pairs.count())
        return pairs

    def close():
        return F.abs(F.col("l_place") - F.col("r_place")) <= 1

    def decided(out, every, *more):
        dealt_out.append((out.count(), every.count()))
        return whole(out, every, *more)

    whole = components.decided_links
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(components, "decided_links", decided)
        labels = components.linked(members, verify, at, close, carried=True, stars=1, hubs=True, pivots=16, most_rounds=3, cheap=cheap, most_in_task=0, decided=(wide, lambda: F.col("l_wide") == F.col("r_wide")))
    out = {r["id"]: r["label"] for r in labels.collect()}
    assert out == {100: 100, 298: 100, 299: 100} and max(handed) <= 2
    assert all(n <= 3 and m <= 3 for n, m in dealt_out) and dealt_out


def test_keys_are_dealt_out_once(spark):
    rng = random.Random(21)
    rows = [(rng.randrange(300), rng.randrange(40)) for _ in range(400)] + [(1000, 7)] * 5 + [(None, 1), (None, 2)]
    keyed = spark.createDataFrame(rows, "key long, id long")
    ids = {}
    for key, i in rows:
        ids.setdefault(key, set()).add(i)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = line_dedup.shared(keyed)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") == 2  # one is what is reused
        assert sorted((r["key"], r["id"]) for r in found.collect()) == sorted((k, i) for k, x in ids.items() if k is not None and len(x) > 1 for i in x)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_buckets_of_two_are_done_with_after_a_round(spark, monkeypatch):
    from lodestar.llm import components

    members = spark.createDataFrame([(k, i) for k in range(50) for i in (2 * k, 2 * k + 1)] + [(99, i) for i in (0, 200, 201)], "key long, id long")
    at = spark.createDataFrame([(i, 10 * (i // 2)) for i in range(40)] + [(i, 10 * i) for i in range(40, 100)] + [(200, 9990), (201, 9990)], "id long, place long")
    written = []
    monkeypatch.setattr(components, "cut", lambda df, name, cut=components.cut: written.append((name, df.count())) or cut(df, name))

    def close():
        return F.abs(F.col("l_place") - F.col("r_place")) <= 1

    labels = components.linked(members, lambda pairs: pairs, at, close, carried=True, stars=1, hubs=True, pivots=16, most_rounds=3, most_in_task=0, decided=(at.select("id"), close))
    assert {r["id"]: r["label"] for r in labels.collect()} == {i: i // 2 * 2 for i in range(40)} | {200: 200, 201: 200}
    assert [n for name, n in written if name == "unresolved"] == [2]  # of 103 members


def test_spellings_are_made_for_close_lines_alone(docs, monkeypatch):
    """Of the lines that share a block, most are far apart."""
    from lodestar.llm import components

    rng = random.Random(22)
    block = "alpha beta incomprehensibilities gamma delta"
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) + f" {block} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(20)]
    written = Counter()

    def counting(df, name, cut=line_dedup.cut):
        written[name] += df.count()
        return cut(df, name)

    monkeypatch.setattr(line_dedup, "cut", counting)
    monkeypatch.setattr(components, "cut", counting)
    out = {r["doc_id"]: r["n_lines_removed"] for r in dedup_lines(docs([*enumerate(lines), (20, lines[3] + " more")])).collect()}
    assert out == {i: int(i == 20) for i in range(21)}
    assert written["line-texts"] == 21 and 2 <= written["line-facts"] + written["told"] <= 8
