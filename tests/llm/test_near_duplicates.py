import random

import pytest

from lodestar.llm import components as C
from lodestar.llm.near_duplicates import banding, most_differing, near_duplicates


def sets(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, num):
    s = {i: sets(t, width) for i, t in rows}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= num * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in s}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(t)


@pytest.mark.parametrize("width, num", [(3, 85), (5, 80)])
def test_equals_brute_force_on_families_of_near_copies(docs, width, num):
    rng = random.Random(width)
    texts = [*family(rng, 60, 120, 8), *family(rng, 40, 60, 4), *family(rng, 25, 300, 20), *(" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(60))]
    texts += [texts[0]] * 30
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = near_duplicates(docs(rows), width=width, num=num).collect()
    want = brute(rows, width, num)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {i: len(sets(t, width)) for i, t in rows}


def test_odd_rows(odd, empty):
    out = near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (1, 2, 3))
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert [r["component_id"] for r in out if r["doc_id"] == 5] == [5, 5]
    assert near_duplicates(empty).collect() == []


def test_short_texts_are_one_shingle(docs):
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs([(1, "A b"), (2, "a  B"), (3, "a b c"), (4, "b")])).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("most_in_task", [10**6, 0])
def test_components(spark, most_in_task):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    links += [(5000, x) for x in range(5001, 5200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["id"]: r["label"] for r in C.components(df, most_in_task).collect()} == {x: find(x) for x in parent}
    assert C.components(df.limit(0), most_in_task).collect() == []


def test_banding_misses_few():
    for t in (0.8, 0.85, 0.9):
        bands, rows = banding(t)
        assert bands * rows <= 128 and (1 - t**rows) ** bands <= 1e-6
    assert most_differing(0.85) < most_differing(0.8) < 256
