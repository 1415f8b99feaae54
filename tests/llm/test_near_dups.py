"""Near-duplicates against brute force, and connected components."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import near_dups as N
from ledgerlens.llm.components import components

SCHEMA = "doc_id long, text string, class string, node int, label double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, 0.5) for i, t in rows], SCHEMA).repartition(3)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, share=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= share * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=60):
    """Random texts, copies, copies with a few words changed, and a shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    rows, passage = [], [word() for _ in range(60)]
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([1, 2, 3, 12, 80, 200]))] + (passage if rng.random() < 0.2 else [])
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) * 3 % 997, (" ".join(w).upper() if rng.random() < 0.2 else "\t".join(w))))
    return rows


def result(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 2), (3, 5)])
def test_against_brute_force(spark, seed, k):
    rows = corpus(seed)
    assert result(N.near_duplicates(docs(spark, rows), k)) == brute(rows, k)


def test_large_nodes_and_rooms_are_split(spark, monkeypatch):
    """Limits small enough that Spark branches nodes and rooms are dealt as blocks."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, f"lone text number {i} " * 3) for i in range(20)]
    want = brute(rows, 2)
    monkeypatch.setattr(N, "NODE_ROWS", 40)
    monkeypatch.setattr(N, "ROOM_ROWS", 30)
    monkeypatch.setattr(N, "MAX_DEPTH", 2)
    assert result(N.near_duplicates(docs(spark, rows), 2)) == want


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (4, "a B"), (5, "a b"), (6, "a"), (7, "A"), (8, "a b c"), (9, "word " * 50_000), (9, "word " * 50_000)]
    got = result(N.near_duplicates(docs(spark, rows), 2))
    assert got == brute(rows, 2) and got[(4, 1, 4, True)] == 2
    odd = N.near_duplicates(docs(spark, [(None, "x y"), (None, "x y"), (3, "x y"), (None, "z z")]), 2).collect()
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in odd if r["component_id"]) == [(False, 3, True), (True, 3, False), (True, 3, False)]
    assert N.near_duplicates(docs(spark, []), 2).count() == 0


def test_filter_keeps_whole_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, text), (1, text), (5, "quite another text of at least six words"), (5, text.replace("ten", "zehn") + " " + text), (7, None), (7, None)]
    got = N.without_near_duplicates(docs(spark, rows))
    assert got.columns == docs(spark, []).columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, text), rows[3], rows[4], (7, None), (7, None)])


def test_recall_of_borderline_pairs(spark):
    """Pairs at similarity 0.8 to 0.83 among unlike texts: nearly all links are found."""
    rng = random.Random(3)
    rows, pairs = [], 0
    for i in range(150):
        w = [f"{rng.randrange(10**9)}" for _ in range(100)]
        cut = rng.randrange(0, 8)
        v = w[cut + 1 :] + [f"{rng.randrange(10**9)}" for _ in range(cut + 1)]
        a, b = shingles(" ".join(w), 2), shingles(" ".join(v), 2)
        pairs += 100 * len(a & b) >= 80 * len(a | b)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    found = N.near_duplicates(docs(spark, rows), 2).filter("not kept").count()
    assert found >= 0.99 * pairs > 100


@pytest.mark.parametrize("node_rows", [30, 4_000])
def test_recall_on_both_sides_of_the_node_limit(spark, monkeypatch, node_rows):
    """Pairs near the threshold among texts that share half their words, so that first nodes hold nearly all: Spark branches them, or they are compared."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(60)]
    rows, pairs = [], 0
    for i in range(60):
        w = shared + [f"{rng.randrange(10**9)}" for _ in range(60)]
        cut = rng.randrange(0, 10)
        v = w[:-cut] + [f"{rng.randrange(10**9)}" for _ in range(cut)] if cut else w + ["end"]
        a, b = shingles(" ".join(w), 2), shingles(" ".join(v), 2)
        pairs += 100 * len(a & b) >= 80 * len(a | b)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    monkeypatch.setattr(N, "NODE_ROWS", node_rows)
    found = N.near_duplicates(docs(spark, rows), 2).filter("not kept").count()
    assert 0.9 * pairs <= found <= pairs and pairs > 50


def test_shared_counts_by_columns(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120), np.uint64)) for _ in range(40)]
    monkeypatch.setattr(N, "COLUMNS", 7)
    first, second = np.arange(15), np.arange(10, 40)
    want = [[len(set(sets[a].tolist()) & set(sets[b].tolist())) for b in second] for a in first]
    assert (N._shared(sets, first, second) == np.array(want)).all()


def test_large_sets_are_dealt_by_bytes(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:rng.randrange(300)] + [f"x{i}"] + base[300:])) for i in range(20)] + [(100 + i, " ".join(base + [f"y{i}"])) for i in range(20)]
    monkeypatch.setattr(N, "ROOM_BYTES", 8_000)
    assert result(N.near_duplicates(docs(spark, rows), 2)) == brute(rows, 2)


def test_shingle_hash_is_order_and_length_aware():
    cache = N.WordHashes()
    sets = N.shingle_sets(["a b", "b a", "a b c", "a", None], 2, cache)
    assert len({s.tobytes() for s in sets}) == 5 and [len(s) for s in sets] == [1, 1, 2, 1, 0]
    assert not set(N.shingle_sets(["a b"], 5, cache)[0].tolist()) & set(sets[0].tolist()) or np.array_equal(N.shingle_sets(["a b"], 5, cache)[0], sets[0])


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(49, 100), (100, 101), (7, 7)], [(i * 7 % 31, i * 5 % 29) for i in range(40)]])
def test_components(spark, links):
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
