"""Components against brute force over all pairs."""

import random

from brute import shingles

from lineloom.llm import near_dup


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [(len(sets[i]), find(i)) for i in range(len(rows))]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(400))
    passage = [word() for _ in range(60)]
    rows = [None, "", " \n", "one two", "ONE\ttwo", "one two three", "a b c d e", "a b c d E f"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([7, 30, 120]))]
        if r.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            base = copy if r.random() < 0.5 else base
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(brute(rows)))


def test_tree_finds_what_pairs_hold():
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(1, 1 << 63, 300).astype(np.uint64)
    sets = []
    for i in range(90):
        s = base.copy()
        s[r.integers(0, 300, r.integers(5, 120))] = r.integers(1, 1 << 63, 1).astype(np.uint64) + np.arange(1, dtype=np.uint64)
        sets.append(np.unique(s[: r.integers(200, 300)]))
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    x, y = near_dup.Tree(np.arange(90), n, np.stack([near_dup._signature(s) for s in sets])).pairs()
    got = set(zip(x.tolist(), y.tolist(), strict=True))
    for i in range(90):
        for j in range(i + 1, 90):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                assert (i, j) in got
    assert len(got) < 90 * 89 // 2


def test_empty_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, t, "x"), (7, t, "y"), (3, t, "z"), (None, t, "z"), (5, None, ""), (5, "", "")], "doc_id bigint, text string, k string")
    got = sorted(near_dup.near_duplicates(docs).collect(), key=str)
    assert [r["component_id"] for r in got if r["n_shingles"]] == [3, 3, 3, 3]
    assert [r["component_id"] for r in got if not r["n_shingles"]] == [5, 5]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(1, 2)], "a bigint, b bigint")
    got = {r["k"]: r["root"] for r in near_dup.components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1}


def test_links_equal_brute_force(spark):
    rows = corpus(2)
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[20:60])]  # exact copies
    base = [f"v{i}" for i in range(60)]
    rows += [(len(rows) + i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(40)]  # one component of many linked pairs
    sets = [shingles(t) for _, t in rows]
    want = {}
    for i, s in enumerate(sets):
        near = [j for j, t in enumerate(sets) if j != i and s and 100 * len(s & t) >= 75 * len(s | t)]
        same = [j for j, (_, t) in enumerate(rows) if s and words(t) == words(rows[i][1])]
        want[i] = (min(same, default=i), len(near))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_links(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == want


def words(text):
    return (text or "").lower().split()


def test_long_chain_keeps_no_rounds_in_reserve(spark):
    """A chain needs more rounds the longer it is; none is left in pieces."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)], "a bigint, b bigint")
    assert {r["root"] for r in near_dup.components(edges).collect()} == {1}


def test_equal_keys_of_different_texts_are_told_apart(spark, monkeypatch):
    """Two word sequences under one 64-bit key, as the second key tells, stay two classes."""
    import pyarrow as pa

    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    (_, ka, sa, _), (_, kb, sb, _) = near_dup.class_sets(pa.array([a, b]))
    assert ka != kb and sa != sb
    again = list(near_dup.class_sets(pa.array([a, b]), frozenset([ka, kb])))
    assert len({ka, kb, again[0][1], again[1][1]}) == 4


def test_long_text_and_other_columns(spark):
    t = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(60000))
    docs = spark.createDataFrame([(1, t, 0), (2, t + " end", 0), (3, "short", 0)], "doc_id bigint, text string, k int")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
