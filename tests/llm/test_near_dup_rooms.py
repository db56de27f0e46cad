"""Tokens that sets share too late for a link, and groups that many near copies share."""

import random

from test_near_dup import brute, corpus

from lineloom.llm import near_dup


def staged(monkeypatch):
    counts = {}
    keep = near_dup.stage

    def stage(df, name):
        out = keep(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dup, "stage", stage)
    return counts


def test_shared_passages_leave_no_rows_for_the_trees(spark, monkeypatch):
    r = random.Random(4)
    shared = [[f"p{i}x{j}" for j in range(12)] for i in range(20)]
    texts = [" ".join([*(f"u{i}x{r.randrange(10**9)}" for _ in range(20 + i)), *shared[i % 20], *(f"v{i}x{r.randrange(10**9)}" for _ in range(20))]) for i in range(60)]
    counts = staged(monkeypatch)
    got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {x["component_id"] for x in got} == set(range(60))
    assert counts.get("mixed-rows", 0) == 0


def near_copies(seed):
    """Copies of one text with few and many changes: some link, others don't."""
    r = random.Random(seed)
    rows = [t for _, t in corpus(seed)]
    base = [f"b{i}" for i in range(90)]
    for _ in range(90):
        copy = list(base)
        for _ in range(r.randrange(1, 9)):
            copy[r.randrange(90)] = f"n{r.randrange(10**6)}"
        rows.append(" ".join(copy[: r.randrange(70, 91)]))
    return list(enumerate(rows))


def test_large_groups_of_near_copies_equal_brute_force(spark):
    rows = near_copies(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == dict(enumerate(brute(rows)))
