"""Decontamination against brute force: a document is bad if it holds an item's words in order."""

import random

import numpy as np

from lineloom.llm import decontam, textnp
from lineloom.llm.common import ship

ITEM = "doc_id bigint, text string, matches string"


def test_planted_items_are_found_and_edges_hold(spark):
    ship(spark)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    items = [(i, prose(30) + ". " + prose(5) + ".") for i in range(12)]
    docs = [(i, prose(rng.randint(20, 300))) for i in range(80)]
    docs += [(100 + i, f"{prose(60)} {t} {prose(3000 if i == 0 else 60)}") for i, t in items]
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, docs[0][1]), (100, docs[80][1])]
    source = spark.createDataFrame([(i, t, "x") for i, t in docs], ITEM)
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (None, "a b c"), items[0]], "item_id bigint, text string")
    out = decontam.decontaminate(source, benchmark)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "matches", "contaminated"]
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        brute = [i for i, t in items if t in (r.text or "")]
        assert r.contaminated == bool(brute)
        assert [m.item_id for m in r.matches] == brute
    none = decontam.decontaminate(source, benchmark.limit(0)).where("contaminated").count()
    assert none == 0 and decontam.decontaminate(source.limit(0), benchmark).count() == 0


def test_item_in_a_third_of_the_rows(spark):
    ship(spark)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    items = [(i, prose(30) + ". " + prose(5) + ".") for i in range(3)]
    docs = [(i, f"{prose(40)} {items[0][1]} {prose(40)}" if i % 3 == 0 else prose(100)) for i in range(300)]
    out = decontam.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id: [m.item_id for m in r.matches] for r in out.collect()} == {i: [0] if i % 3 == 0 else [] for i, _ in docs}


def test_long_items_are_found_whatever_the_cosine(spark):
    ship(spark)
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(6000)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    items = [(i, prose(1500) + ". " + prose(5) + ".") for i in range(3)] + [(3, prose(12) + ". " + prose(3) + ".")]
    docs = [(i, prose(300)) for i in range(40)] + [(100 + i, f"{prose(90)} {t} {prose(90)}") for i, t in items]
    source, benchmark = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for cosine in (0.2, 0.99):  # the second sees nothing: the exact path alone
        out = decontam.decontaminate(source, benchmark, cosine=cosine)
        assert {r.doc_id: [(m.item_id, m.ratio) for m in r.matches] for r in out.collect() if r.matches} == {100 + i: [(i, 1.0)] for i, _ in items}


def test_copies_do_not_fill_the_basis_sample(spark):
    texts = [f"text number {i}" for i in range(30)]
    docs = spark.createDataFrame([(t,) for t in texts for _ in range(50)] + [(None,)], "text string")
    got = [r.t for r in decontam._sample(docs, "text", 20).collect()]
    assert len(got) == len(set(got)) == 20 and set(got) <= set(texts)
    assert decontam._sample(docs.where("text is null"), "text", 20).count() == 0


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_paraphrases_equal_brute_force_over_all_passages(spark):
    """Dropped, swapped and replaced words: what matches around some passage is found, nothing else is."""
    ship(spark)
    rng = random.Random(11)
    common = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(30)]
    rarer = ["".join(rng.choices("ijklmnopq", k=6)) for _ in range(1500)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(rarer)
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, prose(rng.choice([3, 12, 30, 55])), prose(4)) for i in range(16)]

    def damaged(words, share):
        out = []
        for w in words:
            r = rng.random()
            if r < share / 3:
                continue
            out.append(word() if r < 2 * share / 3 else w)
        for _ in range(int(share / 3 * len(out))):
            j = rng.randrange(max(1, len(out) - 1))
            out[j : j + 2] = reversed(out[j : j + 2])
        return out

    docs, light = [], set()
    for share in (0.1, 0.25, 0.45, 0.7):
        for i, body, answer in items:
            if share <= 0.25 and len(body) > 10:
                light.add((len(docs), i))
            docs.append((len(docs), prose(rng.choice([0, 40, 200])) + damaged(body, share) + damaged(answer, share) + prose(rng.choice([0, 40, 400]))))
    docs += [(len(docs), prose(300)) for _ in range(20)]
    want = {}
    for d, words in docs:
        for i, body, answer in items:
            item = body + answer
            for p in range(0, len(words), decontam.CHUNK):
                around = words[max(0, p - len(item)) : p + 2 * decontam.CHUNK + len(item)]
                if len(set(item) & set(around)) < 0.3 * len(set(item)):
                    continue
                share = longest(item, around) / len(item)
                if share >= 0.8 or (share >= 0.6 and longest(answer, around) >= 0.8 * len(answer)):
                    want.setdefault(d, set()).add(i)
                    break
    source = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(b) + ". " + " ".join(a) + ".") for i, b, a in items], "item_id bigint, text string")
    for cosine in (0.2, 0.99):
        got = {r.doc_id: {m.item_id for m in r.matches} for r in decontam.decontaminate(source, benchmark, cosine=cosine).collect() if r.matches}
        assert got == want
    found = sum(i in want.get(d, ()) for d, i in light)
    assert found >= 0.9 * len(light)


def test_basis_comes_from_every_row(spark, monkeypatch):
    """It spans what the passages of all rows span, rows beyond the 2,000 of least hash and copies included."""
    ship(spark)
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(120)]
    themes = [words[i : i + 20] for i in range(0, 120, 20)]
    texts = [" ".join(rng.choices(themes[i % 6], k=24)) for i in range(2600)]
    benchmark = spark.createDataFrame([(0, " ".join(words))], "item_id bigint, text string")
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string").repartition(3)
    seen, fit = [], decontam.fit_basis
    monkeypatch.setattr(decontam, "fit_basis", lambda texts, *a: seen.append(texts.where("text <> ''").count()) or fit(texts, *a))
    decontam.decontaminate(docs, benchmark)
    assert seen == [2600]
    items = decontam.Items.load(benchmark, 1 << 20)
    basis = fit(docs, items, np.ones(120), 1.0, 6, 1.0)
    place = {w: np.searchsorted(items.vocab, textnp.words(*bytes_of(w))[0])[0] for w in words}
    rows = np.zeros((2600, 120))
    for i, t in enumerate(texts):
        for w in t.split():
            rows[i, place[w]] += 1
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-4)
    best = np.linalg.svd(rows, full_matrices=False)[1]
    assert (np.linalg.norm(rows @ basis) / np.linalg.norm(rows)) ** 2 > 0.9 * (best[:6] ** 2).sum() / (best**2).sum()


def bytes_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_words_are_placed_as_by_search():
    rng = np.random.default_rng(1)
    vocab = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    vocab = np.unique(np.concatenate([vocab, vocab[:50] + np.uint64(3)]))  # words that begin alike
    h = np.concatenate([vocab, vocab + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    assert (decontam._place(h, vocab) == np.where(vocab[at] == h, at, -1)).all()
    assert (decontam._place(h, vocab[:0]) == -1).all()
