"""Encoding against the library, sampling against enumeration."""

import collections
import itertools

import numpy as np
import public_tokenizers as P
import pytest

from lineloom.llm import subwords as S

PATH = P.path("piece_bpe_32k.model")


def segmentations(lat, kind, node=None):
    node = int(lat.origin[kind]) if node is None else node
    if node == lat.close[kind]:
        yield []
        return
    for e in range(int(lat.first[node]), int(lat.first[node + 1])):
        for rest in segmentations(lat, kind, int(lat.dst[e])):
            yield [e, *rest]


def test_lattice_sums():
    voc = S.vocabulary(PATH)
    units = [S.MARK + "hello", S.MARK + "\U0001f600x", S.MARK * 3]
    lat = S.Lattice(voc, units)
    for i, u in enumerate(units):
        all_paths = list(segmentations(lat, i))
        assert np.isclose(np.exp([lat.logp[p].sum() for p in all_paths]).sum(), np.exp(lat.back[lat.origin[i]]))
        for p in all_paths:
            assert voc.decode([j for e in p for j in lat.ids(voc, e)]) == u.replace(S.MARK, " ")[1:]


def test_samples_are_distinct_and_complete():
    """A text with few segmentations gives each exactly once, and first draws follow their probabilities."""
    voc = S.vocabulary(PATH)
    lat = S.Lattice(voc, [S.MARK + "ab", S.MARK + "the"])
    total = len(list(segmentations(lat, 0))) * len(list(segmentations(lat, 1)))
    n = 3000
    keys = S.mix(np.arange(1, n + 1).astype(np.uint64))
    first, second, out = collections.Counter(), collections.Counter(), S.sample_block(voc, S.Units(["ab the"] * n), keys, total + 3, True)
    p = {}
    for a, b in itertools.product(segmentations(lat, 0), segmentations(lat, 1)):
        ids = tuple(i for e in a + b for i in lat.ids(voc, e))
        p[ids] = np.exp(lat.logp[a].sum() + lat.logp[b].sum() - lat.back[lat.origin[0]] - lat.back[lat.origin[1]])
    for rows in out:
        got = [tuple(r["ids"]) for r in rows]
        assert len(set(got)) == len(got) <= total and len({r["hash"] for r in rows}) == len(got)
        assert all(np.isclose(r["logp"], np.log(p[tuple(r["ids"])])) and r["pieces"] == len(r["ids"]) for r in rows)
        first[got[0]] += 1
        second[got[1]] += 1
    assert {len(r) for r in out} == {total}
    for ids, q in p.items():
        assert abs(first[ids] / n - q) < 5 * np.sqrt(q * (1 - q) / n) + 1e-3
        # second draw of sampling without replacement
        want = sum(p[o] * q / (1 - p[o]) for o in p if o != ids)
        assert abs(second[ids] / n - want) < 5 * np.sqrt(want * (1 - want) / n) + 2e-3


def test_same_seed_same_samples_whatever_the_batch():
    voc = S.vocabulary(PATH)
    texts = ["one text here", "", "another longer text with words", "x"]
    keys = S.mix(np.arange(4).astype(np.uint64))
    whole = S.sample_block(voc, S.Units(texts), keys, 3, True)
    single = [S.sample_block(voc, S.Units([t]), keys[i : i + 1], 3, True)[0] for i, t in enumerate(texts)]
    assert [[(r["hash"], r["ids"]) for r in x] for x in whole] == [[(r["hash"], r["ids"]) for r in x] for x in single]


@pytest.mark.parametrize("with_ids", [True, False])
def test_encode_table(spark, with_ids):
    texts = [None, "", " ", "Hello  world\n\n x", "é▁x ▁", "x" * 3000, "\U0001f600 ‡ ñ\tz ", "trail   "]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "q", 1)], "doc_id bigint, text string, n_pieces int")
    enc = S.encode_and_sample(docs, PATH, k=2, with_ids=with_ids)
    rows = enc.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "q" if r["doc_id"] is None else texts[r["doc_id"]]
        want = S.vocabulary(PATH).sp.encode(text or "")
        assert r["n_pieces"] == len(want), text
        assert r["round_trip"]
        if with_ids:
            assert list(r["ids"]) == want
            assert all(S.vocabulary(PATH).decode(s["ids"]) == (text or "").replace(S.MARK, " ") for s in r["samples"])
    if with_ids:
        back = {r["doc_id"]: r["text"] for r in S.decode(enc, PATH).collect()}
        assert back[3] == texts[3] and back[0] == ""
    assert S.encode_and_sample(docs.limit(0), PATH).count() == 0


def test_registered_query_and_last_stage_put_out_ids(spark, tmp_path):
    import corpus_pipeline
    from lineloom.llm import queries

    texts = [None, "", "Hello  world\n\n x", "\U0001f600 \u2021 \u00f1\tz ", "plain words " * 50]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    voc = S.vocabulary(PATH)
    for out in (queries.op10_sampled_subwords(spark, str(tmp_path)), corpus_pipeline.subword_encoding(spark, docs, str(tmp_path))):
        for r in out.collect():
            text = texts[r.doc_id] or ""
            assert r.ids == voc.sp.encode(text) and r.round_trip
            assert len(r.sample_ids) == len(r.sample_hashes) and all(voc.decode(x) == text for x in r.sample_ids)


def test_ranges_of_a_block_change_nothing(monkeypatch):
    voc = S.vocabulary(PATH)
    texts = ["one text here, with a \U0001f600 and more words", "", "x", "another longer text with words " * 3]
    keys = S.mix(np.arange(4).astype(np.uint64))
    whole = S.sample_block(voc, S.Units(texts), keys, 6, True)
    monkeypatch.setattr(S, "RANGE_UNITS", 2)
    assert S.sample_block(voc, S.Units(texts), keys, 6, True) == whole


def test_known_units_change_nothing():
    """What a worker remembers of units: the ids are the library's, before, with and past the memory's bound."""
    voc = S.Vocabulary(PATH)
    for texts in (["some words here", "é▁x ▁", "\U0001f600  b"], ["words here again some", "", "new \U0001f600"], ["more"]):
        for _ in range(2):
            units = S.Units(texts)
            flat, begin, long = voc.encode(units)
            assert [flat[a : a + n].tolist() for a, n in zip(begin, long, strict=True)] == voc.encode_units(units.types)
    keys = voc.known[0]
    assert len(np.unique(keys)) == len(keys) == 11 and (np.diff(keys.astype(object)) > 0).all()


def test_each_distinct_unit_is_encoded_once_per_worker(monkeypatch):
    voc, asked = S.Vocabulary(PATH), []
    monkeypatch.setattr(voc, "encode_units", lambda units, f=voc.encode_units: asked.extend(units) or f(units))
    for _ in range(3):
        voc.encode(S.Units(["a b c d", "c d e"]))
    assert sorted(asked) == sorted(set(asked))
    monkeypatch.setattr(S, "KNOWN", 0)
    assert len(voc.encode(S.Units(["f g"]))[2]) == 2 and len(voc.known[0]) == 5
