"""Token alignment against both libraries over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P

from lineloom.llm import alignment
from lineloom.llm.common import ship
from lineloom.llm.token_counts import _bytes_to_chars

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "plain words, and more words", "a  b   c", "x\n\n  y \n z", "<|endoftext|> and <s> in </s> text", "▁ mark", "nb\xa0sp a　 b", "tab\t \tx", "é́ \U0001f600 ñandú 漢字 かな 。 x", "end ", "  lead",
    "don't we'll 12345 67 a1b2", "q" * 3000, "aaaa " * 200, "plain words, and more words", "\x00 \x85 y", "zero​ width ﻿ mark",
]


def brute(texts):
    from tokenizers import Tokenizer
    from sentencepiece import SentencePieceProcessor

    a_side, b_side = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a_side.encode_special_tokens = True
    back = {c: b for b, c in _bytes_to_chars().items()}
    raw_a = lambda i: bytes(back[c] for c in a_side.id_to_token(i))
    raw_b = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for t in texts:
        groups = []
        if t:
            a, b = a_side.encode(f" {t}", add_special_tokens=False).ids, b_side.encode(t)
            ra, rb = list(map(raw_a, a)), list(map(raw_b, b))
            if b"".join(ra) == b"".join(rb) == f" {t}".encode():
                ends = lambda r: [sum(map(len, r[: i + 1])) for i in range(len(r))]
                ea, eb = ends(ra), ends(rb)
                i = j = 0
                for c in sorted(set(ea) & set(eb)):
                    groups.append((a[i : ea.index(c) + 1], b[j : eb.index(c) + 1]))
                    i, j = ea.index(c) + 1, eb.index(c) + 1
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        docs.append((groups, links))
        count.update(links.keys())
    most_a, most_b = defaultdict(int), defaultdict(int)
    for (x, y), n in count.items():
        most_a[x], most_b[y] = max(most_a[x], n), max(most_b[y], n)
    out = []
    for groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == most_a[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "", sum(n for p, n in links.items() if count[p] == most_b[p[1]]),
        ))
    return out


def test_equals_the_libraries(spark, monkeypatch):
    ship(spark)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "a  b"), (3, TEXTS[3])], "doc_id bigint, text string").repartition(3)
    want = brute([*TEXTS, "a  b", TEXTS[3]])
    keys = [*range(len(TEXTS)), None, 3]
    got = alignment.aligned_tokens(docs, *PATHS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, *w) for k, w in zip(keys, want, strict=True)), key=str)
    assert want[7][0] == 0 and want[4][3] > 0  # a mark in the text is not given back


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned_tokens(docs, *PATHS).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])


def pairs_of(block, row):
    """Pairs of one document of a block, with their occurrences."""
    ends = [0, *block.doc_len.cumsum().tolist()]
    own = slice(ends[row], ends[row + 1])
    return dict(zip(block.pairs[block.doc_pair.cumsum()[own]].tolist(), block.doc_times[own].tolist(), strict=True))


def test_blocks_and_pieces_do_not_matter(monkeypatch):
    texts = [*(t for t in TEXTS if t), "all of these words in many pieces " * 40, "ab " * 90 + "▁"]
    tools = alignment.tokenizers(*PATHS)
    whole = alignment.Block(tools, texts)
    held = Counter()
    monkeypatch.setattr(alignment, "PART", 50)
    for row, t in enumerate(texts):
        one = alignment.Block(tools, [t])
        held.update(dict(zip(one.pairs.tolist(), one.held.tolist(), strict=True)))
        assert one.sha == [whole.sha[row]] and one.figures[0].tolist() == whole.figures[row].tolist()
        assert pairs_of(one, 0) == pairs_of(whole, row)
    assert dict(zip(whole.pairs.tolist(), whole.held.tolist(), strict=True)) == held
    assert whole.sha[-1] == "" and not whole.figures[-1].any() and whole.figures[-2][0] > 200


def test_large_groups_are_counted_first(monkeypatch):
    tools = alignment.tokenizers(*PATHS)
    texts = [t for t in TEXTS if t]
    plain = alignment.Block(tools, texts)
    monkeypatch.setattr(alignment, "BIG", 1)
    big = alignment.Block(tools, texts)
    assert big.figures.tolist() == plain.figures.tolist() and big.held.tolist() == plain.held.tolist() and big.doc_times.tolist() == plain.doc_times.tolist()


def test_merge_of_ends():
    ends = lambda *sizes: np.cumsum(np.array(sizes, np.int64))
    a, b = alignment.merged(ends(1, 2, 3), ends(3, 1, 2))
    assert a.tolist() == [False, True, True] and b.tolist() == [True, False, True]
    a, b = alignment.merged(ends(2, 2, 2), ends(1, 2, 2, 1))
    assert a.tolist() == [False, False, True] and b.tolist() == [False, False, False, True]
    assert [x.tolist() for x in alignment.merged(ends(), ends())] == [[], []]


def test_minds_no_column_name_and_no_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "k"), (1, "a b", 7, "k"), (2, None, 8, None)], "doc_id bigint, text string, pairs int, n_a string")
    out = alignment.aligned_tokens(docs, *PATHS, keep_cols=("doc_id", "n_a", "pairs"))
    assert out.columns[:4] == ["doc_id", "n_a", "pairs", "n_a"]
    assert sorted((tuple(r)[:4] for r in out.collect()), key=str) == [(1, "k", 7, 2), (1, "k", 7, 2), (2, None, 8, 0)]
    assert alignment.aligned_tokens(docs.limit(0), *PATHS).count() == 0
