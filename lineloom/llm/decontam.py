"""Benchmark decontamination by latent semantic retrieval.

Words of the benchmark form the vocabulary; their document frequencies are
counted over all documents.  A one-pass randomised sketch of the TF-IDF
passages of all documents and of the benchmark gives the latent basis.  Every passage of
every document is compared with every item by cosine; candidates are confirmed
by the longest common subsequence of words and, where that is only fair, by
whether the item's answer (its last sentence) is there too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .toxicity import _OUTSIDE, _STOP

CHUNK = 12  # words; a passage is two chunks
SLICES = 16  # groups of rows that sum the tasks' matrices
_U = np.uint64
_SLOT = _U(64 - 18)
MARKS = 1 << 24  # cells of a table of documents by words


def _bag(raw: np.ndarray, off: np.ndarray, vocab: np.ndarray):
    """Vocabulary index (-1: other) and hash of each word, and word offsets of each text."""
    h, start, end, wb = textnp.words(raw, off, space=_OUTSIDE)
    return _place(h, vocab), h, wb, start, end


def _place(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted vocabulary (-1: not there): by its leading bits, searched where several begin alike."""
    if not len(vocab):
        return np.full(len(h), -1)
    slot = h >> _SLOT
    first, several = _slots(vocab.tobytes())
    at = first[slot]
    idx = np.where(vocab[at] == h, at, -1)
    rest = np.flatnonzero(several[slot])
    if len(rest):
        k = np.minimum(np.searchsorted(vocab, h[rest]), len(vocab) - 1)
        idx[rest] = np.where(vocab[k] == h[rest], k, -1)
    return idx


@lru_cache(maxsize=2)
def _slots(vocab: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By leading bits of a hash: the first word of the vocabulary with them (0 if none), whether there are more."""
    slot = np.frombuffer(vocab, _U) >> _SLOT
    first, several = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, bool)
    first[slot[::-1]] = np.arange(len(slot))[::-1]
    several[slot[1:][slot[1:] == slot[:-1]]] = True
    return first, several


@dataclass
class Items:
    """The benchmark in memory: word hashes per item, its answer's hashes, the vocabulary."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocab: np.ndarray

    @classmethod
    def load(cls, benchmark: DataFrame, max_bytes: int) -> Items:
        """Rows with a null id or without words can't be found and are left out; equal rows are one item."""
        t = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toArrow()
        if t.nbytes > max_bytes:
            raise ValueError(f"the benchmark has {t.nbytes} bytes, the bound is {max_bytes}: decontaminate against it in parts")
        ids, words, answers = [], [], []
        for i, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            data = text.encode("utf-8")
            raw, off = np.frombuffer(data, np.uint8), np.array([0, len(data)])
            h, start, end, _ = textnp.words(raw, off, space=_OUTSIDE)
            if not len(h):
                continue
            stops = np.cumsum(_STOP[raw])
            last = stops[start] == stops[start[-1]]
            ids.append(i)
            words.append(h)
            answers.append(h[last])
        return cls(ids, words, answers, np.unique(np.concatenate([*words, np.zeros(0, _U)])))


def _frequencies(docs: DataFrame, text_col: str, vocab: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents in all, and documents that hold each vocabulary word; one vector per task, summed in 16 slices."""
    n = len(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textnp.give_back()
        df, rows = np.zeros(n, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, raw, off in textnp.blocks(b.column(0)):
                idx, _, wb, _, _ = _bag(raw, off, vocab)
                doc = np.repeat(np.arange(len(wb) - 1), np.diff(wb))
                if (len(wb) - 1) * n <= MARKS:
                    held = np.zeros((len(wb) - 1, n), bool)
                    held[doc[idx >= 0], idx[idx >= 0]] = True
                    df += held.sum(axis=0)
                    continue
                pair = np.unique(doc[idx >= 0] * np.int64(max(1, n)) + idx[idx >= 0])
                df += np.bincount(pair % max(1, n), minlength=n)[:n] if n else 0
        parts = np.array_split(df, 16)
        yield pa.RecordBatch.from_arrays([pa.array(range(17), pa.int32()), pa.array([x.tobytes() for x in parts] + [np.array([rows]).tobytes()], pa.binary())], names=["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("v").to_pylist())
        return pa.table({"i": t.column("i").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    got = {r["i"]: np.frombuffer(r["v"], np.int64) for r in docs.select(text_col).mapInArrow(count, "i int, v binary").groupBy("i").applyInArrow(add, "i int, v binary").collect()}
    if not got:
        return 0, np.zeros(n, np.int64)
    return int(got[16][0]), np.concatenate([got[i] for i in range(16)])


def _sample(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """(t): the ``n`` distinct texts of least hash; copies of one text are one.  For trials; ``decontaminate`` reads all rows."""
    texts = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).where("t is not null")
    least = texts.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return texts.where(F.col("h") <= least).select("t").distinct().orderBy(F.xxhash64("t"), "t").limit(n)


def _passages(idx: np.ndarray, wb: np.ndarray, idf: np.ndarray, other: float):
    """Chunks of every text: first word, text, squared weight in all and within the vocabulary."""
    n = np.diff(wb)
    per = -(-n // CHUNK)
    doc = np.repeat(np.arange(len(n)), per)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = wb[:-1][doc] + within * CHUNK
    w2 = np.append(idf**2, other**2)[idx]  # -1 is the last
    known = np.where(idx >= 0, w2, 0.0)
    total = np.add.reduceat(w2, first) if len(first) else np.zeros(0)
    inside = np.add.reduceat(known, first) if len(first) else np.zeros(0)
    return first, doc, total, inside


def _pair(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each chunk with the next one of its text."""
    out = x.copy()
    out[:-1] += x[1:] * _same(doc, x)
    return out


def _same(doc: np.ndarray, like: np.ndarray) -> np.ndarray:
    """1 where the next chunk is of the same text."""
    return (doc[1:] == doc[:-1]).astype(like.dtype).reshape(-1, *[1] * (like.ndim - 1))


def _add_rows(out: np.ndarray, at: np.ndarray, source: np.ndarray, row: np.ndarray, step: int = 4096) -> None:
    """out[at[i]] += source[row[i]], a slice at a time, rows of one target summed together."""
    order = np.argsort(at, kind="stable")
    for a in range(0, len(order), step):
        part = order[a : a + step]
        to = at[part]
        heads = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        out[to[heads]] += np.add.reduceat(source[row[part]], heads, axis=0)


def fit_basis(texts: DataFrame, items: Items, idf: np.ndarray, other: float, rank: int, weight: float, oversample: int = 16) -> np.ndarray:
    """Vocabulary x rank basis of the passages' TF-IDF matrix A, by a one-pass Nystroem sketch of A'A.

    The sketch A'A S sums passages of every row of ``texts``: a vocabulary x
    (rank + oversample) matrix per task, whatever the corpus.  Each column of the
    orthonormal S holds a random share of the words with random signs, so a
    passage times S costs an addition per word.
    """
    vocab, n = items.vocab, len(items.vocab)
    width = min(n, rank + oversample)
    rng = np.random.default_rng(0)
    column = rng.permutation(n) % width
    entry = rng.choice([-1.0, 1.0], n) / np.sqrt(np.bincount(column, minlength=width))[column]
    weighed = entry * idf
    sketch = np.zeros((n, width))
    sketch[np.arange(n), column] = entry

    def gather(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros((n, width), np.float32)
        idx, _, wb, _, _ = _bag(raw, off, vocab)
        first, doc, total, _ = _passages(idx, wb, idf, other)
        if not len(first):
            return out
        chunk = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(idx))))
        keep = idx >= 0
        chunk, idx = chunk[keep], idx[keep]
        y = np.bincount(chunk * width + column[idx], weighed[idx], len(first) * width).astype(np.float32).reshape(-1, width)
        z = _pair(y, doc)
        del y
        z /= np.maximum(_pair(total, doc), 1e-12).astype(np.float32)[:, None]
        both = z.copy()
        both[1:] += z[:-1] * _same(doc, z)
        del z
        _add_rows(out, idx, both, chunk)
        return out * idf.astype(np.float32)[:, None]

    # the items' rows as (item, word, weight): both sources weigh the same in the basis
    row = np.repeat(np.arange(len(items.words)), [len(w) for w in items.words])
    col = np.searchsorted(vocab, np.concatenate(items.words))
    cell, times = np.unique(row * np.int64(n) + col, return_counts=True)
    row, col = np.divmod(cell, n)
    value = times * idf[col]
    value *= weight / np.sqrt(np.maximum(np.bincount(row, value**2), 1e-24))[row]
    own = np.bincount(row * width + column[col], entry[col] * value, len(items.words) * width).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textnp.give_back()
        sums = np.zeros((n, width))
        for b in batches:
            for _, _, raw, off in textnp.blocks(b.column(0), textnp.BLOCK >> 1):
                sums += gather(raw, off)
        parts = np.array_split(sums.astype(np.float32), SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in t.column("v"))
        return pa.table({"i": t.column("i").slice(0, 1), "v": pa.array([sums.tobytes()], pa.binary())})

    got = {r["i"]: np.frombuffer(r["v"]) for r in texts.mapInArrow(run, "i int, v binary").groupBy("i").applyInArrow(add, "i int, v binary").collect()}
    total = np.concatenate([got[i] for i in range(SLICES)]).reshape(n, width) if got else np.zeros((n, width))
    for a in range(0, len(row), 1 << 16):
        part = slice(a, a + (1 << 16))
        np.add.at(total, col[part], own[row[part]] * value[part, None])
    # A'A is about Y (S'Y)^-1 Y' for Y = A'A S, a little shifted so that the root exists
    total += max(1e-5 * float(np.linalg.norm(total)), 1e-12) * sketch
    core = sketch.T @ total
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = total @ (vectors / np.sqrt(np.maximum(values, 1e-9 * max(float(values[-1]), 1e-12))))
    return np.linalg.svd(half, full_matrices=False)[0][:, :rank].astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class RareWords:
    """Where a text can hold an item at all, from the item's rarer words.

    A match takes ``least`` of an item's m places in order.  Leaving out its
    commonest places, ``m - least + x`` are left, and x of them at least must be
    among the matched ones: x occurrences of their words, all within one window.
    """

    def __init__(self, items: Items, df: np.ndarray, share: float, part: float = 0.35):
        size = np.array([len(w) for w in items.words], np.int64)
        self.least = np.maximum(1, np.ceil(share * size - 1e-9)).astype(np.int64)
        self.x = np.maximum(1, np.round(part * self.least)).astype(np.int64)
        self.span = 2 * CHUNK + 2 * size  # words in the window around a passage
        word, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(items.words):
            at = np.searchsorted(items.vocab, w)
            rare = np.unique(at[np.argsort(df[at], kind="stable")][: size[i] - self.least[i] + self.x[i]])
            word.append(rare)
            item.append(np.full(len(rare), i))
        word, item = np.concatenate(word), np.concatenate(item)
        order = np.argsort(word, kind="stable")
        self.items = item[order]
        self.first = np.searchsorted(word[order], np.arange(len(items.vocab) + 1))

    def candidates(self, idx: np.ndarray, wb: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last word) of runs with x of the item's rarer words close enough; word places are the block's."""
        place = np.flatnonzero(idx >= 0)
        word = idx[place]
        n = self.first[word + 1] - self.first[word]
        place, start, n = place[n > 0], self.first[word[n > 0]], n[n > 0]
        item = self.items[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        place = np.repeat(place, n)
        doc = np.searchsorted(wb, place, "right") - 1
        group = doc * np.int64(len(self.x)) + item
        order = np.argsort(group, kind="stable")  # places stay in order
        group, place, item = group[order], place[order], item[order]
        last = np.arange(len(group)) + self.x[item] - 1
        inside = np.minimum(last, len(group) - 1)
        hit = np.flatnonzero((last < len(group)) & (group[inside] == group) & (place[inside] - place < self.span[item]))
        if not len(hit):
            return
        a, z, g, reach = place[hit], place[inside[hit]], group[hit], self.span[item[hit]]
        new = np.ones(len(hit), bool)  # runs whose windows can't overlap are apart
        new[1:] = (g[1:] != g[:-1]) | (a[1:] - z[:-1] > reach[1:])
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(hit)) - 1
        for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
            d, i = divmod(int(g[h]), len(self.x))
            yield d, i, int(a[h]), int(z[e])


MATCH = "struct<item_id:bigint,ratio:double>"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", rank: int = 192, cosine: float = 0.2,
    sure: float = 0.8, fair: float = 0.6, answer: float = 0.8, max_bytes: int = 256 << 20, exact: bool = True,
) -> DataFrame:
    """``docs`` plus ``matches`` (item_id and share of its words found in order, best first) and ``contaminated``.

    Only passages with enough of an item's rarer words around them can match; of
    these, one whose cosine with an item is at least ``cosine`` is a candidate.
    With ``exact`` so is each of them, whatever its cosine: nothing depends on
    the basis then.
    A candidate matches if the item's longest common subsequence with the words around
    holds ``sure`` of the item, or ``fair`` of it and ``answer`` of its answer.
    All documents' frequencies count, the basis is fitted on every passage of all
    rows, every passage is searched.  The benchmark is held in memory (checked against ``max_bytes``).  Null, empty
    and word-less texts match nothing, an empty benchmark matches nobody,
    repeated rows each get their row, columns of ``docs`` named matches or
    contaminated are replaced.  Row-local but for counts and basis.
    """  # noqa: E501
    docs = docs.drop("matches", "contaminated")
    items = Items.load(benchmark, max_bytes)
    names = docs.columns
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", matches array<{MATCH}>, contaminated boolean"
    at = names.index(text_col)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("ratio", pa.float64())]))
    vocab, rows = items.vocab, 0
    if items.ids:
        rows, df = _frequencies(docs, text_col, vocab)
    if rows:
        idf = np.log((1 + rows) / (1 + df)) + 1
        other = float(np.log(1 + rows)) * 0.75
        texts = docs.select(text_col)
        passages = texts.agg(F.sum(F.length(text_col))).first()[0] or 0
        basis = fit_basis(texts, items, idf, other, rank, max(1.0, (passages / 6 / CHUNK / len(items.ids)) ** 0.5))
        query = np.zeros((len(items.ids), basis.shape[1]), np.float32)
        for i, w in enumerate(items.words):
            v = np.searchsorted(vocab, w)
            query[i] = (basis[v] * idf[v, None]).sum(axis=0)
        query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-9)
        table = (basis * idf[:, None]).astype(np.float32)
    else:
        idf, other, table, query = np.zeros(len(vocab)), 1.0, np.zeros((len(vocab), 1), np.float32), np.zeros((0, 1), np.float32)

    rare = RareWords(items, df, min(sure, fair)) if rows else None

    def search(raw: np.ndarray, off: np.ndarray) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
        if not len(query):
            return out
        idx, h, wb, _, _ = _bag(raw, off, vocab)
        first, doc, total, inside = _passages(idx, wb, idf, other)
        if not len(first):
            return out
        last = np.append(first[1:], len(idx))
        nxt = np.minimum(np.arange(len(first)) + 1, len(first) - 1)
        end = np.where(doc[nxt] == doc, last[nxt], last)
        best: dict[tuple[int, int], float] = {}

        def confirm(d: int, i: int, a: int, z: int) -> float:
            """Share of item ``i`` in words ``a`` to ``z``, kept if it is a match."""
            w, around = items.words[i], h[a:z]
            share = lcs(w, around) / len(w)
            if share >= sure or (share >= fair and lcs(items.answers[i], around) >= answer * len(items.answers[i])):
                best[d, i] = max(best.get((d, i), 0.0), share)
            return share

        # passages whose windows touch a run of an item's rarer words: no other can match
        chunks = np.searchsorted(doc, np.arange(len(wb)))
        runs = []
        within = np.zeros(len(first), bool)
        for d, i, one, other_end in rare.candidates(idx, wb):
            m, c = len(items.words[i]), np.arange(chunks[d], chunks[d + 1])
            a, z = np.maximum(wb[d], first[c] - m), np.minimum(wb[d + 1], end[c] + m)
            near = np.flatnonzero((z > one) & (a <= other_end))
            within[c[near]] = True
            runs.append((d, i, a, z, near))
        reach = {(d, i, int(chunks[d] + p)) for d, i, _, _, near in runs for p in near}
        for p, i in latent(idx, first, doc, total, inside, within):
            d, m = int(doc[p]), len(items.words[i])
            if (d, i, p) in reach and best.get((d, i), 0.0) < 1.0:
                confirm(d, i, max(int(wb[d]), int(first[p]) - m), min(int(wb[d + 1]), int(end[p]) + m))
        for d, i, a, z, near in runs if exact else ():
            if best.get((d, i), 0.0) >= 1.0:
                continue
            if len(near) > 1 and lcs(items.words[i], h[a[near[0]] : z[near[-1]]]) < rare.least[i]:
                continue  # what the whole run lacks, each of its passages lacks
            for p in near:
                if best.get((d, i), 0.0) >= 1.0:
                    break
                confirm(d, i, int(a[p]), int(z[p]))
        for (d, i), share in sorted(best.items(), key=lambda x: (-x[1], items.ids[x[0][1]])):
            out[d].append({"item_id": items.ids[i], "ratio": share})
        return out

    def latent(idx: np.ndarray, first: np.ndarray, doc: np.ndarray, total: np.ndarray, inside: np.ndarray, within: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, item) of every cosine that is high enough, among the passages ``within``."""
        norm2, mass = _pair(total, doc), _pair(inside, doc)
        live = np.flatnonzero(mass >= cosine**2 * norm2 * 0.99)
        live = live[(mass[live] > 0) & within[live]]
        if not len(live):
            return
        need = np.zeros(len(first) + 1, bool)
        need[live] = True
        need[1:][live[live + 1 < len(first)]] = True
        word = np.flatnonzero(idx >= 0)
        chunk = np.searchsorted(first, word, "right") - 1
        word, chunk = word[need[chunk]], chunk[need[chunk]]
        vec = np.zeros((len(first), table.shape[1]), np.float32)
        if len(word):
            heads = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            vec[chunk[heads]] = np.add.reduceat(table[idx[word]], heads, axis=0)
        nxt = np.minimum(live + 1, len(first) - 1)
        joined = vec[live] + np.where((doc[nxt] == doc[live]) & (nxt > live), 1.0, 0.0)[:, None].astype(np.float32) * vec[nxt]
        near = (joined @ query.T) / np.sqrt(np.maximum(norm2[live], 1e-9))[:, None]
        for p, i in zip(*np.nonzero(near >= cosine), strict=True):
            yield int(live[p]), int(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textnp.give_back()
        for b in batches:
            found = [x for _, _, raw, off in textnp.blocks(b.column(at)) for x in search(raw, off)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind), pa.array([bool(x) for x in found], pa.bool_())], names=[*names, "matches", "contaminated"])

    return docs.mapInArrow(run, out_schema)
