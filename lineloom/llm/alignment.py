"""Alignment of two tokenizers' tokens, with corpus-wide counts of the id pairs they link.

Texts are cut into units in front of a space that follows a word character:
neither tokenizer has a token across such a cut, so of all the equal units of a
block one is encoded and aligned.  The cumulative token ends of both sides are
merged; where both end, a group closes, and its tokens are linked with one
another.

Documents are packed into blocks.  A block has each id pair once, with the
number of its documents that hold it: those rows are summed by pair, maxima per
id are taken, and what a block's pairs count comes back to it in one row.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .subwords import MARK
from .token_counts import _bytes_to_chars

#: A space after a character that no notion of white space holds.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​⁠﻿])(?= )")
#: Text that is aligned together, and text whose documents share a block.
PART, BLOCK = 3 << 19, 6 << 20
SIDE = 32  # bits of an id in a pair's key
BIG = 4096  # links of a group beyond which equal ones are counted first


#: Units that go to a tokenizer as one text, where it is sure to cut between them.
JOINED = 64


class Side:
    """A tokenizer as a function from texts (each with a space in front) to lists of ids, with the bytes of every id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], raw: list[bytes]):
        self.encode, self.raw = encode, raw
        self.size = np.array([len(x) for x in raw], np.int64)

    def units(self, names: list[str], sure: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and the unit of each; ``size`` are their bytes.

        The first ``sure`` units end where a cut may follow: many of them are
        encoded as one text and told apart by their ends.  Where an end isn't
        found (the bytes aren't given back), they are encoded one by one.
        """
        flat, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, sure, JOINED * 128):
            hi = min(sure, lo + JOINED * 128)
            cuts = range(lo, hi, JOINED)
            lists = self.encode(["".join(names[i : min(i + JOINED, hi)]) for i in cuts])
            ids, want = np.fromiter(chain.from_iterable(lists), np.int64), np.cumsum(size[lo:hi])
            ends = np.cumsum(self.size[ids])
            if len(ends) and ends[-1] == want[-1] and (ends[np.searchsorted(ends, want)] == want).all():
                flat.append(ids)
                owner.append(lo + np.searchsorted(want, ends))
            else:
                self._one_by_one(names, lo, hi, flat, owner)
        self._one_by_one(names, sure, len(names), flat, owner)
        return np.concatenate(flat), np.concatenate(owner)

    def _one_by_one(self, names: list[str], lo: int, hi: int, flat: list[np.ndarray], owner: list[np.ndarray]) -> None:
        lists = self.encode(names[lo:hi])
        flat.append(np.fromiter(chain.from_iterable(lists), np.int64))
        owner.append(np.repeat(np.arange(lo, hi), [len(x) for x in lists]))


class Pair:
    """Both tokenizers, and every id in decimal digits with what follows it in a digest."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        back = {c: i for i, c in _bytes_to_chars().items()}
        tokens = list(map(a.id_to_token, range(a.get_vocab_size(with_added_tokens=True))))
        raw_a = [bytes(back[c] for c in t) if t is not None and all(c in back for c in t) else (t or "").encode() for t in tokens]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode() for i in range(b.get_piece_size())]
        lone = [b.piece_to_id(MARK)]  # the model puts its mark in front by itself, but not before nothing
        self.a = Side(lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)], raw_a)
        self.b = Side(lambda texts: [ids if t != " " else lone for t, ids in zip(texts, b.encode([t[1:] for t in texts], num_threads=1), strict=True)], raw_b)
        ids = range(max(len(raw_a), len(raw_b)))
        self.inner, self.last_a, self.last_b = (np.array([f"{i}{c}" for i in ids], object) for c in ",|;")


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side close a group: those whose end both sides have (ends rise on both)."""
    at = np.searchsorted(ends_b, ends_a)
    closes_a = ends_b[np.minimum(at, max(len(ends_b) - 1, 0))] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
    closes_b = np.zeros(len(ends_b), bool)
    closes_b[at[closes_a]] = True
    return closes_a, closes_b


class Units:
    """Distinct units (the first ``sure`` end where a cut may follow): whether each is given back by both sides, its figures, digest and linked pairs."""

    def __init__(self, tools: Pair, names: list[str], sure: int):
        n = len(names)
        data = [x.encode() for x in names]
        size = np.array([len(x) for x in data], np.int64)
        (a, of_a), (b, of_b) = (side.units(names, sure, size) for side in (tools.a, tools.b))
        self.ok = (np.bincount(of_a, tools.a.size[a], n) == size) & (np.bincount(of_b, tools.b.size[b], n) == size)
        for ids, of, raw in ((a, of_a, tools.a.raw), (b, of_b, tools.b.raw)):
            kept = np.flatnonzero(self.ok)
            want = np.frombuffer(b"".join([data[i] for i in kept.tolist()]), np.uint8)
            have = np.frombuffer(b"".join([raw[i] for i in ids[self.ok[of]].tolist()]), np.uint8)
            wrong = np.flatnonzero(want != have)
            self.ok[kept[np.searchsorted(np.cumsum(size[kept]), wrong, "right")]] = False
        a, of_a, b, of_b = a[self.ok[of_a]], of_a[self.ok[of_a]], b[self.ok[of_b]], of_b[self.ok[of_b]]
        # the units side by side: both sides have the same bytes, so their ends stay comparable
        closes_a, closes_b = merged(np.cumsum(tools.a.size[a]), np.cumsum(tools.b.size[b]))
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        long_a, long_b = (np.bincount(g, minlength=int(closes_a.sum())) for g in (group_a, group_b))
        begin_a, begin_b = np.cumsum(long_a) - long_a, np.cumsum(long_b) - long_b
        unit = of_a[closes_a]
        links = long_a * long_b
        self.figures = np.stack([np.bincount(x, w, n).astype(np.int64) for x, w in ((of_a, None), (of_b, None), (unit, None), (unit, links))], axis=1)
        # links, A token by A token
        small = (links <= BIG)[group_a]
        times = long_b[group_a[small]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys = [(np.repeat(a[small], times) << SIDE) | b[np.repeat(begin_b[group_a[small]], times) + step]]
        weights, owner = [np.ones(len(keys[0]), np.int64)], [np.repeat(of_a[small], times)]
        for g in np.flatnonzero(links > BIG).tolist():
            (p, m), (q, k) = (np.unique(ids[at : at + many], return_counts=True) for ids, at, many in ((a, begin_a[g], long_a[g]), (b, begin_b[g], long_b[g])))
            keys.append(((p << SIDE)[:, None] | q).ravel())
            weights.append((m[:, None] * k).ravel())
            owner.append(np.full(len(keys[-1]), unit[g]))
        order = slice(None) if len(owner) == 1 else np.argsort(np.concatenate(owner), kind="stable")
        self.pairs, at = np.unique(np.concatenate(keys)[order], return_inverse=True)
        self.pair, self.weight = at, np.concatenate(weights)[order]
        self.many = np.bincount(np.concatenate(owner), minlength=n)
        self.first = np.cumsum(self.many) - self.many
        # digests: a group's A ids, then its B ids
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + begin_b[group_a]] = np.where(closes_a, tools.last_a[a], tools.inner[a])
        text[np.arange(len(b)) + (begin_a + long_a)[group_b]] = np.where(closes_b, tools.last_b[b], tools.inner[b])
        text, ends = text.tolist(), np.cumsum(self.figures[:, 0] + self.figures[:, 1]).tolist()
        self.digest = ["".join(text[x:y]) for x, y in zip([0, *ends], ends, strict=False)]


def parts(texts: list[str | None], limit: int = 0) -> Iterator[list[tuple[int, str]]]:
    """Runs of (document, piece) of about ``limit`` characters; long texts are cut where units are."""
    limit = limit or PART
    out, size = [], 0
    for d, t in enumerate(texts):
        t = f" {t}" if t else ""
        at = 0
        while at < len(t):
            cut = CUT.search(t, at + limit) if len(t) - at > limit else None
            upto = cut.start() if cut else len(t)
            out.append((d, t[at:upto]))
            size += upto - at
            at = upto
            if size >= limit:
                yield out
                out, size = [], 0
    if out:
        yield out


class Block:
    """Some documents: figures and digest of each, and the pairs that it links, with their occurrences."""

    def __init__(self, tools: Pair, texts: list[str | None]):
        n = len(texts)
        self.figures, ok, sha, entries = np.zeros((n, 4), np.int64), np.ones(n, bool), [None] * n, []
        for part in parts(texts):
            cut = [CUT.split(piece) for _, piece in part]
            names = list(dict.fromkeys(chain.from_iterable(cut)))
            last = {x[-1] for x in cut if x}  # whatever a text ends with
            names = [x for x in names if x not in last] + [x for x in names if x in last]
            units = Units(tools, names, len(names) - len(last))
            place = {x: i for i, x in enumerate(names)}
            flat = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64)
            doc = np.repeat([d for d, _ in part], [len(x) for x in cut])
            ok &= np.bincount(doc, ~units.ok[flat], n) == 0
            for c in range(4):
                self.figures[:, c] += np.bincount(doc, units.figures[flat, c], n).astype(np.int64)
            at = 0
            for (d, _), x in zip(part, cut, strict=True):
                text = "".join([units.digest[i] for i in flat[at : at + len(x)].tolist()])[:-1]
                if sha[d] is None:
                    sha[d] = hashlib.sha256(text.encode())
                else:  # a later piece of a long text
                    sha[d].update(f";{text}".encode())
                at += len(x)
            entries += self._links(units, doc, flat)
        self.figures[~ok] = 0
        self.sha = [h.hexdigest() if h is not None and good else "" for h, good in zip(sha, ok.tolist(), strict=True)]
        doc, pair, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*entries, strict=True) if entries else [[]] * 3))
        good = ok[doc]
        self.pairs, at = np.unique(pair[good], return_inverse=True)
        key = doc[good] * max(len(self.pairs), 1) + at
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[good][order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(key) else times
        doc, at = np.divmod(key[first], max(len(self.pairs), 1))
        self.held = np.bincount(at, minlength=len(self.pairs))
        self.doc_len, self.doc_pair, self.doc_times = np.bincount(doc, minlength=n).astype(np.int32), np.diff(at, prepend=0).astype(np.int32), times.astype(np.int32)

    @staticmethod
    def _links(units: Units, doc: np.ndarray, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, occurrences) of units where they stand, some at a time."""
        seen, times = np.unique(doc * len(units.many) + unit, return_counts=True)
        doc, unit = np.divmod(seen, len(units.many))
        many, n_pairs, out = units.many[unit], max(len(units.pairs), 1), []
        upto = np.cumsum(many)
        i = 0
        while i < len(doc):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - many[i] + (1 << 20), "right")))
            long = many[i:j]
            at = np.repeat(units.first[unit[i:j]] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            key, where = np.unique(np.repeat(doc[i:j], long) * n_pairs + units.pair[at], return_inverse=True)
            count = np.bincount(where, np.repeat(times[i:j], long) * units.weight[at], len(key)).astype(np.int64)
            if len(key):
                d, p = np.divmod(key, n_pairs)
                out.append((d, units.pairs[p], count))
            i = j
        return out


#: The packed columns of a block: per document how many pairs, which (each as the step from the one before), how often.
PACKED = ["doc_len", "doc_pair", "doc_times"]


def _blocks(docs: DataFrame, kept: int, path_a: str, path_b: str) -> DataFrame:
    """A row per block of documents (the last column their texts): kept columns and figures as lists, packed pairs of each, pairs with their numbers of documents."""
    fields = docs.schema.fields[:-1]
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    schema = "seq bigint, " + ", ".join([*(f"{f.name} array<{f.dataType.simpleString()}>" for f in fields), *(f"{c} array<bigint>" for c in figures), "sha array<string>", *(f"{c} binary" for c in PACKED), "pairs array<bigint>", "held array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, seq = tokenizers(path_a, path_b), 0
        for b in batches:
            texts, size = b.column(kept).to_pylist(), 0
            cuts = [0]
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= BLOCK:
                    cuts.append(i + 1)
                    size = 0
            for lo, hi in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                if lo == hi:
                    continue
                k = Block(tools, texts[lo:hi])
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                cols = [pa.array([seq], pa.int64()), *(one(b.column(c).slice(lo, hi - lo)) for c in range(kept))]
                cols += [one(pa.array(k.figures[:, c])) for c in range(4)] + [one(pa.array(k.sha, pa.string()))]
                cols += [pa.array([getattr(k, c).tobytes()], pa.binary()) for c in PACKED] + [one(pa.array(k.pairs)), one(pa.array(k.held))]
                yield pa.RecordBatch.from_arrays(cols, names=["seq", *(f.name for f in fields), *figures, "sha", *PACKED, "pairs", "held"])
                seq += 1

    return docs.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best_a, best_b): documents that hold each linked pair, and whether no other pair of its id on either side has more."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("count"))
    counts = stage(counts.withColumns({"a": F.shiftright("pair", SIDE), "b": F.col("pair").bitwiseAND((1 << SIDE) - 1)}), "pair-counts")
    # a row per id of a vocabulary: tens of thousands at most
    most = {s: counts.groupBy(s).agg(F.max("count").alias(f"most_{s}")) for s in ("a", "b")}
    out = counts.join(F.broadcast(most["a"]), "a").join(F.broadcast(most["b"]), "b")
    return out.select("pair", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str, *, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_cols``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_best_b of every row.

    Side A (a byte-level BPE file) encodes a space and the text, side B (a
    piece model) the text, whose space it adds itself; special strings in
    texts are plain text.  Groups end where tokens of both sides end in the
    bytes; all tokens of a group are linked.  A pair of ids counts the
    documents that hold it linked; ``n_best`` are links whose count no other
    pair of their A id exceeds (``n_best_b``: of their B id), ``count_sum`` sums
    the counts over links.  Texts that are null, empty, or that a side's tokens
    don't give back byte by byte have zeros and an empty digest.

    Repeated rows are documents of their own; a hot pair is one row per block
    of some megabytes.  A long text is aligned in pieces that end where units
    do.  Other columns of ``docs`` don't matter, kept ones may have any name.
    An empty table gives an empty result.
    """
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep_cols)), F.col(text_col).alias("t"))
    kept = len(keep_cols)
    names = [f"c{i}" for i in range(kept)]
    packed = _blocks(plain, kept, path_a, path_b).withColumn("block", F.monotonically_increasing_id()).drop("seq")
    blocks = stage(packed, "aligned-blocks")
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best_a", "best_b"))).alias("answers"))  # a block's own pairs
    answered = blocks.drop("pairs", "held").join(answers, "block", "left")
    answered = answered.select(*names, "n_a", "n_b", "n_groups", "n_links", "sha", *PACKED, *(F.col(f"answers.{c}").alias(c) for c in ("count", "best_a", "best_b")))
    out_fields = [f for f in plain.schema.fields[:-1]]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in out_fields), *(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256 string", "n_best_b bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                at = lambda name, row=row, b=b: b.column(b.schema.get_field_index(name))[row]
                p = {c: np.frombuffer(at(c).as_py(), np.int32) for c in PACKED}
                flat = lambda name, at=at: at(name).values if at(name).is_valid else pa.array([], pa.int64())
                value = {c: flat(c).cast(pa.int64()).to_numpy() for c in ("count", "best_a", "best_b")}
                n = len(p["doc_len"])
                doc, pair = np.repeat(np.arange(n), p["doc_len"]), np.cumsum(p["doc_pair"], dtype=np.int64)
                # whole numbers below 2**53
                sums = {c: np.bincount(doc, v[pair] * p["doc_times"], n).astype(np.int64) if len(doc) else np.zeros(n, np.int64) for c, v in value.items()}
                cols = [flat(n) for n in names] + [flat(c) for c in ("n_a", "n_b", "n_groups", "n_links")] + [pa.array(sums["best_a"]), pa.array(sums["count"]), flat("sha"), pa.array(sums["best_b"])]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b"])

    out = answered.mapInArrow(run, schema)
    return out.toDF(*keep_cols, *out.columns[kept:])
