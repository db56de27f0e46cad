"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's probability is logistic in its
words and word parts, a document's the noisy-or of its sentences.  Only document labels are
needed to train; the fitted model then points at the sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp

BITS = 20
LEAK = 1e-4
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), 0x27, *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


PREFIXES, SUFFIXES = (2, 3, 4, 5, 6), (3, 4, 5)
WIDTH = 1 + len(PREFIXES) + len(SUFFIXES)


def instances(raw: np.ndarray, off: np.ndarray):
    """Feature indices of each word (its whole, its first and last bytes), whether it opens a sentence, its text, start and end."""
    h, start, end, wb = textnp.words(raw, off, space=_OUTSIDE)
    n = len(h)
    feats = np.empty((n, WIDTH), np.int32)
    shift = np.uint64(64 - BITS)
    feats[:, 0] = h >> shift
    if n:
        low = textnp._LOWER[raw]
        head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        col = 1
        for k in range(max(PREFIXES)):
            head = (head << np.uint64(8)) | low[np.minimum(start + k, end - 1)]
            if k + 1 in PREFIXES:
                feats[:, col] = textnp.mix(head * np.uint64(16) + np.uint64(k)) >> shift
                col += 1
        for k in range(max(SUFFIXES)):
            tail = (tail << np.uint64(8)) | low[np.maximum(end - 1 - k, start)]
            if k + 1 in SUFFIXES:
                feats[:, col] = textnp.mix(tail * np.uint64(16) + np.uint64(8 + k)) >> shift
                col += 1
    stops = np.cumsum(_STOP[raw]) if len(raw) else np.zeros(0, np.int64)
    text_of = np.searchsorted(wb, np.arange(n), "right") - 1
    key = stops[start] + text_of if n else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    return feats, new, text_of, start, end


def held_out(doc_id):
    """True for the fifth of documents whose labels are never used."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(feats: list[np.ndarray], new: list[np.ndarray], y: np.ndarray, weight: np.ndarray, *, min_docs: int = 5, min_z: float = 4.0, rounds: int = 150, l2: float = 2e-4):
    """Feature indices, their weights and the sentence bias; full-batch Adam on the weighted noisy-or likelihood.

    Features are first screened: in at least ``min_docs`` bags, and in
    significantly more positive than negative ones.
    """
    pos, neg = (np.zeros(1 << BITS, np.int32) for _ in range(2))
    for f, label in zip(feats, y, strict=True):
        (pos if label == 1 else neg)[np.unique(f)] += 1
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    share = (pos + neg) / (n1 + n0)
    z = (pos / n1 - neg / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    vocab = np.flatnonzero((pos + neg >= min_docs) & (z >= min_z))
    if len(vocab) == 0:
        return np.zeros(0, np.int64), np.zeros(0), -8.0
    col = np.full(1 << BITS, -1, np.int32)
    col[vocab] = np.arange(len(vocab))
    words, sentence, s_doc, at = [], [], [], 0
    for d, (f, first) in enumerate(zip(feats, new, strict=True)):
        if not len(first):
            continue
        own = np.cumsum(np.append(True, first[1:])) - 1
        c = col[f.reshape(-1, WIDTH)]
        row, k = np.nonzero(c >= 0)
        words.append(c[row, k])
        sentence.append(own[row] + at)
        s_doc.append(np.full(own[-1] + 1, d))
        at += own[-1] + 1
    words, sentence, s_doc = (np.concatenate(x) for x in (words, sentence, s_doc))
    n_s, n_d = len(s_doc), len(y)
    theta, bias = np.zeros(len(vocab)), -6.0
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    scale = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(sentence, theta[words], n_s), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_no = np.bincount(s_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_d) + np.log1p(-LEAK)
        p_doc = np.clip(-np.expm1(log_no), 1e-9, 1 - 1e-12)
        # d(-loglik)/dz_s: p_s for negatives, -p_s (1 - p_doc) / p_doc for positives
        g_doc = np.where(y == 1, -(1 - p_doc) / p_doc, 1.0) * scale
        g_s = g_doc[s_doc] * p
        g = np.append(np.bincount(words, g_s[sentence], len(vocab)) + l2 * theta / len(vocab) ** 0.5, g_s.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta -= step[:-1]
        bias -= step[-1]
    return vocab, theta, float(bias)


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", max_rows: int = 3000) -> tuple[np.ndarray, float]:
    """Weight of every feature index and the sentence bias.

    Fits on at most ``max_rows`` labelled documents of either class (those of
    smallest id hash; the bound of this fit), weighted back to the classes'
    shares.  The sample's ids are bounded, so they are broadcast; the
    sample's features meet in one task, its weights come to the driver.
    """
    usable = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max("toxic").cast("int").alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return np.zeros(1 << BITS, np.float32), -8.0
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_rows).withColumn("w", F.lit(sizes[y] / min(sizes[y], max_rows)))
        picked = part if picked is None else picked.unionByName(part)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "_id").select("t", "y", "w")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f_out, n_out = [], []
            for _, _, raw, off in textnp.blocks(b.column(0)):
                feats, new, text_of, _, _ = instances(raw, off)
                cut = np.searchsorted(text_of, np.arange(1, len(off) - 1))
                f_out += [x.tobytes() for x in np.split(feats, cut)]
                n_out += [x.tobytes() for x in np.split(new, cut)]
            yield pa.RecordBatch.from_arrays([pa.array(f_out, pa.binary()), pa.array(n_out, pa.binary()), b.column(1), b.column(2)], names=["f", "n", "y", "w"])

    def fit_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("f", "ascending"), ("y", "ascending")])  # one order, whatever the shuffle's
        feats = [np.frombuffer(x.as_py(), np.int32) for x in table.column("f")]
        new = [np.frombuffer(x.as_py(), bool) for x in table.column("n")]
        vocab, theta, bias = fit(feats, new, table.column("y").to_numpy(), table.column("w").to_numpy())
        return pa.table({"i": pa.array(np.append(vocab, -1), pa.int64()), "v": pa.array(np.append(theta, bias), pa.float64())})

    rows = (
        joined.mapInArrow(featurise, "f binary, n binary, y int, w double")
        .groupBy(F.lit(0).alias("g"))
        .applyInArrow(lambda t: fit_group(t.select(["f", "n", "y", "w"])), "i bigint, v double")
        .toArrow()
    )
    out, bias = np.zeros(1 << BITS, np.float32), -8.0
    for i, v in zip(rows.column("i").to_numpy(), rows.column("v").to_numpy(), strict=True):
        if i < 0:
            bias = float(v)
        else:
            out[i] = v
    return out, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",), cut: float = 0.5) -> DataFrame:
    """``keep_cols``, score, predicted (score >= ``cut``) and ``sentences``: array of start, end (code points) and score of those over ``cut``.

    Row-local.  Null, empty and word-less texts score the leak probability.
    Only non-zero weights travel with the tasks.
    """
    weights, bias = model
    idx = np.flatnonzero(weights).astype(np.int32)
    val = weights[idx]
    src = docs.select(*keep_cols, docs[text_col].alias("_text"))
    kept_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = np.zeros((1 << BITS), np.float32)
        theta[idx] = val
        for b in batches:
            scores = np.empty(b.num_rows)
            found: list[list[dict]] = []
            for i, j, raw, off in textnp.blocks(b.column(b.num_columns - 1)):
                feats, new, text_of, start, end = instances(raw, off)
                log_no = np.full(j - i, np.log1p(-LEAK))
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                if len(feats):
                    at = np.flatnonzero(new)
                    p = 1 / (1 + np.exp(-np.clip(bias + np.add.reduceat(theta[feats].sum(axis=1, dtype=np.float64), at), -30, 30)))
                    log_no += np.bincount(text_of[at], np.log1p(-np.minimum(p, 1 - 1e-12)), j - i)
                    last = np.append(at[1:], len(feats)) - 1
                    hot = np.flatnonzero(p >= cut)
                    if len(hot):
                        points = np.cumsum((raw & 0xC0) != 0x80)
                        for k in hot:
                            d = text_of[at[k]]
                            base = points[off[d] - 1] if off[d] else 0
                            spans[d].append({"start": int(points[start[at[k]]] - 1 - base), "end": int(points[end[last[k]] - 1] - base), "score": float(p[k])})
                scores[i:j] = -np.expm1(log_no)
                found += spans
            scores = np.clip(np.round(scores, 9), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(scores), pa.array((scores >= cut).astype(np.int32)), pa.array(found, kind)],
                names=[*keep_cols, "score", "predicted", "sentences"],
            )

    return src.mapInArrow(run, kept_schema + "score double, predicted int, sentences array<struct<start:int,end:int,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", max_rows: int = 3000) -> DataFrame:
    """Trains on ``labels`` (doc_id, toxic) outside the held-out fifth and scores every row of ``docs``.

    Without labels of both classes every text scores the leak probability.
    Repeated rows each get their row; a null id counts as held out.
    """
    model = train(docs, labels, text_col=text_col, id_col=id_col, max_rows=max_rows)
    return score(docs, model, text_col=text_col, keep_cols=(id_col,)).withColumn("held_out", held_out(F.col(id_col)))
