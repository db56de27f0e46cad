"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts, counted over all its
training texts.  A byte is coded by the longest context that knows it, at
n / (N + q) for n of the context's N bytes and q distinct ones; what remains is
the context's escape probability, handed to the next shorter context over the
bytes that this one lacks, and at last to all 256 bytes alike.  Statistics are
frozen after training, so every context's escape is one number and a text's code
length is a sum of look-ups.  The language of least code length is the answer.

A tree keeps the (context, byte) nodes that make up at least ``1 / most`` of
their language's bytes: at most ``most`` per order, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .toxicity import held_out

ORDER = 4  # bytes of the longest context
NODES = 200_000
#: Nodes times languages of the trees that travel with one pass over the texts (a number each); one language always does.
PASS_ENTRIES = 8_000_000
FLUSH = 1_500_000
UNKNOWN = "und"


def keys(raw: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Per byte the number that it and the ``order`` bytes before it make, in its text; zero bytes stand before the text."""
    out = raw.astype(np.uint64)
    place = np.arange(len(raw)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, order + 1):
        before = np.zeros(len(raw), np.uint64)
        before[k:] = raw[:-k]
        before[place < k] = 0
        out |= before << np.uint64(8 * k)
    return out


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, key, n) of (text, lang) rows: occurrences of each byte with its ``order`` bytes before; sums by task leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(lang: str) -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held[lang]]), len(key)).astype(np.int64)

        def rows(lang: str, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

        for b in batches:
            for lang in set(b.column(1).to_pylist()):
                own = b.column(0).filter(pa.compute.equal(b.column(1), lang))
                for _, _, raw, off in textnp.blocks(own):
                    held.setdefault(lang, []).append(np.unique(keys(raw, off, order), return_counts=True))
                    if len(held[lang]) == 16:
                        held[lang] = [merge(lang)]
                    if len(held[lang][0][0]) > FLUSH:
                        yield rows(lang, *merge(lang))
                        del held[lang]
        for lang in held:
            yield rows(lang, *merge(lang))

    src = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    return src.mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def nodes(counted: DataFrame, order: int = ORDER, most: int = NODES) -> DataFrame:
    """(lang, k, ctx, byte, n, total, kinds): the nodes kept of each order ``k``, with their context's bytes and distinct bytes."""
    out = None
    level = counted.select("lang", F.lit(order).alias("k"), F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), "n")
    whole = counted.groupBy("lang").agg(F.sum("n").alias("all"))  # a row per language
    for k in range(order, -1, -1):
        per = level.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        kept = level.join(F.broadcast(whole), "lang").where(F.col("n") * most >= F.col("all")).drop("all").join(per, ["lang", "ctx"])
        part = kept.select("lang", F.lit(k).alias("k"), "ctx", "byte", "n", "total", "kinds")
        out = part if out is None else out.unionByName(part)
        if k:
            shorter = F.col("ctx").bitwiseAND((1 << (8 * (k - 1))) - 1)
            level = level.groupBy("lang", shorter.alias("ctx"), "byte").agg(F.sum("n").alias("n"))
    return out


class Trees:
    """Frozen trees of some languages: code lengths in bits by order, one column per language.

    ``code[k]`` are the bits of each known (context, byte) of order ``k``,
    ``escape[k]`` the bits that a context adds to a byte it lacks.
    """

    def __init__(self, langs: list[str], rows: dict[str, np.ndarray], order: int = ORDER):
        self.langs, self.order = langs, order
        self.key, self.code, self.ctx, self.escape = [], [], [], []
        n_lang = len(langs)
        for k in range(order + 1):
            own = rows["k"] == k
            lang, ctx, byte = rows["lang"][own], rows["ctx"][own].astype(np.uint64), rows["byte"][own].astype(np.uint64)
            p = rows["n"][own] / (rows["total"][own] + rows["kinds"][own])
            key = (ctx << np.uint64(8)) | byte
            all_key, key_at = np.unique(key, return_inverse=True)
            all_ctx, ctx_at = np.unique(ctx, return_inverse=True)
            # what the shorter contexts give to the bytes that a context knows
            shorter = 2.0 ** -self._lower(k, all_key)
            known, below = (np.zeros((len(all_ctx), n_lang)) for _ in range(2))
            np.add.at(known, (ctx_at, lang), p)
            np.add.at(below, (ctx_at, lang), shorter[key_at, lang])
            has = known > 0
            escape = np.where(has, -np.log2(np.maximum(1 - known, 1e-300) / np.maximum(1 - below, 1e-12)), 0.0)
            code = np.full((len(all_key), n_lang), np.nan)
            code[key_at, lang] = -np.log2(p)
            rest = np.isnan(code)
            code[rest] = (escape[np.searchsorted(all_ctx, all_key >> np.uint64(8))] + self._lower(k, all_key))[rest]
            self.key.append(all_key)
            self.code.append(code)
            self.ctx.append(all_ctx)
            self.escape.append(escape)

    def _lower(self, k: int, key: np.ndarray) -> np.ndarray:
        """Bits of bytes by their contexts of less than ``k`` bytes."""
        if k == 0:
            return np.full((len(key), len(self.langs)), 8.0)
        return self.bits(key & np.uint64((1 << (8 * k)) - 1), k - 1)

    def bits(self, key: np.ndarray, order: int | None = None) -> np.ndarray:
        """Code length of each key's last byte after the bytes before it, per language."""
        order = self.order if order is None else order
        out = np.zeros((len(key), len(self.langs)))
        left = np.arange(len(key))
        for k in range(order, -1, -1):
            own = key[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            table = self.key[k]
            at = np.minimum(np.searchsorted(table, own), max(len(table) - 1, 0))
            hit = table[at] == own if len(table) else np.zeros(len(own), bool)
            out[left[hit]] += self.code[k][at[hit]]
            left, own = left[~hit], own[~hit] >> np.uint64(8)
            ctx = self.ctx[k]
            if len(ctx) and len(left):
                at = np.minimum(np.searchsorted(ctx, own), len(ctx) - 1)
                found = ctx[at] == own
                out[left[found]] += self.escape[k][at[found]]
        out[left] += 8.0  # none of the languages knows the byte
        return out


def train(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", order: int = ORDER, most: int = NODES) -> list[Trees]:
    """Trees of the languages of ``docs`` outside the held-out fifth, some languages together so that each part is of bounded size.

    Counts come from all training texts.  Only kept nodes reach the driver, of
    one part's languages at a time: their number is looked up first.
    """
    from .common import stage

    taught = docs.where(~held_out(F.col(id_col))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    kept = stage(nodes(stage(counts(taught, order), "language-counts"), order, most), "language-nodes")
    parts: list[list[str]] = []
    entries = 0
    for r in kept.groupBy("lang").count().orderBy("lang").collect():  # a row per language
        if not parts or (entries + r["count"]) * (len(parts[-1]) + 1) > PASS_ENTRIES:
            parts.append([])
            entries = 0
        parts[-1].append(r["lang"])
        entries += r["count"]
    out = []
    for langs in parts:
        t = kept.where(F.col("lang").isin(langs)).toArrow()
        index = {x: i for i, x in enumerate(langs)}
        rows = {c: t.column(c).to_numpy() for c in ("k", "ctx", "byte", "n", "total", "kinds")} | {"lang": np.array([index[x] for x in t.column("lang").to_pylist()], np.int64)}
        out.append(Trees(langs, rows, order))
    return out


def code_lengths(texts: pa.Array, trees: Trees) -> np.ndarray:
    """Bits of every text in each language; equal contexts of a block are looked up once."""
    out = np.zeros((len(texts), len(trees.langs)))
    for i, j, raw, off in textnp.blocks(texts):
        if len(raw) <= 2 * textnp.BLOCK:
            spans = [(0, len(raw))]
        else:
            spans = [(a, min(a + textnp.BLOCK, len(raw))) for a in range(0, len(raw), textnp.BLOCK)]
        for a, z in spans:  # a long text in parts, each with the context before it
            lead = min(a, trees.order)
            part = raw[a - lead : z]
            cut = off if a == 0 and z == len(raw) else np.array([0, len(part)])
            own = keys(part, cut, trees.order)[lead:]
            distinct, at = np.unique(own, return_inverse=True)
            bits = trees.bits(distinct)
            text = np.repeat(np.arange(j - i), np.diff(off)) if a == 0 and z == len(raw) else np.zeros(z - a, np.int64)
            for k in range(len(trees.langs)):
                out[i:j, k] += np.bincount(text, bits[at, k], j - i)
    return out


def identify(docs: DataFrame, parts: list[Trees], *, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_cols``, lang_pred, score and bits (code length in the language found) of every row; row-local, a pass per part of the languages."""
    src = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep_cols)), F.col(text_col).alias("t"))
    kept = [f"c{i}" for i in range(len(keep_cols))]
    # least code length so far, its language, and the other languages' weight against it
    state = src.withColumns({"lang_pred": F.lit(None).cast("string"), "bits": F.lit(None).cast("double"), "others": F.lit(0.0)})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)

    def one(trees: Trees):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = len(kept)
                own = code_lengths(b.column(n), trees)
                lang, bits = b.column(n + 1).to_pylist(), np.array([np.inf if x is None else x for x in b.column(n + 2).to_pylist()])
                others = b.column(n + 3).to_numpy(zero_copy_only=False).copy()
                for k, name in enumerate(trees.langs):
                    new = own[:, k]
                    with np.errstate(over="ignore", invalid="ignore"):
                        gap = np.exp2(-np.abs(new - bits))  # 0 beside the first
                    better = new < bits
                    others = np.where(better, (others + np.isfinite(bits)) * gap, others + gap)
                    bits = np.where(better, new, bits)
                    lang = [name if better[i] else x for i, x in enumerate(lang)]
                yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(lang, pa.string()), pa.array(bits), pa.array(others)], names=b.schema.names)

        return run

    for trees in parts:
        state = state.mapInArrow(one(trees), schema)
    known = F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False)) & F.col("lang_pred").isNotNull()
    out = state.select(*kept, F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.round(1 / (1 + F.col("others")), 9)).otherwise(0.0).alias("score"), F.when(known, F.round("bits", 3)).alias("bits"))
    return out.toDF(*keep_cols, "lang_pred", "score", "bits")


def language_id(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", order: int = ORDER, most: int = NODES) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits of every row, with trees from the rows outside the held-out fifth.

    ``score`` is the posterior of the language found, all languages alike
    beforehand.  Texts that are null or have no letter, and all texts where
    nothing was taught, are ``und`` with score 0 and no bits.  Rows without a
    language teach nothing, a null id counts as held out.  Equal code lengths
    go to the language that comes first by name.  Repeated rows each get their
    row and teach as often as they stand.  Texts are read whole, long ones in
    parts of a megabyte.  Other columns don't matter.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    parts = train(plain, id_col="id", order=order, most=most)
    out = identify(plain, parts, keep_cols=("id",))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "bits")
