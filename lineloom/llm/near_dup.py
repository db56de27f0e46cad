"""Exact n-gram Jaccard join of a whole corpus: classes, links and components.

Documents with the same shingle sequence collapse into one class.  Two sets
that link share one of the first ``n - ceil(0.75 n) + 1`` tokens of a common
order (corpus-frequent tokens last), so only those prefixes are compared.  The
first token that they share leaves no more of either set than its room, what
comes from it on; so a pair counts in a token only if 7 times the smaller room
is at least 3 times both sizes:

1. tokens of up to ``NEAR`` classes pair them all, larger ones each class with
   the token's centre; pairs whose largest possible overlap (bitmaps) is too
   small are dropped, the others verified exactly, and linked classes merge into
   components; larger tokens repeat it with other centres as long as it merges much;
2. larger tokens that still hold several components are joined by signature trees:
   nodes carry OR- and AND-combined bitmaps, size ranges and the component; a
   dual traversal drops node pairs inside one component and those whose largest
   possible overlap is too small.  Surviving leaf pairs are verified exactly.

A pair inside one component needs no check, so groups of thousands of near
copies cost no quadratic work, and no link between components is lost.  That is
``near_duplicates``; ``near_links`` checks all pairs and counts the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import discard, stage

SIZE = 5
#: Tokens that this share of all documents has come last in the common order, so passages that many share pair few documents.
HOT_SHARE = 0.00005
BITMAP = 16  # 64-bit words of a signature
_U = np.uint64
ROW, PART = 200, 4 << 20  # bytes of a row in a tree, and of the rows dealt to one task
GROUP = 2048  # rows of one token joined in one block; larger tokens are dealt out as pairs of blocks


#: Classes whose texts are asked for by broadcasting their ids; more are joined by a shuffle.
FEW = 200_000


def class_sets(texts: pa.Array, clashes: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, class key, second key, sorted distinct shingle hashes) of every text; key 0 and no shingles without words.

    Keys in ``clashes`` belong to several word sequences: there the second key goes into the first.
    """
    for i, j, raw, off in textnp.blocks(texts):
        h1, h2, _, _, wb = textnp.words(raw, off, True)
        grams = textnp.chain(h1, np.arange(max(0, len(h1) - SIZE + 1)), SIZE)
        with np.errstate(over="ignore"):
            place = textnp.mix(np.arange(len(h1)).astype(_U))
            for d in range(j - i):
                a, z = int(wb[d]), int(wb[d + 1])
                if a == z:
                    yield i + d, 0, 0, np.zeros(0, _U)
                    continue
                second = textnp.mix(h2[a:z] ^ place[: z - a]).sum(dtype=_U)
                seq = textnp.mix(h1[a:z] + place[: z - a]).sum(dtype=_U) ^ (second * _U(3))
                key, second = (int(x) for x in textnp.mix(np.array([seq, second], _U)).view(np.int64))
                if key in clashes:
                    key = int(textnp.mix(np.array([key, second], np.int64).view(_U))[0] ^ textnp.mix(np.array([second], np.int64).view(_U))[0]) - (1 << 63)
                yield i + d, key or 1, second, np.unique(grams[a : z - SIZE + 1]) if z - a >= SIZE else textnp.chain(h1, np.array([a]), z - a)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, class key, sorted distinct shingle hashes) of every text."""
    return ((row, key, s) for row, key, _, s in class_sets(texts))


def _prefix(s: np.ndarray, hot: np.ndarray, hot_rank: np.ndarray) -> np.ndarray:
    """The tokens of the set that come first in the common order: rare ones by hash, then frequent ones, rarest first."""
    n = len(s)
    p = n - (3 * n + 3) // 4 + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[at] == s
        cold = s[~is_hot]
        if len(cold) >= p:
            return cold[:p]
        late = s[is_hot]
        return np.concatenate([cold, late[np.argsort(hot_rank[at[is_hot]], kind="stable")][: p - len(cold)]])
    return s[:p]


def _signature(s: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """Bitmap of the set's tokens, 64 * ``words`` bits; half of a wider one folds onto the other to give the narrower."""
    sig = np.zeros(words, _U)
    bit = (s >> _U(20)) % _U(words * 64)
    np.bitwise_or.at(sig, (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    return sig


def _fold(sig: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(sig.reshape(-1, words), axis=0)


def _wide(s: np.ndarray) -> np.ndarray:
    """A bitmap with some 4 bits per token, at least as wide as the tree's."""
    return _signature(s, max(BITMAP, 1 << (len(s) * 4 // 64).bit_length()))


def _members(docs: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """(id, h, k, k2, n, token, df): a row per document with its class and set size, and rows for locally frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, seconds, sizes, sets = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), {}
            for row, key, second, s in class_sets(b.column(2), clashes):
                keys[row], seconds[row], sizes[row] = key, second, len(s)
                if key:
                    sets[key] = s
            least = max(2, int(len(sets) * HOT_SHARE / 2))
            token, df = np.unique(np.concatenate([*sets.values(), np.zeros(0, _U)]), return_counts=True)
            often = df >= least
            m, h = b.num_rows, int(often.sum())
            both = lambda x, y: pa.concat_arrays([x, pa.nulls(h, x.type)] if y is None else [pa.nulls(m, y.type), y])
            yield pa.RecordBatch.from_arrays(
                [
                    *(both(x, None) for x in (b.column(0), b.column(1), pa.array(keys), pa.array(seconds), pa.array(sizes))),
                    *(both(None, x) for x in (pa.array(token[often].view(np.int64)), pa.array(df[often].astype(np.int64)))),
                ],
                names=["id", "h", "k", "k2", "n", "token", "df"],
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h bigint, k bigint, k2 bigint, n bigint, token bigint, df bigint")


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted distinct (smaller, larger) pairs of different keys."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    keep = lo != hi
    lo, hi = lo[keep], hi[keep]
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return np.stack([lo[new], hi[new]], axis=1)


_POSTING = np.dtype([("token", "<u8"), ("k", "<i8"), ("n", "<i4"), ("room", "<i4")])
NEAR = 16  # classes of a token that are paired all with all
CENTRES = 4  # a class meets up to so many centres at once, by its tokens


def _fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sizes and rooms of postings of one token leave place for a link that begins there."""
    both = 3 * (x["n"].astype(np.int64) + y["n"])
    return 7 * np.minimum(x["room"], y["room"]).astype(np.int64) >= both


def _met(post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the postings' tokens (all of small tokens, those with the centre of larger ones), and the larger tokens' postings."""
    post = post[np.lexsort((post["k"], post["token"]))]
    post = post[_runs(post["token"], post["k"])]
    head = np.flatnonzero(_runs(post["token"]))
    count = np.diff(np.append(head, len(post)))
    large = np.repeat(count > NEAR, count)
    small, far = post[~large], post[large]
    first, second = [], []
    for step in range(1, NEAR):
        at = np.flatnonzero(small["token"][:-step] == small["token"][step:])
        if not len(at):
            break
        at = at[_fits(small[at], small[at + step])]
        first.append(small["k"][at])
        second.append(small["k"][at + step])
    by = textnp.mix(far["k"].view(_U) ^ textnp.mix(far["token"] % _U(CENTRES))) if len(far) else np.zeros(0, _U)
    far = far[np.lexsort((by, far["token"]))]
    start = _runs(far["token"])
    centre = far[start][np.cumsum(start) - 1]
    ok = _fits(far, centre)
    none = [np.zeros(0, np.int64)]
    return _distinct_pairs(np.concatenate([*first, far["k"][ok], *none]), np.concatenate([*second, centre["k"][ok], *none])), far


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return new


def _dealt(rows: np.ndarray, token: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    where = (token >> _U(40)).astype(np.int64) % buckets
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield i, rows[order[cuts[i] : cuts[i + 1]]].tobytes()


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("room", pa.int64()), ("sig", pa.binary()), ("wide", pa.binary())])


def _found(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, room: np.ndarray | None = None, sig: list[bytes] | None = None, wide: list[bytes] | None = None) -> pa.Table:
    m = len(a)
    counts = (pa.nulls(m, pa.int64()) if x is None else pa.array(x.astype(np.int64)) for x in (n, room))
    blobs = (pa.nulls(m, pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (sig, wide))
    return pa.table([pa.array(np.full(m, kind, np.int32)), pa.array(a), pa.array(b), *counts, *blobs], schema=_FOUND)


PAIR, POSTING, CLASS = 0, 1, 2


def _star(docs: DataFrame, clashes: frozenset[int], hot: np.ndarray, rank: np.ndarray, buckets: int) -> DataFrame:
    """PAIR (a, b): classes that meet in a prefix token, all or with its centre; POSTING (token a, class b, size n, room) of
    larger tokens; CLASS (a, size n, bitmaps) of each class.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sigs, prefixes = [], [], [], []
            seen: set[int] = set()
            for _, key, _, s in class_sets(b.column(0), clashes):
                if key and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sizes.append(len(s))
                    sigs.append(_wide(s))
                    prefixes.append(_prefix(s, hot, rank))
            if not keys:
                continue
            long = np.array([len(p) for p in prefixes])
            post = np.zeros(int(long.sum()), _POSTING)
            post["token"], post["k"], post["n"] = np.concatenate(prefixes), np.repeat(np.array(keys, np.int64), long), np.repeat(np.array(sizes, np.int32), long)
            post["room"] = post["n"] - (np.arange(len(post)) - np.repeat(np.cumsum(long) - long, long))
            del prefixes
            by = lambda x: textnp.mix(np.ascontiguousarray(x).view(_U))
            out = [(i, x, 0) for i, x in _dealt(post, post["token"], buckets)]
            m, home = len(out), ((by(np.array(keys, np.int64)) >> _U(40)).astype(np.int64) % buckets).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out] + home, pa.int32()), pa.array([x[2] for x in out] + [3] * len(keys), pa.int32()), pa.array([x[1] for x in out] + [x.tobytes() for x in sigs], pa.binary()),
                    pa.array([None] * m + keys, pa.int64()), pa.array([None] * m + sizes, pa.int64()),
                ],
                names=["bucket", "what", "rows", "k", "n"],
            )

    def meet(table: pa.Table) -> pa.Table:
        rows = table.filter(pa.array(table.column("what").to_numpy() == 0)).column("rows")
        pairs, far = _met(np.frombuffer(b"".join(rows.to_pylist()), _POSTING))
        classes = table.filter(pa.array(table.column("what").to_numpy() == 3))
        ks, one = np.unique(classes.column("k").to_numpy(), return_index=True)
        classes = classes.take(pa.array(one))
        wide = classes.column("rows").to_pylist()
        return pa.concat_tables(
            [
                _found(PAIR, pairs[:, 0], pairs[:, 1]),
                _found(POSTING, np.ascontiguousarray(far["token"]).view(np.int64), far["k"], far["n"], far["room"]),
                _found(CLASS, ks.astype(np.int64), ks.astype(np.int64), classes.column("n").to_numpy(), None, [_fold(np.frombuffer(x, _U), BITMAP).tobytes() for x in wide], wide),
            ]
        )

    dealt = docs.mapInArrow(spread, "bucket int, what int, rows binary, k bigint, n bigint")
    return dealt.groupBy("bucket").applyInArrow(meet, "kind int, a bigint, b bigint, n bigint, room bigint, sig binary, wide binary")


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs whose bitmaps (the wider folded to the narrower) leave room for a link."""
    side = lambda c: classes.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    src = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy() for i in (2, 3))
            ok = np.zeros(b.num_rows, bool)
            for row, (x, y) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                words = min(len(s), len(t))
                s, t = _fold(s, words), _fold(t, words)
                most = min(n[row] - int(np.bitwise_count(s & ~t).sum()), m[row] - int(np.bitwise_count(t & ~s).sum()))
                ok[row] = 7 * most >= 3 * (n[row] + m[row])
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return src.mapInArrow(run, "a bigint, b bigint")


def _sets(pairs: DataFrame, src: DataFrame, own: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """(k, tokens) of the classes in ``pairs``, from one document of each."""
    asked = pairs.select(F.col("a").alias("k")).distinct().union(pairs.select(F.col("b").alias("k")).distinct()).distinct()
    one = stage(own.join(asked, "k").groupBy("k").agg(F.min(F.struct("id", "h")).alias("one")).select(F.col("one.id").alias("_id"), F.col("one.h").alias("_h"), F.col("k").alias("_k")), "asked")
    asked = F.broadcast(one) if one.count() <= FEW else one
    texts = src.join(asked, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id"))).select("_k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            want, keys, sets = b.column(0).to_numpy(), [], []
            for row, key, _, s in class_sets(b.column(1), clashes):
                if key == want[row] and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["k", "tokens"])

    # equal rows may have given a class more than once
    return texts.mapInArrow(run, "k bigint, tokens binary").groupBy("k").agg(F.first("tokens").alias("tokens"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose sets have 100 * intersection >= 75 * union.

    A class that is in many pairs is joined from several copies, each with a share of the pairs.
    """
    ends = pairs
    for c in ("a", "b"):
        copies = pairs.groupBy(c).count().select(F.col(c).alias("k"), F.ceil(F.col("count") / GROUP).cast("int").alias("copies"))
        dealt = sets.join(copies, "k").select(F.col("k").alias(c), "copies", F.col("tokens").alias(f"tokens_{c}"))
        few = dealt.select(c, f"tokens_{c}", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        turn = copies.where("copies > 1").select(F.col("k").alias(c), "copies")
        ends = ends.join(F.broadcast(turn) if turn.limit(FEW + 1).count() <= FEW else turn, c, "left")
        other = "b" if c == "a" else "a"
        ends = ends.withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies").join(few, [c, "copy"]).drop("copy")
    src = ends.select("a", "b", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= 75 * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return src.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(k, root): every node of ``edges`` (a, b) with the smallest node of its component.

    Alternating large-star and small-star steps, the edge table staged after
    each, until it holds stars alone: no node has two edges up, or edges both ways.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while True:
        ends = e.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").first() is None:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = stage(small.where("u <> v").distinct(), name)
        discard(e, large)
        e = after
    return e.select(F.col("u").alias("k"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("k"), F.col("v").alias("root"))).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what ``labels`` has together and of more links."""
    return labels if links.first() is None else stage(components(labels.select(F.col("k").alias("a"), F.col("root").alias("b")).unionByName(links)), "labels")


class Tree:
    """Signature tree over rows ordered by component and size, with the rooms of one token; level 0 are the rows."""

    FAN = 8

    def __init__(self, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, room: np.ndarray | None = None):
        self.levels = [(comp, n, n, sig, sig, n if room is None else room)]
        while len(self.levels[-1][0]) > 1:
            c, lo, hi, some, every, room = self.levels[-1]
            at = np.arange(0, len(c), self.FAN)
            first, last = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            self.levels.append(
                (np.where(first == last, first, -1), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at), np.maximum.reduceat(room, at))
            )

    def survives(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Node pairs that may hold a link between components: sizes fit and the largest overlap reaches the least required."""
        c, lo, hi, some, every, room = self.levels[level]
        ok = ((c[x] != c[y]) | (c[x] == -1)) & (4 * hi[y] >= 3 * lo[x]) & (4 * hi[x] >= 3 * lo[y]) & (7 * np.minimum(room[x], room[y]) >= 3 * (lo[x] + lo[y]))
        x, y = x[ok], y[ok]
        ones = lambda v: np.bitwise_count(v).sum(axis=1, dtype=np.int64)
        most = np.minimum(hi[x] - ones(every[x] & ~some[y]), hi[y] - ones(every[y] & ~some[x]))
        ok[ok] = 7 * most >= 3 * (lo[x] + lo[y])
        return ok

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs left by the dual traversal, depth by depth from the root, in slices."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while stack:
            level, x, y = stack.pop()
            if len(x) > 4096:
                stack += [(level, x[:4096], y[:4096]), (level, x[4096:], y[4096:])]
                continue
            ok = self.survives(level, x, y)
            if level == 0:
                ok &= x < y
            x, y = x[ok], y[ok]
            if level == 0:
                xs.append(x)
                ys.append(y)
            elif len(x):
                size = len(self.levels[level - 1][0])
                i, j = np.divmod(np.arange(self.FAN**2), self.FAN)
                cx, cy = (x[:, None] * self.FAN + i).ravel(), (y[:, None] * self.FAN + j).ravel()
                keep = (cx < size) & (cy < size) & (cx <= cy)
                stack.append((level - 1, cx[keep], cy[keep]))
        return np.concatenate(xs), np.concatenate(ys)


def _again(postings: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(a, b): in each token that holds several components, every class of another component than its centre with that centre.

    Each turn has other centres; a row per posting at most.
    """
    named = postings.join(labels, "k", "left").withColumn("root", F.coalesce("root", "k"))
    centre = F.min(F.struct(F.xxhash64("k", F.pmod("token", F.lit(CENTRES)), F.lit(turn)).alias("by"), "k", "root", "n", "room")).alias("c")
    centres = named.groupBy("token").agg(centre, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token", "c")
    fits = (F.col("root") != F.col("c.root")) & (7 * F.least("room", "c.room") >= 3 * (F.col("n") + F.col("c.n")))
    return named.join(centres, "token").where(fits).select(F.greatest("k", F.col("c.k")).alias("a"), F.least("k", F.col("c.k")).alias("b")).distinct()


def _tree_pairs(postings: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(a, b): class pairs of different components that a signature tree of some shared prefix token can't rule out.

    Without ``labels`` every class is a component of its own.
    """
    roots = classes.select(F.col("a").alias("k"), "n", "sig")
    roots = roots.withColumn("root", F.col("k")) if labels is None else roots.join(labels, "k", "left").withColumn("root", F.coalesce("root", "k"))
    named = postings.join(roots.select("k", "root"), "k")
    spans = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    rows = stage(named.join(spans.where("lo <> hi").select("token"), "token").select("token", "k", "room"), "mixed-rows")
    parts = max(64, rows.count() * ROW // PART)  # the fewer, the fewer pairs come from several
    count = rows.groupBy("token").count().select("token", F.ceil(F.col("count") / GROUP).cast("int").alias("g"))
    block = F.when(F.col("g") > 1, F.pmod(F.xxhash64("k"), F.col("g")).cast("int")).otherwise(0)
    dealt = (
        rows.join(count, "token")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .join(roots, "k")
        .select(
            F.when(F.col("g") > 1, F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))).otherwise(F.pmod("token", F.lit(parts))).alias("part"),
            "token", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "k", "root", "n", "sig", "room",
        )
    )

    def join_part(table: pa.Table) -> pa.Table:
        t = table.sort_by([("token", "ascending"), ("bi", "ascending"), ("bj", "ascending"), ("root", "ascending"), ("n", "ascending"), ("k", "ascending")])
        token, bi, bj, k, root, n, room = (t.column(c).to_numpy() for c in ("token", "bi", "bj", "k", "root", "n", "room"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), _U).reshape(-1, BITMAP)
        new = np.ones(len(k), bool)
        new[1:] = (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        cuts = np.append(np.flatnonzero(new), len(k))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = Tree(np.unique(root[s:e], return_inverse=True)[1], n[s:e], sig[s:e], room[s:e]).pairs()
            a.append(k[s:e][x])
            b.append(k[s:e][y])
        pairs = _distinct_pairs(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("part").applyInArrow(lambda t: join_part(t), "a bigint, b bigint").distinct()


class _Parts:
    """What both joins start from: rows with class and size, star pairs, postings of shared tokens, classes with bitmaps."""

    def __init__(self, docs: DataFrame, text_col: str, id_col: str):
        self.src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
        self.clashes: frozenset[int] = frozenset()
        while True:  # once, unless two word sequences share a 64-bit key
            members = stage(_members(self.src, self.clashes), "members")
            self.own = members.where("k is not null").select("id", "h", "k", "n")
            keys = members.where("k <> 0").groupBy("k").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).where("lo <> hi")
            more = {r["k"] for r in keys.select("k").collect()}  # some rows ** 2 / 2 ** 65
            if not more:
                break
            self.clashes |= more
        totals = self.own.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.buckets = max(64, int((totals[1] or 0) / 4 * 24 / (4 << 20)))
        # at most (mean set size / HOT_SHARE) tokens can be in that share of documents
        hot_rows = members.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= max(4, int(totals[0] * HOT_SHARE))).toArrow()
        token, df = hot_rows.column("token").to_numpy().view(_U), hot_rows.column("df").to_numpy()
        order = np.argsort(token)
        found = stage(_star(self.src.select("text"), self.clashes, token[order].copy(), df[order].copy(), self.buckets), "star")
        self.pairs = found.where(F.col("kind") == PAIR).select("a", "b").distinct()
        self.postings = found.where(F.col("kind") == POSTING).select(F.col("a").alias("token"), F.col("b").alias("k"), "n", "room")
        self.classes = found.where(F.col("kind") == CLASS).select("a", "n", "sig", "wide")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of ``pairs`` that link."""
        pairs = stage(_possible(pairs, self.classes), f"{name}-possible")
        if pairs.first() is None:
            return pairs
        sets = stage(_sets(pairs, self.src, self.own, self.clashes), f"{name}-sets")
        out = stage(_linked(pairs, sets), name)
        discard(sets, pairs)
        return out


def near_links(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, class_id, n_links) for every row: class_id is the smallest id of the rows with the same words, n_links the number of other rows that link to it.

    Rows of one class link to each other.  Links between classes are all
    verified, those inside one component too, so a group of n near copies costs
    up to n * n / 2 checks of classes.  Rows without words have their own id and
    no links; null ids, repeated rows and long texts as in ``near_duplicates``.
    """
    p = _Parts(docs, text_col, id_col)
    links = p.verified(stage(p.pairs.unionByName(_tree_pairs(p.postings, p.classes, None)).distinct(), "tree-pairs"), "all-links")
    classes = p.own.where("k <> 0").groupBy("k").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("k").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others")).withColumnRenamed("a", "k")
    found = classes.join(others, "k", "left").select("k", "class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return p.own.join(found, "k", "left").select(
        F.col("id").alias(id_col), F.when(F.col("k") == 0, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) for every row: component_id is the smallest id reachable by links.

    Words are maximal runs of non-space characters with A-Z lower-cased, sets
    hold distinct 5-word shingles (a shorter text is one shingle); two texts link
    when 100 * intersection >= 75 * union.  Null, empty and word-less texts have
    0 shingles and form their own component.  A null id takes its component's
    smallest id and never names one; repeated rows each get their row.  Texts
    are taken whole, a long one as a block of its own; only ``text_col`` and
    ``id_col`` are read, so no other column's name matters.
    """
    p = _Parts(docs, text_col, id_col)
    links = p.verified(p.pairs, "links")
    had = links.count()
    labels = stage(components(links), "labels")
    turn = 0
    while p.postings.first() is not None:  # groups of near copies come together before their pairs are looked at; what does not is left to the trees
        turn += 1
        found = p.verified(_again(p.postings, labels, turn), "links")
        more = found.count()
        if not more:
            break
        labels = _joined(labels, found)
        if more < 0.02 * had:
            break
        had += more
    if turn:
        rest = stage(_tree_pairs(p.postings, p.classes, labels), "tree-pairs")
        if rest.first() is not None:
            labels = _joined(labels, p.verified(rest, "late-links"))
    classes = p.own.select("k").distinct().join(labels, "k", "left").select("k", F.coalesce("root", "k").alias("root"))
    smallest = p.own.where("k <> 0").groupBy("k").agg(F.min("id").alias("low")).join(classes, "k").groupBy("root").agg(F.min("low").alias("component_id"))
    class_of = classes.join(smallest, "root").select("k", "component_id")
    return p.own.join(class_of, "k", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("k") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
