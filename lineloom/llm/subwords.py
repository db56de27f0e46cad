"""SentencePiece encoding, decoding and sampled segmentations without replacement.

Encoding is the library's, computed once per distinct unit (a run of space
marks with what follows it; no vocabulary piece crosses units).  Sampling is a
Gumbel top-k over all segmentations of the whole text: perturbed log-masses are
drawn top-down, always extending the node of largest perturbed mass (A* with an
exact bound), so the k segmentations come out distinct, in order, and with the
inclusion score that the (k+1)-th value implies.  Every random number is a hash
of row key, unit, step and sample: results do not depend on batching.

The vocabulary's merge order gives the lattice its piece probabilities (Zipf's
law on the rank).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnp import AS_IS, BLOCK, give_back, mix, words

MARK = "▁"
#: Texts that share one table of distinct units (a longer text is a block of its own), and occurrences that share a lattice.
BLOCK_BYTES = 3 << 19
RANGE_UNITS = 400_000
KNOWN = 500_000  # units whose ids a worker remembers, some 20 MB
DENSE = 128  # columns of the trie's table, a power of two
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def uniform(key: np.ndarray, unit: np.ndarray, step: int, sample: int) -> np.ndarray:
    """Numbers in (0, 1) from row key, unit, step and sample."""
    return _uniform(stream(key, unit, sample), step)


def stream(key: np.ndarray, unit: np.ndarray, sample: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key ^ (unit.astype(_U) * _K1 + _U(sample + 1) * _K3))


def _uniform(base: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (base ^ _U(((step + 1) * int(_K2)) & 0xFFFFFFFFFFFFFFFF)) * _K1
        h = (h ^ (h >> _U(29))) * _K3
        h ^= h >> _U(32)
    return ((h >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Units:
    """The units of a block of texts: the distinct ones, which each occurrence is, and how many each text has."""

    def __init__(self, texts: list[str]):
        data = [t.replace(MARK, " ").encode("utf-8") for t in texts]
        raw = np.frombuffer(b"".join(data), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        found, i = [], 0
        while i < len(texts):  # some at a time: words() needs many bytes per byte
            j = min(len(texts), max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1))
            found.append((off[i], *words(raw[off[i] : off[j]], off[i : j + 1] - off[i], False, _ONLY_SPACE, AS_IS)))
            i = j
        h = np.concatenate([np.zeros(0, _U), *[x[1] for x in found]])
        start, end = (np.concatenate([np.zeros(0, np.int64), *[x[c] + x[0] for x in found]]) for c in (2, 3))
        wb = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[np.diff(x[4]) for x in found]]))])
        del found
        n = np.diff(wb)
        text_of = np.repeat(np.arange(len(texts)), n)
        opens = np.ones(len(h), bool)
        opens[1:] = text_of[1:] != text_of[:-1]
        before = np.empty(len(h), np.int64)
        before[opens] = off[text_of[opens]]
        before[~opens] = end[:-1][~opens[1:]]
        marks = start - before + opens  # the text itself gets one mark in front
        last = np.where(n > 0, end[np.maximum(wb[1:] - 1, 0)] if len(end) else 0, off[:-1])
        rest = off[1:] - last + ((n == 0) & (off[1:] > off[:-1]))
        tail = np.flatnonzero(rest > 0)
        at = wb[1:][tail]
        h, marks = np.insert(h, at, _U(0)), np.insert(marks, at, rest[tail])
        start, end = np.insert(start, at, 0), np.insert(end, at, 0)
        self.counts = n + (rest > 0)
        with np.errstate(over="ignore"):
            key = mix(h ^ (marks.astype(_U) * _K1))
        order = np.argsort(key)
        key, self.order = key[order], order.astype(np.int32)  # equal units side by side
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first, self.keys = order[new], key[new]
        self.kind = np.empty(len(key), np.int32)
        self.kind[order] = np.cumsum(new) - 1
        blob = raw.tobytes()
        self.types = [MARK * m + blob[a:z].decode("utf-8") for m, a, z in zip(marks[first].tolist(), start[first].tolist(), end[first].tolist(), strict=True)]


def _utf8_size(code: np.ndarray) -> np.ndarray:
    return np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))


_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[0x20] = True


class Vocabulary:
    """Pieces as a sorted-key trie with log-probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else s.encode() for i, s in enumerate(self.piece)]
        self.byte_id = np.zeros(256, np.int64)
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        rank = np.array([min(float(n), -sp.get_score(i)) if not sp.is_byte(i) else float(n) for i in range(n)])
        p = 1 / (rank + 2.7)
        self.logp = np.log(p / p.sum())
        edges, ends, count = {}, {0: -1}, 1
        for i, s in enumerate(self.piece):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            node = 0
            for c in s:
                nxt = edges.get((node, ord(c)))
                if nxt is None:
                    nxt = edges[node, ord(c)] = count
                    ends[count] = -1
                    count += 1
                node = nxt
            ends[node] = i
        keys = np.array([(a << 21) | c for a, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(edges.values()), np.int32)[order]
        self.end = np.array([ends[i] for i in range(count)], np.int32)
        # transitions by the most frequent characters as a table, the others by search
        char, often = np.unique(keys & ((1 << 21) - 1), return_counts=True)
        common = char[np.argsort(-often, kind="stable")[: DENSE - 1]]
        self.column = np.zeros(1 << 21, np.uint8)
        self.column[common] = np.arange(1, len(common) + 1)
        table = np.zeros((count, DENSE), np.int32)
        inner = self.column[self.keys & ((1 << 21) - 1)]
        table[self.keys >> 21, inner] = self.to
        table[:, 0] = 0
        self.flat, self.bits = table.ravel(), DENSE.bit_length() - 1  # a node's row begins at node << bits
        # by piece id, and for id -1 - code point, which stands for a character's bytes
        self.chars = np.array([len(x) for x in self.piece], np.int32)
        self.byte_logp = float(self.logp[self.byte_id[0]])
        self.known = np.zeros(0, _U), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def search(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where the trie's ``node`` goes by a character that has no column; 0 for nowhere."""
        want = (node.astype(np.int64) << 21) | code
        k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[k] == want, self.to[k], 0)

    def logp_of(self, pid: np.ndarray) -> np.ndarray:
        out = self.logp[np.maximum(pid, 0)]
        lone = np.flatnonzero(pid < 0)
        out[lone] = self.byte_logp * _utf8_size(-1 - pid[lone])
        return out

    def chars_of(self, pid: np.ndarray) -> np.ndarray:
        return np.where(pid < 0, 1, self.chars[np.maximum(pid, 0)])

    def expand(self, pid: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids, characters without a piece as their bytes; and the cuts between lists."""
        lone = np.flatnonzero(pid < 0)
        if not len(lone):
            return pid, cuts
        size = np.ones(len(pid), np.int64)
        size[lone] = _utf8_size(-1 - pid[lone])
        to = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(pid, size)
        for p in np.unique(pid[lone]).tolist():
            for i, b in enumerate(chr(-1 - p).encode("utf-8")):
                out[to[lone[pid[lone] == p]] + i] = self.byte_id[b]
        return out, to[cuts]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """The library's ids of each unit; it puts the first mark in front by itself, so a lone mark needs its own."""
        lone = [self.sp.piece_to_id(MARK)]
        return [lone if u == MARK else x for u, x in zip(units, self.sp.encode([u[1:].replace(MARK, " ") for u in units], num_threads=1), strict=True)]

    def encode(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and lengths of a block's distinct units; a worker remembers up to KNOWN of those it has met."""
        keys, flat, begin, long = self.known
        at = np.minimum(np.searchsorted(keys, units.keys), max(0, len(keys) - 1))
        have = keys[at] == units.keys if len(keys) else np.zeros(len(units.keys), bool)
        new = np.flatnonzero(~have)
        lists = self.encode_units([units.types[i] for i in new.tolist()])
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        fresh = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(size.sum()))
        del lists
        all_ids, all_size, all_begin = np.concatenate([flat, fresh]), np.empty(len(have), np.int32), np.empty(len(have), np.int64)
        start = len(flat) + np.cumsum(size, dtype=np.int64) - size
        old = at[have]
        all_size[have], all_begin[have] = long[old], begin[old]
        all_size[new], all_begin[new] = size, start
        if len(keys) + len(new) <= KNOWN:
            to = np.searchsorted(keys, units.keys[new])
            self.known = np.insert(keys, to, units.keys[new]), all_ids, np.insert(begin, to, start), np.insert(long, to, size)
        return all_ids, all_begin, all_size

    def decode_unit(self, ids: list[int]) -> str:
        text = "".join([self.piece[i] for i in ids])
        return text if "<0x" not in text else MARK + self.decode(ids).replace(" ", MARK)

    def decode(self, ids) -> str:
        """Text of a sequence of piece ids; bytes are joined, unreadable ones replaced."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All segmentations of a list of distinct units, as one edge table.

    Nodes are character positions, numbered by their distance from the unit's
    end (closing nodes first), longer units first among equals; edges are sorted
    by source, shorter pieces first.  ``back`` is the log-mass from a node to its
    unit's end, ``low`` the probability of a node's edges before this one, given
    that the node is reached.
    """

    def __init__(self, voc: Vocabulary, units: list[str]):
        self.voc, n = voc, len(units)
        size = np.fromiter(map(len, units), np.int64, n)
        longest = int(size.max(initial=0))
        self.rank = np.empty(n, np.int32)
        self.rank[np.argsort(-size, kind="stable")] = np.arange(n, dtype=np.int32)
        width = n - np.searchsorted(np.sort(size), np.arange(longest + 1), "left")  # units of that many characters at least
        level = self.level = np.concatenate([[0], np.cumsum(width)])
        self.size, self.close = size, self.rank
        self.origin = (level[size] + self.rank).astype(np.int32)
        n_nodes = int(level[-1])
        # characters in the order of the text, a place without one after each unit
        head = np.cumsum(size + 1) - size - 1
        code = np.zeros(n_nodes, np.int32)
        inside = np.ones(n_nodes, bool)
        inside[head + size] = False
        code[inside] = np.frombuffer("".join(units).encode("utf-32-le"), np.int32)
        code[inside & (code == 0)] = -1  # no piece holds a zero byte
        left = np.repeat(head + size, size + 1) - np.arange(n_nodes)
        name = (level[left] + np.repeat(self.rank, size + 1)).astype(np.int32)  # each place's node
        del left
        column = voc.column[code]
        rare = (column == 0) & (code > 0)
        some = bool(rare.any())
        found = []
        at = np.flatnonzero(inside).astype(np.int32)
        here, node = name[at], np.zeros(len(at), np.int32)
        degree = np.zeros(n_nodes + 1, np.int32)
        while len(here):
            node = voc.flat[(node << voc.bits) + column[at]]
            if some:
                r = np.flatnonzero(rare[at])
                node[r] = voc.search(before[r] if len(found) else np.zeros(len(r), np.int32), code[at[r]])
            ok = np.flatnonzero(node)
            here, node, at = here[ok], node[ok], at[ok] + 1
            before = node
            pid = voc.end[node]
            done = np.flatnonzero(pid >= 0)
            src = here[done]
            found.append((src, name[at[done]], pid[done]))
            degree[src] += 1
            if len(found) == 1:  # characters without a piece fall back to bytes: id -1 - code point
                alone = inside.copy()
                alone[at[done] - 1] = False
                lone = np.flatnonzero(alone)
                src = name[lone]
                found.append((src, name[lone + 1], -1 - np.maximum(code[lone], 0)))
                degree[src] += 1
        self.first = np.concatenate([[0], np.cumsum(degree[:n_nodes])]).astype(np.int32)
        self.degree = degree[:n_nodes]
        total = int(self.first[-1])
        self.dst, self.pid = np.empty(total, np.int32), np.empty(total, np.int32)
        place = self.first[:n_nodes].copy()
        for src, dst, pid in found:  # sources are distinct in each part
            e = place[src]
            self.dst[e], self.pid[e] = dst, pid
            place[src] = e + 1
        del found, place, code, inside, column, rare, name
        self.logp = voc.logp_of(self.pid)
        # backward sums, nodes at equal distance from their unit's end together: their edges are side by side
        self.back, cum = np.zeros(n_nodes), np.empty(total + 1)
        for a, z in zip(level[1:-1].tolist(), level[2:].tolist(), strict=True):
            first, times = self.first[a:z], self.degree[a:z]
            e = slice(int(first[0]), int(self.first[z]))
            x = self.back[self.dst[e]]
            x += self.logp[e]
            heads = first - first[0]
            top = np.maximum.reduceat(x, heads)
            x -= np.repeat(top, times)
            np.exp(x, out=x)
            sums = np.add.reduceat(x, heads)
            x /= np.repeat(sums, times)
            cum[e.start + 1 : e.stop + 1] = x
            self.back[a:z] = top + np.log(sums)
        more, j = np.flatnonzero(self.degree > 1), 1
        while len(more):
            e = self.first[more] + j
            cum[e + 1] += cum[e]
            j += 1
            more = more[self.degree[more] > j]
        self.low = cum[:-1]
        self.low[self.first[:-1][self.degree > 0]] = 0.0

    def chance(self, e: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of edges given that their nodes are reached."""
        return np.exp(self.logp[e] + self.back[self.dst[e]] - self.back[node])

    def draw(self, kind: np.ndarray, base: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One segmentation of each unit: its pieces in one list, where it begins there, how many pieces, log-probability."""
        order = np.argsort(kind) if order is None else order  # equal units side by side
        kinds, base = kind[order], base[order]
        flat, begin, long = self.walk(self.origin[kinds], self.close[kinds], base, 0)
        logq = (np.add.reduceat(self.voc.logp_of(flat), begin) if len(kind) else np.zeros(0)) - self.back[self.origin[kinds]]
        back = np.empty(len(kind), np.int64)
        back[order] = np.arange(len(kind))
        return flat, begin[back], long[back], np.minimum(logq, 0.0)[back]

    def walk(self, here: np.ndarray, goal: np.ndarray, base: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces drawn from ``here`` on to ``goal``, where each walk begins, how many pieces; random numbers from ``step`` on."""
        n, steps = len(here), []
        who, long = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        going = np.flatnonzero(here != goal)
        who, here, goal, base = who[going], here[going], goal[going], base[going]
        while len(who):
            u = _uniform(base, step + len(steps))
            e = self.first[here + 1] - 1  # long pieces hold most of the mass
            down = np.flatnonzero(u < self.low[e])
            while len(down):
                e[down] -= 1
                down = down[u[down] < self.low[e[down]]]
            steps.append((who, self.pid[e]))
            long[who] += 1
            here = self.dst[e]
            going = np.flatnonzero(here != goal)
            who, here, goal, base = who[going], here[going], goal[going], base[going]
        begin = np.cumsum(long, dtype=np.int64) - long
        flat = np.empty(int(long.sum()), np.int32)
        for t, (who, pid) in enumerate(steps):
            flat[begin[who] + t] = pid
        return flat, begin, long

    def beside(self, kind: np.ndarray, pid: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, ...]:
        """For one segmentation of each unit (``pid`` has them one after another): node, place of the unit's first piece, and per
        piece the probability of leaving the segmentation just there and the mass of the node's other edges."""
        unit = np.repeat(np.arange(len(kind)), long)
        head = np.cumsum(long, dtype=np.int64) - long
        chars = np.cumsum(self.voc.chars_of(pid)) - self.voc.chars_of(pid)
        node = (self.level[self.size[kind][unit] - chars + chars[head][unit]] + self.rank[kind][unit]).astype(np.int32)
        other, own, more, j = np.zeros(len(pid)), np.zeros(len(pid)), np.arange(len(pid)), 0
        while len(more):
            e = self.first[node[more]] + j
            p, mine = self.chance(e, node[more]), self.pid[e] == pid[more]
            own[more] += np.where(mine, p, 0.0)
            other[more] += np.where(mine, 0.0, p)
            j += 1
            more = more[self.degree[node[more]] > j]
        before = np.log(np.maximum(own, 1e-300))
        before = np.cumsum(before) - before
        return node, unit, head, np.exp(before - before[head][unit]) * other, other

    def draw_beside(self, kind: np.ndarray, pid: np.ndarray, long: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Another segmentation of each unit than the given one, drawn from what is left: pieces, begins, how many, and log of what was left."""
        node, unit, head, leave, other = self.beside(kind, pid, long)
        rest = np.add.reduceat(leave, head)
        share = np.cumsum(leave / rest[unit])
        share -= np.concatenate([[0.0], share])[head][unit]
        live = leave > 0
        # the first place whose running share is above the number drawn; the last live one if rounding left none
        above = live & (share > _uniform(base, 0)[unit])
        place = np.arange(len(pid))
        at = np.minimum(np.minimum.reduceat(np.where(above, place, len(pid)), head), np.maximum.reduceat(np.where(live, place, -1), head))
        u = _uniform(base, 1) * other[at]
        first, count, own = self.first[node[at]], self.degree[node[at]], pid[at]
        picked, sums, open_ = np.full(len(at), -1, np.int32), np.zeros(len(at)), np.ones(len(at), bool)
        for j in range(int(count.max(initial=0))):
            here = np.flatnonzero((count > j) & open_)
            e = first[here] + j
            ok = self.pid[e] != own[here]
            here, e = here[ok], e[ok]
            sums[here] += self.chance(e, node[at][here])
            picked[here] = e
            open_[here] = sums[here] <= u[here]
        flat, begin, tail = self.walk(self.dst[picked], self.close[kind], base, 2)
        kept = (at - head).astype(np.int32)
        size = kept + 1 + tail
        start = np.cumsum(size, dtype=np.int64) - size
        out = np.empty(int(size.sum()), np.int32)
        out[_spread(start, kept)] = pid[_spread(head, kept)]
        out[start + kept] = self.pid[picked]
        out[_spread(start + kept + 1, tail)] = flat[_spread(begin, tail)]
        return out, start, size, np.log(rest)

    def log_rest(self, kind: np.ndarray, flat: np.ndarray, begin: np.ndarray, long: np.ndarray, logq: np.ndarray) -> np.ndarray:
        """Log-probability of all other segmentations of each unit than the one given; no digits are lost next to 1."""
        out = _log1mexp(logq)
        near = np.flatnonzero(logq > -1e-4)  # no two segmentations of a unit are that likely
        kinds, which, back = np.unique(kind[near], return_index=True, return_inverse=True)
        which = near[which]
        _, _, head, leave, _ = self.beside(kinds, flat[_spread(begin[which], long[which])], long[which])
        rest = np.add.reduceat(leave, head) if len(head) else np.zeros(0)
        with np.errstate(divide="ignore"):
            out[near] = np.log(rest)[back]
        return out

    def ids(self, voc: Vocabulary, e: int) -> list[int]:
        return voc.expand(self.pid[e : e + 1], np.array([0, 1]))[0].tolist()


class Others:
    """What is left of one unit's segmentations without the ``gone`` ones: ``mass``, and draws from it.

    States are the places that some gone segmentation passes; masses are sums
    of positive terms only, so they are zero just if nothing is left.
    """

    def __init__(self, lat: Lattice, kind: int, gone: list[tuple[int, ...]]):
        self.lat, self.goal = lat, int(lat.close[kind])
        self.states: list[tuple[int, list[tuple[int, int, float, int]]]] = []
        todo = [(int(lat.origin[kind]), gone, 0)]
        for node, paths, t in todo:  # grows while it runs
            edges = []
            e = np.arange(lat.first[node], lat.first[node] + lat.degree[node])
            for pid, dst, p in zip(lat.pid[e].tolist(), lat.dst[e].tolist(), lat.chance(e, np.full(len(e), node)).tolist(), strict=True):
                mine = [x for x in paths if x[t] == pid]
                edges.append((pid, dst, p, (len(todo) if dst != self.goal else -2) if mine else -1))
                if mine and dst != self.goal:
                    todo.append((dst, mine, t + 1))
            self.states.append((node, edges))
        self.left = [0.0] * len(todo)
        for i in range(len(todo) - 1, -1, -1):
            self.left[i] = sum(self.share(x) for x in self.states[i][1])
        self.mass = self.left[0]

    def share(self, edge: tuple[int, int, float, int]) -> float:
        _, _, p, state = edge
        return p if state == -1 else 0.0 if state == -2 else p * self.left[state]

    def draw(self, uniforms: Iterator[float]) -> tuple[int, ...]:
        out, state, node = [], 0, -1
        while state >= 0:
            edges = [(self.share(x), x) for x in self.states[state][1]]
            edges = [x for x in edges if x[0] > 0]
            u = next(uniforms) * sum(x[0] for x in edges)
            for share, edge in edges:
                u -= share
                if u < 0:
                    break
            out.append(edge[0])
            node, state = edge[1], edge[3]
        lat = self.lat
        while node != self.goal:
            u, e = next(uniforms), int(lat.first[node + 1]) - 1
            while u < lat.low[e]:
                e -= 1
            out.append(int(lat.pid[e]))
            node = int(lat.dst[e])
        return tuple(out)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    size = size.astype(np.int64)
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > -0.693, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


def _steps(base: np.uint64) -> Iterator[float]:
    for t in itertools.count():
        yield float(_uniform(np.array([base], _U), t)[0])


def _hashes(ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A hash of each id list."""
    place = np.arange(len(ids)) - np.repeat(cuts[:-1], np.diff(cuts))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(mix(ids.astype(_U) + mix(place.astype(_U))), dtype=_U)])
        return mix(sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64)


_SAMPLE = pa.struct([("pieces", pa.int32()), ("logp", pa.float64()), ("log_inclusion", pa.float64()), ("hash", pa.int64()), ("ids", pa.list_(pa.int32()))])


def samples(voc: Vocabulary, units: Units, keys: np.ndarray, k: int, want_ids: bool) -> pa.ListArray:
    """Up to ``k`` distinct segmentations of each text, best perturbed value first; fewer only where the text has fewer.

    The lattice holds the distinct units of at most RANGE_UNITS occurrences at a
    time; of the whole block there are a few numbers per occurrence and run.
    """
    kind, counts = units.kind, units.counts
    n_texts, n = len(counts), len(kind)
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n_texts + 1, np.int32)), pa.array([], _SAMPLE))
    doc = np.repeat(np.arange(n_texts, dtype=np.int32), counts)
    base = np.concatenate([[0], np.cumsum(counts)])
    unit = np.arange(n) - base[doc]
    full = np.flatnonzero(counts > 0)
    heads = base[full]
    seat = np.repeat(np.arange(len(full)), counts[full])  # of each unit, its text's place in full
    g = -np.log(-np.log(uniform(keys, np.zeros(n_texts, np.int64), 1 << 20, 0)))  # perturbed mass of each whole text
    ranges = [(a, min(n, a + RANGE_UNITS)) for a in range(0, n, RANGE_UNITS)]
    held: list[tuple[np.ndarray, Lattice]] = []

    def lattice(a: int, z: int) -> tuple[np.ndarray, Lattice]:
        """Each kind's number in the lattice of a range, and the lattice; kept if there is one range only."""
        if held:
            return held[0]
        if len(ranges) == 1:
            held.append((np.arange(len(units.types), dtype=np.int32), Lattice(voc, units.types)))
            return held[0]
        here = np.unique(kind[a:z])
        number = np.zeros(len(units.types), np.int32)
        number[here] = np.arange(len(here))
        return number, Lattice(voc, [units.types[i] for i in here.tolist()])

    class Run:
        """One segmentation of every text: its pieces unit by unit, log-probabilities, what else each unit could be."""

        def __init__(self):
            self.begin, self.long = np.zeros(n, np.int64), np.zeros(n, np.int32)
            self.logq, self.rest = np.zeros(n), np.zeros(n)
            self.flat, self.size = [], 0

        def add(self, at: np.ndarray, flat: np.ndarray, begin: np.ndarray, long: np.ndarray, logq: np.ndarray) -> None:
            self.begin[at], self.long[at], self.logq[at] = begin + self.size, long, logq
            self.flat.append(flat)
            self.size += len(flat)

        def fill(self, fresh: np.ndarray, sample: int) -> None:
            """Draws the units at ``fresh``."""
            for a, z in ranges:
                at = fresh[np.searchsorted(fresh, a) : np.searchsorted(fresh, z)]
                if len(at):
                    number, lat = lattice(a, z)
                    kinds = number[kind[at]]
                    got = lat.draw(kinds, stream(keys[doc[at]], unit[at], sample), units.order if len(at) == n else None)
                    self.rest[at] = lat.log_rest(kinds, *got)
                    self.add(at, *got)

        def copy(self, old: Run, at: np.ndarray) -> None:
            pieces, begin = old.pieces(at), np.cumsum(old.long[at], dtype=np.int64) - old.long[at]
            self.add(at, pieces, begin, old.long[at], old.logq[at])

        def pieces(self, at: np.ndarray) -> np.ndarray:
            if len(self.flat) > 1:
                self.flat = [np.concatenate(self.flat)]
            return self.flat[0][_spread(self.begin[at], self.long[at])] if self.flat else np.zeros(0, np.int32)

        def siblings(self, bound: np.ndarray, fresh: np.ndarray, sample: int) -> np.ndarray:
            """Perturbed mass of 'same up to this unit, another segmentation here', below ``bound``; -inf where not fresh."""
            total = np.cumsum(self.logq)
            prefix = total - self.logq
            prefix -= prefix[heads][seat]
            noise = -np.log(-np.log(_uniform(stream(keys[doc], unit, sample), 1 << 21)))
            v, top = prefix + self.rest + noise, bound[doc]
            with np.errstate(invalid="ignore"):
                v = np.minimum(top, v) - np.log1p(np.exp(-np.abs(top - v)))
            out = np.full(n, -np.inf)
            out[fresh] = v[fresh]
            return out

    every = np.arange(n)
    runs = [Run()]
    runs[0].fill(every, 0)
    fronts = [runs[0].siblings(g, every, 0)]
    value = [np.where(counts > 0, g, -np.inf)]
    out_of: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    cutoff = np.full(n_texts, -np.inf)
    for s in range(1, k + 1):
        best = np.stack([np.maximum.reduceat(f, heads) for f in fronts])
        src = best.argmax(axis=0)
        top = best[src, np.arange(len(full))]
        if s == k:
            cutoff[full] = top
            break
        bound = np.full(n_texts, -np.inf)
        picked = np.flatnonzero(np.isfinite(top))
        bound[full[picked]] = top[picked]
        value.append(bound)
        run = Run()
        runs.append(run)
        if not len(picked):
            fronts.append(np.full(n, -np.inf))
            continue
        spot = np.zeros(len(picked), np.int64)  # the unit that changes
        for j, p in enumerate(picked.tolist()):
            a = heads[p]
            spot[j] = a + fronts[src[p]][a : a + counts[full[p]]].argmax()
        here, which = np.unique(kind[spot], return_inverse=True)
        lat = Lattice(voc, [units.types[i] for i in here.tolist()])
        bases = stream(keys[doc[spot]], unit[spot], s)
        noise = -np.log(-np.log(_uniform(stream(keys[doc[spot]], unit[spot], s), 1 << 22)))
        same, fresh = [[] for _ in runs], []
        mother = src[picked]
        before = np.array([runs[m].logq[a:u].sum() for m, a, u in zip(mother.tolist(), heads[picked].tolist(), spot.tolist(), strict=True)])
        plain = np.array([(m, u) not in out_of for m, u in zip(mother.tolist(), spot.tolist(), strict=True)])
        swapped: list[tuple[int, ...]] = [()] * len(picked)
        left = np.zeros(len(picked))
        for m in np.unique(mother[plain]).tolist():  # only one segmentation is gone: all texts at once
            js = np.flatnonzero(plain & (mother == m))
            old, size = runs[m].pieces(spot[js]), runs[m].long[spot[js]]
            flat, begin, long, rest = lat.draw_beside(which[js], old, size, bases[js])
            new = np.add.reduceat(voc.logp_of(flat), begin) - lat.back[lat.origin[which[js]]]
            left[js] = np.exp(rest + _log1mexp(np.minimum(0.0, new - rest)))
            tight = new - rest > -1e-6  # hardly anything else is left: exact below
            cuts, ends = (np.cumsum(x) for x in (size, long))
            for i, j in enumerate(js.tolist()):
                swapped[j] = tuple(flat[begin[i] : ends[i]].tolist())
                gone = out_of[m, int(spot[j])] = [tuple(old[cuts[i] - size[i] : cuts[i]].tolist()), swapped[j]]
                if tight[i]:
                    left[j] = Others(lat, int(which[j]), gone).mass
        for j in np.flatnonzero(~plain).tolist():
            gone = out_of[int(mother[j]), int(spot[j])]
            swapped[j] = Others(lat, int(which[j]), gone).draw(_steps(bases[j]))
            gone.append(swapped[j])
            left[j] = Others(lat, int(which[j]), gone).mass
        with np.errstate(divide="ignore", invalid="ignore"):
            v, bar = before + np.log(left) + noise, top[picked]
            v = np.where(left > 0, np.minimum(bar, v) - np.log1p(np.exp(-np.abs(bar - v))), -np.inf)
        for j, m in enumerate(mother.tolist()):
            fronts[m][spot[j]] = v[j]
            same[m].append((int(heads[picked[j]]), int(spot[j])))
            fresh.append((int(spot[j]) + 1, int(heads[picked[j]] + counts[full[picked[j]]])))
        for m, spans in enumerate(same):
            if spans:
                begin = np.array([x[0] for x in spans])
                run.copy(runs[m], _spread(begin, np.array([x[1] for x in spans]) - begin))
        flat, long = np.array(list(itertools.chain.from_iterable(swapped)), np.int32), np.array([len(x) for x in swapped], np.int32)
        begin = np.cumsum(long, dtype=np.int64) - long
        logq = np.minimum(0.0, np.add.reduceat(voc.logp_of(flat), begin) - lat.back[lat.origin[which]])
        run.add(spot, flat, begin, long, logq)
        begin = np.array([x[0] for x in fresh])
        again = _spread(begin, np.array([x[1] for x in fresh]) - begin)
        run.fill(again, s)
        fronts.append(run.siblings(bound, again, s))
    held.clear()
    columns = []
    for s, run in enumerate(runs):
        here = np.flatnonzero(np.isfinite(value[s][full]))
        if not len(here):
            continue
        texts = full[here]
        at = _spread(base[texts], counts[texts]) if len(here) < len(full) else every
        ends = np.cumsum(counts[texts])
        cuts = np.concatenate([[0], np.cumsum(run.long[at], dtype=np.int64)])[np.concatenate([[0], ends])]
        ids, cuts = voc.expand(run.pieces(at), cuts)
        logp = np.add.reduceat(run.logq[at], ends - counts[texts])
        x = np.where(np.isfinite(cutoff[texts]), logp - cutoff[texts], np.inf)
        with np.errstate(over="ignore", divide="ignore"):
            inclusion = np.where(x > 3.6, 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 3.6))))))
        columns.append((texts, np.diff(cuts), logp, inclusion, _hashes(ids, cuts), ids))
        run.flat = []
    order = np.lexsort((np.repeat(np.arange(len(columns)), [len(c[0]) for c in columns]), np.concatenate([c[0] for c in columns])))
    pieces, logp, inclusion, digest = (np.concatenate([c[i] for c in columns])[order] for i in (1, 2, 3, 4))
    if want_ids:
        size = np.concatenate([c[1] for c in columns])
        ids = np.concatenate([c[5] for c in columns])[_spread((np.cumsum(size) - size)[order], size[order])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pieces)]).astype(np.int32)), pa.array(ids))
    else:
        lists = pa.nulls(len(order), pa.list_(pa.int32()))
    rows = pa.StructArray.from_arrays([pa.array(pieces.astype(np.int32)), pa.array(logp), pa.array(inclusion), pa.array(digest), lists], fields=list(_SAMPLE))
    per = np.bincount(np.concatenate([c[0] for c in columns]), minlength=n_texts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), rows)


def sample_block(voc: Vocabulary, units: Units, keys: np.ndarray, k: int, want_ids: bool) -> list[list[dict]]:
    """``samples`` as Python rows."""
    return samples(voc, units, keys, k, want_ids).to_pylist()


SAMPLE = "struct<pieces:int,logp:double,log_inclusion:double,hash:bigint,ids:array<int>>"


def encode_and_sample(docs: DataFrame, model_path: str, *, k: int = 2, with_ids: bool = True, text_col: str = "text", id_col: str = "doc_id", keep_cols: tuple[str, ...] | None = None) -> DataFrame:
    """``keep_cols`` (the id by default), n_pieces, ids, ids_hash, round_trip and samples for every row.

    ``ids`` equals the library's ``encode``; ``round_trip`` tells whether
    decoding gives the text back (with its own space marks read as spaces): the
    ids of the whole document, or unit by unit with ``with_ids`` false.
    ``samples`` holds up to ``k`` distinct segmentations in order of perturbed
    value, fewer where the text has fewer; with ``with_ids`` false the id lists
    stay null.  Equal ids and texts draw equal samples; a null id is a key like
    any other.  Null and empty texts have no pieces and no samples.  Row-local,
    a block of texts at a time, whole texts always.
    """
    cols = (id_col,) if keep_cols is None else keep_cols
    src = docs.select(*cols, F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-2])
    names = [*cols, "n_pieces", "ids", "ids_hash", "round_trip", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path)
        give_back()
        for b in batches:
            n, at = b.num_columns, 0
            size = pc.fill_null(pc.binary_length(b.column(n - 1)), 0).to_numpy(zero_copy_only=False).cumsum()
            while at < b.num_rows:
                end = min(b.num_rows, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES))))
                part = b.slice(at, end - at)
                at = end
                units = Units([t or "" for t in part.column(n - 1).to_pylist()])
                keys = mix(part.column(n - 2).to_numpy().view(_U))
                flat, begin, length = voc.encode(units)
                right = None if with_ids else np.array([voc.decode_unit(flat[a : a + m].tolist()) == u for a, m, u in zip(begin.tolist(), length.tolist(), units.types, strict=True)], bool)
                size_of, reach = length[units.kind], np.concatenate([[0], np.cumsum(units.counts)])
                cuts = np.concatenate([[0], np.cumsum(size_of, dtype=np.int64)])[reach]
                ids = flat[_spread(begin[units.kind], size_of)]
                hashes = _hashes(ids, cuts)
                del flat, begin, length
                if with_ids:  # whole documents' ids give the text's bytes, spaces as marks
                    raw, bytes_of, reach = ids.tolist(), voc.raw.__getitem__, cuts.tolist()
                    want = ((MARK + t.replace(" ", MARK)).encode() if t else b"" for t in part.column(n - 1).to_pylist())
                    whole = np.array([b"".join(map(bytes_of, raw[a:z])) == t for a, z, t in zip(reach[:-1], reach[1:], want, strict=True)], bool)
                    del raw
                else:
                    whole = np.diff(np.concatenate([[0], np.cumsum(~right[units.kind])])[reach]) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: n - 2],
                        pa.array(np.diff(cuts)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)) if with_ids else pa.nulls(len(part), pa.list_(pa.int32())),
                        pa.array(hashes),
                        pa.array(whole),
                        samples(voc, units, keys, k, with_ids),
                    ],
                    names=names,
                )
                del units, ids, part, size_of
                give_back()

    return src.mapInArrow(run, f"{head}n_pieces bigint, ids array<int>, ids_hash bigint, round_trip boolean, samples array<{SAMPLE}>")


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text of each id list (null for null)."""
    names = [c for c in encoded.columns if c != out_col]
    src = encoded.select(*names)
    at = names.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + f", `{out_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path)
        for b in batches:
            texts = [None if x is None else voc.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, out_col])

    return src.mapInArrow(run, schema)
