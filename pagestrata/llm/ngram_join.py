"""Operator 2: n-gram Jaccard self-join by prefix trees.

Every document is the set of its word n-grams under one global order (grams common
in a sample last, else the order of their 64-bit hashes).  Sets are stored in a trie;
a query set walks it level by level, all partial overlaps of a shared prefix being
computed once, and a subtree is dropped as soon as its overlap plus the remaining
lengths cannot reach the required overlap.

To distribute it without losing a pair, the grams are divided into parts by hash.
If two sets have similarity t, then in at least one part their shares of it have
(were it less in each, the sums over the parts would give less in all).  Shares of
similarity t have a gram of their prefixes in common, so each share is sent to the
subtrees of its prefix grams, with a bitmap; shares that meet there and may be similar by
sizes, places of the gram and bitmaps give an edge.  The number of parts goes by the size
of the set, so that a share has 8 to 32 grams on average; a set whose partners may be of
the next smaller class is sent in the parts of that class too.  All of this can only rule
out pairs that aren't similar.

Connected sets travel together, each once, and the trie finds the similar pairs of a
component.  A large component is divided into blocks, and each pair of blocks is a
group of its own.  Where only links and classes are wanted, the sets of a large group are
counted by matrix products instead, as the similar pairs of a large class are too many
to be listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .components import connected, forest

N = 3
THRESHOLD = 0.55
#: One of so many documents is looked at for common grams, at most HOT_MOST of those that occur in at least HOT_LEAST of them; this changes the work only, not the result.
HOT_EVERY, HOT_LEAST, HOT_MOST = 16, 8, 100_000
#: Bytes of text of a block of a component, and of the grams sent to one task.
BLOCK_BYTES, ROUTE_BYTES = 8 << 20, 8 << 20
#: Rows that are gathered before they are sent, and the variants of a subtree up to which all pairs of them are tested.
GATHER, RUN = 1 << 19, 256
#: Bytes that a text counts for at least in a block, so that a block has a bounded number of sets.
TEXT_BYTES = 1 << 10
#: Sets of a group beyond which links are counted by matrix products, the cells of a matrix, and how many of them cost what one pair of a gram does that isn't in it; this changes the plan, not the result.
CROWD, CELLS, CHEAPER = 64, 1 << 21, 250
_U = np.uint64
_LABEL = _U((1 << 48) - 1)


def gram_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer than n words has the one gram of all its words, and one without words none."""
    return sets_of(K.words(texts), len(texts), n)


def sets_of(w: K.Words, m: int, n: int) -> list[np.ndarray]:
    size = np.bincount(w.doc, minlength=m) if len(w.doc) else np.zeros(m, np.int64)
    first = np.cumsum(size) - size
    g = K.window_hash(w.hash, n)
    out = []
    for at, k in zip(first.tolist(), size.tolist()):
        if k >= n:
            s = np.sort(g[at : at + k - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif k:
            out.append(K.window_hash(w.hash[at : at + k], k))
        else:
            out.append(np.zeros(0, _U))
    return out


def text_keys(w: K.Words, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits, as two numbers, by which the word sequences of m texts are told apart, and their numbers of words."""
    size = np.bincount(w.doc, minlength=m) if len(w.doc) else np.zeros(m, np.int64)
    on = np.flatnonzero(size)
    place = np.arange(len(w.hash), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    keys = []
    for salt in (_U(0x5851F42D4C957F2D), _U(0xA0761D6478BD642F)):
        h = K.mix(w.hash + K.mix(place.astype(_U) * _U(0x9E3779B97F4A7C15) + salt))
        key = np.zeros(m, _U)
        key[on] = K.mix(np.add.reduceat(h, (np.cumsum(size) - size)[on]) + size[on].astype(_U)) if len(on) else 0
        keys.append(key.view(np.int64))
    return keys[0], keys[1], size


def prefix_length(n: np.ndarray | int, t: float) -> np.ndarray:
    """Of two similar sets, so many grams of each, the first under any common order, have one in common."""
    return (n - np.ceil(t * n - 1e-9) + 1).astype(np.int64)


def size_class(n: np.ndarray) -> np.ndarray:
    """k for the sets of n grams that are divided into 4**k parts: 0 below 32 grams, 1 below 128, and so on."""
    return np.floor(np.log2(np.maximum(n // 8, 1)) + 1e-9).astype(np.int64) // 2


class Shares(NamedTuple):
    """Prefix grams of shares: the gram's subtree, bitmap (in two words) and size of the share and the gram's place in it, the part, and the set."""

    key: np.ndarray
    bits: np.ndarray
    more_bits: np.ndarray
    size: np.ndarray
    place: np.ndarray
    part: np.ndarray
    label: np.ndarray

    def take(self, at: np.ndarray) -> Shares:
        return Shares(*(c[at] for c in self))


def shares(sets: list[np.ndarray], label: np.ndarray, k: int, t: float, hot: np.ndarray, rank: np.ndarray) -> Shares:
    """All prefix grams of the shares of the sets in the 4**k parts; hot: grams, sorted, that come last, by rank."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    part = (flat & _U((1 << 2 * k) - 1)).astype(np.int64)
    late = np.zeros(len(flat), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
        late = np.where(hot[at] == flat, rank[at], 0)
    o = np.lexsort((late, part, of))  # stable, so by gram within
    flat, of, part = flat[o], of[o], part[o]
    h = K.mix(flat)
    bit = np.left_shift(_U(1), h >> _U(58))
    odd = (h >> _U(57) & _U(1)).astype(bool)
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (of[1:] != of[:-1])]))
    size = np.diff(np.concatenate([first, [len(flat)]]))
    more = np.bitwise_xor.reduceat(np.where(odd, bit, _U(0)), first)
    bits = np.bitwise_xor.reduceat(np.where(odd, _U(0), bit), first)
    place = np.arange(len(flat)) - np.repeat(first, size)
    on = place < np.repeat(prefix_length(size, t), size)
    key = K.mix(flat[on] + _U((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    share = np.repeat(np.arange(len(size)), size)[on]
    return Shares(key, bits[share], more[share], size[share], place[on], part[on] | k << 48, label[of[on]])


# == the trie


class Level(NamedTuple):
    """Nodes of one depth: the gram on the edge, the run [lo, hi) of sets below, their least and greatest sizes, the most grams of one, how many end here, and the run of children."""

    token: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray
    most: np.ndarray
    longest: np.ndarray
    ended: np.ndarray
    kids: np.ndarray
    n_kids: np.ndarray


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges first[i] .. first[i]+count[i]."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def build_trie(flat: np.ndarray, start: np.ndarray, length: np.ndarray, size: np.ndarray, kind: np.ndarray) -> list[Level]:
    """Levels of the trie of sets that are in lexicographic order; a node with sets of one kind below, which are equal, isn't split further."""
    levels: list[Level] = []
    lo, hi, parent = np.array([0]), np.array([len(length)]), np.array([-1])
    while len(lo):
        depth = len(levels)
        row = _spread(lo, hi - lo)
        of = np.repeat(np.arange(len(lo)), hi - lo)
        on = length[row] > depth
        row, of = row[on], of[on]
        if not len(row):
            break
        token = flat[start[row] + depth]
        new = np.ones(len(row), bool)
        new[1:] = (of[1:] != of[:-1]) | (token[1:] != token[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.concatenate([first, [len(row)]]))
        level = Level(token[first], row[first], row[first] + n, np.minimum.reduceat(size[row], first), np.maximum.reduceat(size[row], first), np.maximum.reduceat(length[row], first), np.add.reduceat((length[row] == depth + 1).astype(np.int64), first), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64))
        if levels:
            up = parent[of[first]]
            u, at, count = np.unique(up, return_index=True, return_counts=True)
            levels[-1].kids[u], levels[-1].n_kids[u] = at, count
        levels.append(level)
        parent = np.flatnonzero(kind[level.lo] != kind[level.hi - 1])
        lo, hi = level.lo[parent], level.hi[parent]
    return levels


def required(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of sets of sizes a and b with Jaccard similarity of at least t."""
    return np.ceil(t * (a + b) / (1 + t) - 1e-9)


def shared_grams(flat: np.ndarray, of: np.ndarray, size: np.ndarray, t: float) -> np.ndarray:
    """Which grams can count: those in two sets at least, of the sets that have enough of them; the rest is taken off until nothing changes."""
    on = np.ones(len(flat), bool)
    while True:
        count = np.bincount(flat[on], minlength=int(flat.max()) + 1)
        left = on & (count[flat] > 1)
        left &= (np.bincount(of[left], minlength=len(size)) >= np.ceil(t * size - 1e-9))[of]
        if (left == on).all():
            return on
        on = left


def bitmaps(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each set and bit whether an odd number of the set's grams hash to it; two sets differ in at least as many grams as bits."""
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * length.mean())), 6, 15))
    out = []
    for a, n in zip(start.tolist(), length.tolist()):
        odd = np.bincount((K.mix(flat[a : a + n].astype(_U)) % _U(bits)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(_U))
    return np.stack(out)


def _bitmaps_allow(bits: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether the sets x and y may have that many grams in common."""
    ok, size = np.empty(len(x), bool), max(1, (1 << 21) // bits.shape[1])
    for a in range(0, len(x), size):
        r, w = x[a : a + size], y[a : a + size]
        ok[a : a + size] = np.bitwise_count(bits[r] ^ bits[w]).sum(1, dtype=np.int64) <= length[r] + length[w] - 2 * need[a : a + size]
    return ok


def trie_join(sets: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap) of all pairs i < j of sorted sets with Jaccard similarity of at least t, each set being a query against the trie of all.

    Grams that no other set has aren't stored; they count in the sizes.
    """
    none = np.zeros(0, np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2 or not size.sum():
        return none, none, none
    flat, of = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64), np.repeat(np.arange(len(sets)), size)
    on = shared_grams(flat, of, size, t)
    kept, of = np.unique(of[on], return_inverse=True)
    if len(kept) < 2:
        return none, none, none
    universe, flat = np.unique(flat[on], return_inverse=True)
    # one order for all: rarest first, so that sets that differ part early
    count = np.bincount(flat)
    turn = np.empty(len(universe), np.int64)
    turn[np.argsort(count, kind="stable")] = np.arange(len(universe))
    flat = turn[flat]
    flat = flat[np.lexsort((flat, of))]
    size, length = size[kept], np.bincount(of)
    m = len(kept)
    start = np.cumsum(length) - length
    big = flat.astype(">u4")
    name = [big[a : a + n].tobytes() for a, n in zip(start.tolist(), length.tolist())]
    order = np.array(sorted(range(m), key=name.__getitem__))
    kind = np.cumsum([0, *(name[i] != name[j] for i, j in zip(order[:-1], order[1:]))])
    start, size, length = start[order], size[order], length[order]
    levels = build_trie(flat, start, length, size, kind)
    bits = bitmaps(flat, start, length)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    roots = len(levels[0].token)
    # a table of all grams where it is small, else a search among the sets' grams
    dense = len(universe) <= 1 << 16
    block = max(1, min((1 << 22) // len(universe) if dense else m, (1 << 22) // roots))
    place = np.repeat(np.arange(m), length)
    at_flat = _spread(start, length)
    within, begin = place * len(universe) + flat[at_flat], np.cumsum(length) - length
    for at in range(0, m, block):
        rows = np.arange(at, min(m, at + block))
        if dense:
            member = np.zeros((len(rows), len(universe)), bool)
            member[np.repeat(rows - at, length[rows]), flat[_spread(start[rows], length[rows])]] = True
            passed = np.cumsum(member, axis=1, dtype=np.int32)

        def has(q: np.ndarray, token: np.ndarray) -> np.ndarray:
            if dense:
                return member[q - at, token]
            wanted = q * len(universe) + token
            return within[np.minimum(np.searchsorted(within, wanted), len(within) - 1)] == wanted

        def up_to(q: np.ndarray, token: np.ndarray) -> np.ndarray:
            return passed[q - at, token] if dense else np.searchsorted(within, q * len(universe) + token, "right") - begin[q]

        q, v, o = np.repeat(rows, roots), np.tile(np.arange(roots), len(rows)), np.zeros(len(rows) * roots, np.int64)
        for depth, level in enumerate(levels):
            if not len(q):
                break
            token = level.token[v]
            o = o + has(q, token)
            left = np.minimum(length[q] - up_to(q, token), level.longest[v] - depth - 1)
            # sizes outside [t * |q|, |q| / t] can't match; of the others, the least size asks for the least overlap
            fits = np.maximum(level.least[v], t * size[q])
            go = (o + left >= required(fits, size[q], t)) & (level.most[v] >= t * size[q] - 1e-9) & (level.least[v] * t <= size[q] + 1e-9) & (level.hi[v] > q + 1)
            q, v, o = q[go], v[go], o[go]
            alone = kind[level.lo[v]] == kind[level.hi[v] - 1]
            ends = np.where(alone, level.hi[v] - level.lo[v], level.ended[v])
            other, query = _spread(level.lo[v], ends), np.repeat(q, ends)
            got = np.repeat(o, ends)
            later = other > query
            other, query, got = other[later], query[later], got[later]
            fits = _bitmaps_allow(bits, other, query, length, required(size[other], size[query], t))
            other, query, got = other[fits], query[fits], got[fits]
            tail = length[other] - depth - 1
            total, b = np.cumsum(tail + 1), 0
            while b < len(other):
                to = max(int(np.searchsorted(total, (total[b - 1] if b else 0) + (1 << 21), "right")), b + 1)
                r, w, g, rest, b = other[b:to], query[b:to], got[b:to], tail[b:to], to
                # in order of set and query; reduceat needs runs that aren't empty, hence the leading element, taken off again
                hit = has(np.repeat(w, rest + 1), flat[_spread(start[r] + depth, rest + 1)])
                run = np.cumsum(rest + 1) - (rest + 1)
                g = g + np.add.reduceat(hit.astype(np.int64), run) - hit[run]
                yes = g >= required(size[r], size[w], t)
                found.append((w[yes], r[yes], g[yes]))
            q, v, o = q[~alone], v[~alone], o[~alone]
            kids = level.n_kids[v]
            q, o, v = np.repeat(q, kids), np.repeat(o, kids), _spread(level.kids[v], kids)
    if not found:
        return none, none, none
    a, b, o = (kept[order[np.concatenate([f[0] for f in found])]], kept[order[np.concatenate([f[1] for f in found])]], np.concatenate([f[2] for f in found]))
    return np.minimum(a, b), np.maximum(a, b), o


def crowd_links(sets: list[np.ndarray], t: float, copies: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, u, v): for each sorted set the sum of copies of the other sets with Jaccard similarity of at least t, and edges between sets that connect the similar ones; with side, pairs of one side don't count.

    Pairs are counted in blocks of a matrix and never listed: grams that many sets of a
    block have by a product of matrices, the others by the lists of their sets.
    """
    links, none = np.zeros(len(sets), np.int64), np.zeros(0, np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2 or not size.sum():
        return links, none, none
    flat, of = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), size)
    on = shared_grams(flat, of, size, t)
    kept, of = np.unique(of[on], return_inverse=True)
    if len(kept) < 2:
        return links, none, none
    flat = np.unique(flat[on], return_inverse=True)[1].astype(np.int32)
    size, length, copies = size[kept], np.bincount(of), copies[kept]
    start, m = np.cumsum(length) - length, len(kept)
    count = np.bincount(flat)
    have, begin = of[np.argsort(flat, kind="stable")].astype(np.int32), np.cumsum(count) - count
    need = required(np.arange(2 * size.max() + 1), np.zeros(1), t).astype(np.float32)
    # by least hash, so that most similar sets are near each other
    order = np.argsort(flat[start], kind="stable")
    rows = order if side is None else order[side[kept][order] == side[kept][order[0]]]
    others = order if side is None else order[side[kept][order] != side[kept][order[0]]]
    label, got = np.arange(m), np.zeros(m, np.int64)
    a = 0
    while a < len(rows) and len(others):
        cols = others[a:] if side is None else others
        r = rows[a : a + max(1, CELLS // len(cols))]
        a += len(r)
        gram, at = flat[_spread(start[r], length[r])], np.repeat(np.arange(len(r)), length[r])
        work = np.bincount(gram, minlength=len(count)) * count
        many = np.flatnonzero(work * CHEAPER > len(r) * len(cols))
        place = np.full(len(count), -1, np.int32)
        place[many] = np.arange(len(many))
        overlap = np.zeros((len(r), len(cols)), np.float32)
        if len(many):
            gram_c, at_c = flat[_spread(start[cols], length[cols])], np.repeat(np.arange(len(cols), dtype=np.int32), length[cols])
            x, y, width = place[gram], place[gram_c], max(1, 4 * CELLS // len(cols))
            for b in range(0, len(many), width):
                w = min(width, len(many) - b)
                one, two = np.zeros((len(r), w), np.float32), np.zeros((len(cols), w), np.float32)
                i, j = (x >= b) & (x < b + w), (y >= b) & (y < b + w)
                one[at[i], x[i] - b] = 1
                two[at_c[j], y[j] - b] = 1
                overlap += one @ two.T
        column = np.full(m, -1, np.int64)
        column[cols] = np.arange(len(cols))
        few = np.flatnonzero(place[gram] < 0)
        total, b = np.cumsum(count[gram[few]]), 0
        while b < len(few):
            to = max(int(np.searchsorted(total, (total[b - 1] if b else 0) + CELLS, "right")), b + 1)
            g, i, b = gram[few[b:to]], at[few[b:to]], to
            c = column[have[_spread(begin[g], count[g])]]
            np.add.at(overlap.reshape(-1), (np.repeat(i, count[g]) * len(cols) + c)[c >= 0], np.float32(1))
        similar = overlap >= need[size[r][:, None] + size[cols]]
        if side is None:
            similar[:, : len(r)] &= np.tri(len(r), k=-1, dtype=bool).T
        for i, x in enumerate(r.tolist()):
            hit = cols[np.flatnonzero(similar[i])]
            got[x] += copies[hit].sum()
            got[hit] += copies[x]
            if (label[hit] != label[x]).any():
                joint = np.unique(np.append(label[hit], label[x]))
                label[np.isin(label, joint)] = joint[0]
    links[kept] = got
    on = label != np.arange(m)
    return links, kept[on], kept[label[on]]


# == on Spark


def _keys(base: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, bytes) of the documents that have words."""

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        a, b, size = text_keys(K.words(part.column(1)), part.num_rows)
        on = pa.array(size > 0)
        return pa.RecordBatch.from_arrays([x.filter(on) for x in (part.column(0), pa.array(a), pa.array(b), pc.binary_length(part.column(1)).cast(pa.int64()))], names=["doc_id", "k1", "k2", "bytes"])

    return K.map_steps(base, f, "doc_id long, k1 long, k2 long, bytes long")


def _common_grams(base: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams common in a sample of the documents, sorted, and their ranks by number."""
    some = base.where(F.expr(f"pmod(xxhash64(doc_id), {HOT_EVERY}) = 0"))

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, _U), *gram_sets(part.column(1), n)]).view(np.int64))], names=["gram"])

    top = K.map_steps(some, f, "gram long").groupBy("gram").count().where(F.col("count") >= HOT_LEAST).orderBy(F.desc("count"), "gram").limit(HOT_MOST).toArrow()
    gram = K.column(top, "gram").view(_U)
    o = np.argsort(gram)
    return gram[o], (len(o) - np.arange(len(o)))[o]


#: Columns of a block of shares, and those that are compressed together as "rest", as they have few bits set or small values.
_ROW = {"key": "<u2", "high_key": np.uint8, "label": "<u4", "high_label": "<u2"}
_REST = {"bits": "<u8", "more_bits": "<u8", "size": np.uint8, "place": np.uint8}
_CODEC = "zstd"


def route_of(s: Shares, routes: int) -> np.ndarray:
    """The task that each row goes to: all rows of a subtree to the same.  A part's subtrees are divided among so many tasks as parts of its class are too few for all."""
    k = s.part >> 48
    tasks = np.maximum(1, routes >> 2 * k + 2).astype(_U)
    h = K.mix(K.mix(s.part.astype(_U)) + s.key % tasks)
    return ((h >> _U(32)) * _U(routes) >> _U(32)).astype(np.int64)


def _send(n: int, t: float, hot: np.ndarray, rank: np.ndarray, routes: int):
    """Blocks of shares by route, with 24 bits of the subtree's name and 48 bits of the text's key.

    Texts that a task has sent already are not sent again.
    """

    def packed(s: Shares) -> list[np.ndarray]:
        name = s.key >> _U(40)
        values = (name & _U(0xFFFF), name >> _U(16), s.label & _U(0xFFFFFFFF), s.label >> _U(32), s.bits, s.more_bits, np.minimum(s.size, 255), np.minimum(s.place, 255))
        return [route_of(s, routes).astype(np.uint16 if routes <= 65536 else np.int32), *(v.astype(kind) for v, kind in zip(values, (_ROW | _REST).values()))]

    def block(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        route = np.concatenate([r[0] for r in rows])
        o = np.argsort(route, kind="stable").astype(np.int32)
        route = route[o]
        edge = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1], [True]]))
        runs = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        columns = [np.concatenate([r[c] for r in rows])[o] for c in range(1, len(_ROW | _REST) + 1)]
        plain, low = columns[: len(_ROW)], columns[len(_ROW) :]
        data = [pa.array([c[x:y].tobytes() for x, y in runs], pa.binary()) for c in plain]
        data.append(pa.array([pa.compress(b"".join([c[x:y].tobytes() for c in low]), _CODEC, asbytes=True) for x, y in runs], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(route[edge[:-1]].astype(np.int32)), *data], names=["route", *_ROW, "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        rows: list[list[np.ndarray]] = []
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in K.steps(batch):
                    w = K.words(part.column(1))
                    label = text_keys(w, part.num_rows)[0].view(_U) & _LABEL
                    sets = sets_of(w, part.num_rows, n)
                    new = []
                    for i, (s, x) in enumerate(zip(sets, label.tolist())):
                        if len(s) and x not in sent:
                            sent.add(x)
                            new.append(i)
                    if not new:
                        continue
                    at, size = np.array(new), np.array([len(sets[i]) for i in new])
                    least, most = size_class(np.ceil(t * size - 1e-9).astype(np.int64)), size_class(size)
                    for k in range(int(least.min()), int(most.max()) + 1):
                        on = at[(least <= k) & (k <= most)]
                        if len(on):
                            rows.append(packed(shares([sets[i] for i in on], label[on], k, t, hot, rank)))
                    if sum(len(r[0]) for r in rows) >= GATHER:
                        yield block(rows)
                        rows = []
            if rows:
                yield block(rows)

    return run


def _may_match(s: Shares, x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Whether the shares x and y may be similar and have no common gram before this one; 255 stands for any greater size too."""
    a, b = s.size[x].astype(np.int64), s.size[y].astype(np.int64)
    need = required(a, b, t)
    apart = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in (s.bits, s.more_bits))
    ok = (np.minimum(a, b) >= t * np.maximum(a, b) - 1e-9) & (apart <= a + b - 2 * need)
    ok &= np.minimum(a - s.place[x].astype(np.int64), b - s.place[y].astype(np.int64)) >= need
    return ok | (a >= 255) | (b >= 255)


def met(key: np.ndarray) -> np.ndarray:
    """Rows whose subtree has another row, in order of subtrees."""
    o = np.argsort(key, kind="stable")
    twice = np.zeros(len(o), bool)
    same = key[o][1:] == key[o][:-1]
    twice[1:] |= same
    twice[:-1] |= same
    return o[twice]


def meeting(s: Shares, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the sets whose shares meet in a subtree and may be similar; a pair that is connected otherwise needs no edge of its own."""
    s = s.take(met(s.key))
    if not len(s.key):
        return s.label, s.label
    kinds = (s.key, s.size, s.bits, s.more_bits)
    o = np.lexsort(kinds[::-1])
    s, kinds = s.take(o), [c[o] for c in kinds]
    # shares that are alike are chained to the first of them, the variant
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in kinds], axis=0)])
    first = np.flatnonzero(new)
    us, vs = [s.label[~new]], [np.repeat(s.label[first], np.diff(np.concatenate([first, [len(new)]])))[~new]]
    s = s._replace(place=np.minimum.reduceat(s.place, first)[np.cumsum(new) - 1]).take(first)
    start = np.flatnonzero(np.concatenate([[True], s.key[1:] != s.key[:-1]]))
    length = np.diff(np.concatenate([start, [len(s.key)]]))
    for a, m in zip(start[length > RUN].tolist(), length[length > RUN].tolist()):
        # by breadth: what is reached needs no more tests among itself
        rest = np.arange(a, a + m)
        while len(rest):
            todo, rest = [int(rest[0])], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                hit = _may_match(s, x, rest, t)
                got = rest[hit]
                us.append(s.label[got])
                vs.append(np.full(len(got), s.label[x]))
                todo += got.tolist()
                rest = rest[~hit]
    later = np.where(np.repeat(length, length) <= RUN, np.repeat(start + length, length) - np.arange(len(s.key)) - 1, 0)
    rows = np.flatnonzero(later)
    total, at = np.cumsum(later[rows]), 0
    while at < len(rows):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 19), "right")), at + 1)
        r, at = rows[at:to], to
        x, y = np.repeat(r, later[r]), _spread(r + 1, later[r])
        ok = _may_match(s, x, y, t)
        us.append(s.label[x[ok]])
        vs.append(s.label[y[ok]])
    return forest(np.concatenate(us), np.concatenate(vs))


def _meet(t: float):
    def f(table: pa.Table) -> pa.RecordBatch:
        def column(name: str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), _ROW[name])

        key = column("key").astype(np.uint32) | column("high_key").astype(np.uint32) << 16
        # most subtrees have one row: the other columns are taken without those
        at = met(key)
        label = column("label")[at].astype(np.int64) | column("high_label")[at].astype(np.int64) << 32
        width = sum(np.dtype(kind).itemsize for kind in _REST.values())
        rest = {name: np.empty(len(key), kind) for name, kind in _REST.items()}
        end = 0
        for part, some in zip(table.column("high_key").to_pylist(), table.column("rest").to_pylist()):
            begin, end, raw, place = end, end + len(part), pa.decompress(some, width * len(part), _CODEC), 0
            for name, kind in _REST.items():
                rest[name][begin:end] = np.frombuffer(raw, kind, len(part), place)
                place += len(part) * np.dtype(kind).itemsize
        rest = {name: c[at] for name, c in rest.items()}
        s = Shares(key=key[at], part=rest["size"], label=label, **rest)
        u, v = meeting(s, t)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return f


def _joined(n: int, t: float, pairs: bool):
    """The join of each group of rows (comp, i, j, node, block, copies, k1, k2, text), sorted by group and node.

    For pairs: (a, b, jaccard).  Else (a, a, links) with the number of documents linked to
    a set in this group, and edges (a, b, 0) that connect the similar sets.
    """

    def of(held: list[tuple[int, int, int, np.ndarray]], one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, block, copies = (np.array([h[c] for h in held]) for c in range(3))
        if not pairs and len(held) > CROWD:
            links, u, v = crowd_links([h[3] for h in held], t, copies, None if one else block)
            on = links > 0
            return np.concatenate([node[on], node[u]]), np.concatenate([node[on], node[v]]), np.concatenate([links[on], np.zeros(len(u), np.int64)]).astype(np.float64)
        a, b, o = trie_join([h[3] for h in held], t)
        if not one:
            on = block[a] != block[b]
            a, b, o = a[on], b[on], o[on]
        size = np.array([len(h[3]) for h in held])
        if pairs:
            return node[a], node[b], o / (size[a] + size[b] - o)
        links = np.bincount(np.concatenate([a, b]), np.concatenate([copies[b], copies[a]]), len(node)).astype(np.int64)
        on = links > 0
        u, v = forest(node[a], node[b])
        return np.concatenate([node[on], u]), np.concatenate([node[on], v]), np.concatenate([links[on], np.zeros(len(u), np.int64)]).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            group, held, out, rows = None, [], [], 0

            def close() -> None:
                nonlocal rows
                if len(held) > 1:
                    out.append(of(held, group[1] == group[2]))
                    rows += len(out[-1][0])

            def batch_of() -> pa.RecordBatch:
                nonlocal out, rows
                got = [np.concatenate([x[c] for x in out]) for c in range(3)]
                out, rows = [], 0
                return pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["a", "b", "w"])

            for batch in batches:
                for part in K.steps(batch, 8):
                    w = K.words(part.column(8))
                    x, y, _ = text_keys(w, part.num_rows)
                    # a repeated id may bring another text along
                    right = (x == K.column(part, "k1")) & (y == K.column(part, "k2"))
                    columns = [part.column(c).to_pylist() for c in range(6)]
                    for comp, i, j, node, block, copies, ok, grams in zip(*columns, right.tolist(), sets_of(w, part.num_rows, n)):
                        if (comp, i, j) != group:
                            close()
                            group, held = (comp, i, j), []
                        if ok and not (held and held[-1][0] == node):
                            held.append((node, block, copies, grams))
                    if rows > 50_000:
                        yield batch_of()
            close()
            if rows:
                yield batch_of()

    return run


class Texts(NamedTuple):
    """The join in its factored form: (doc_id, k1, k2) of each document, (k1, k2, lead, copies) of each different text, and (node, lead, k1, k2, copies) of those texts that may have partners; all checkpointed, with the rows of the join."""

    docs: DataFrame
    texts: DataFrame
    nodes: DataFrame
    joined: DataFrame


def _join(docs: DataFrame, id_col: str, text_col: str, n: int, t: float, pairs: bool) -> Texts:
    base = K.ids_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    every = K.cut(_keys(base))
    d = every.groupBy("doc_id", "k1", "k2").agg(F.max("bytes").alias("bytes"))
    texts = K.cut(d.groupBy("k1", "k2").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies"), F.max("bytes").alias("bytes")))
    amount = texts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # about one prefix gram in 9 bytes of text, of some 20 bytes packed
    routes = max(docs.sparkSession.sparkContext.defaultParallelism, int(2.7 * amount) // ROUTE_BYTES, 1)
    hot, rank = _common_grams(base, n)
    sent = base.mapInArrow(K.released(_send(n, t, hot, rank, routes)), "route int, " + ", ".join(f"{c} binary" for c in [*_ROW, "rest"]))
    comp = connected(K.map_partition(sent.repartitionById(routes, F.col("route")), _meet(t), "u long, v long"))
    may = texts.withColumn("label", F.col("k1").bitwiseAND(F.lit(int(_LABEL)))).join(comp.withColumnRenamed("node", "label"), "label")
    nodes = K.cut(may.select("lead", "k1", "k2", "copies", "bytes", "comp", F.monotonically_increasing_id().alias("node")))
    # a node for each text; those of a large component in blocks, each pair of which is a group
    large = K.cut(nodes.groupBy("comp").agg(F.sum(F.greatest("bytes", F.lit(TEXT_BYTES))).alias("all")).where(F.col("all") > BLOCK_BYTES).select("comp", F.ceil(F.col("all") / BLOCK_BYTES).alias("blocks")))
    wanted = nodes.join(K.small(large, large.count()), "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    wanted = wanted.withColumn("block", F.expr("pmod(xxhash64(node), blocks)")).withColumnRenamed("lead", "doc_id")
    with_text = base.join(K.small(wanted, nodes.count()), "doc_id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    groups = with_text.select("*", other).select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies", "k1", "k2", "text")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(amount) // (4 * BLOCK_BYTES))
    rows = groups.repartition(tasks, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node").mapInArrow(K.released(_joined(n, t, pairs)), "a long, b long, w double")
    return Texts(d.select("doc_id", "k1", "k2"), texts, nodes, K.cut(rows))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lead) of each document, lead being the least id of those with the same words, and (left_id, right_id, jaccard) of each pair of leads of different but similar texts.

    Rows as in ngram_jaccard_join().  The pairs of a group of many different similar
    texts are by their nature quadratic in their number; its classes are not.
    """
    j = _join(docs, id_col, text_col, n, threshold, True)
    a, b = (j.nodes.select(F.col("node").alias(x), F.col("lead").alias(y)) for x, y in (("a", "l"), ("b", "r")))
    pairs = j.joined.join(a, "a").join(b, "b")
    return _with_text(j.docs, j.texts).select("doc_id", "lead"), pairs.select(F.least("l", "r").alias("left_id"), F.greatest("l", "r").alias("right_id"), F.round("w", 6).alias("jaccard"))


def _with_text(d: DataFrame, texts: DataFrame) -> DataFrame:
    """d with the columns of its texts; texts of very many documents go to them by broadcast, so that none of these joins has a hot key."""
    often = texts.where(F.col("copies") > K.BROADCAST_ROWS)
    many = often.count()
    if not many:
        return d.join(texts, ["k1", "k2"])
    often = K.small(often, many)
    rest = d.join(K.small(often.select("k1", "k2"), many), ["k1", "k2"], "left_anti").join(texts, ["k1", "k2"])
    return d.join(often, ["k1", "k2"]).unionByName(rest)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): a row for each document that has words.

    links is the number of other documents whose n-gram sets have at least that Jaccard
    similarity to its own; class_id is the least id of those it is linked to, directly or
    over others, and its own.  Null ids, and null, empty or wordless texts, give no row;
    repeated rows count once; an id that occurs with several texts gives a row for each,
    as if they were different documents.  A tie with the threshold is similar.  Texts are
    taken whole, however long.  Empty tables give no rows; other columns are not read.
    """
    j = _join(docs, id_col, text_col, n, threshold, False)
    links = j.joined.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("w").cast("long").alias("more"))
    comp = connected(j.joined.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = j.nodes.drop("comp").join(links, "node").join(comp, "node")
    least = nodes.groupBy("comp").agg(F.min("lead").alias("class_id"))
    found = nodes.join(least, "comp").select("k1", "k2", "class_id", "more")
    texts = j.texts.join(found, ["k1", "k2"], "left").select("k1", "k2", "copies", F.coalesce("class_id", "lead").alias("class_id"), (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return _with_text(j.docs, K.cut(texts)).select("doc_id", "class_id", "links")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents whose class (see ngram_jaccard_join) has one of a lesser id.

    Null ids and wordless texts are in no class and stay; rows that share an id share its
    fate; empty tables stay empty; all columns are kept.
    """
    dropped = K.cut(ngram_jaccard_join(docs, id_col, text_col, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(K.small(dropped, dropped.count()), id_col, "left_anti").select(*docs.columns)
