"""Operator 3: benchmark decontamination by suffix arrays of the training text.

Each shard of training text gets a suffix array over its words; every suffix of
every benchmark item is binary-searched in it, which gives the run of training
suffixes that share at least ``min_words`` words with it, and from them the longest
verbatim matches and their places.  The array is sparse: positions whose first two
words occur nowhere in the benchmark cannot begin a match and are left out, and
words that the benchmark doesn't know end a suffix.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

MIN_WORDS = 8
SHARD_BYTES = 4 << 20
#: Characters of benchmark text that one pass over the training text takes along; a larger benchmark takes several passes.
SLICE_CHARS = 4_000_000
SCHEMA = "doc_id long, item_id long, match_words int, doc_word int, item_word int"
_U = np.uint64


class Tests(NamedTuple):
    """Benchmark items as word ids (1.. in order of hash; 0 ends an item), packed several to a key."""

    vocab: np.ndarray
    pairs: np.ndarray
    seen: np.ndarray
    bits: int
    packed: np.ndarray
    suffix: np.ndarray  # places in packed of the suffixes of at least min_words words
    item: np.ndarray  # item of each suffix
    offset: np.ndarray
    min_words: int


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Keys of the next 64/bits ids at each place, zero from the first 0 on."""
    lanes = 64 // bits
    padded = np.concatenate([ids, np.zeros(lanes, ids.dtype)]).astype(_U)
    key, alive = np.zeros(len(ids), _U), np.ones(len(ids), bool)
    for j in range(lanes):
        x = padded[j : j + len(ids)]
        alive = alive & (x != 0)
        key = (key << _U(bits)) | np.where(alive, x, _U(0))
    return key


def prepare(item_ids: list[int], texts: list[str], min_words: int) -> Tests | None:
    w = K.words(pa.array(texts, pa.string()))
    if not len(w.hash):
        return None
    size = np.bincount(w.doc, minlength=len(texts))
    vocab = np.unique(w.hash)
    bits = 16 if len(vocab) < 65535 else 32
    # a 0 after each item
    place = np.arange(len(w.hash)) + w.doc
    ids = np.zeros(len(w.hash) + len(texts), np.int64)
    ids[place] = np.searchsorted(vocab, w.hash) + 1
    within = np.arange(len(w.hash)) - np.repeat(np.cumsum(size) - size, size)
    enough = size[w.doc] - within >= min_words
    if not enough.any():
        return None
    two = K.window_hash(w.hash, 2)[w.doc[1:] == w.doc[:-1]] if len(w.hash) > 1 else np.zeros(0, _U)
    pairs = np.unique(two)
    seen = np.zeros(1 << 20, bool)
    seen[(pairs & _U((1 << 20) - 1)).astype(np.int64)] = True
    return Tests(vocab, pairs, seen, bits, pack(ids, bits), place[enough], np.asarray(item_ids, np.int64)[w.doc[enough]], within[enough], min_words)


def sort_suffixes(at: np.ndarray, packed: np.ndarray, lanes: int) -> np.ndarray:
    """Places in the order of their suffixes: by the first key, ties by the next keys until the suffixes end."""
    padded = np.concatenate([packed, np.zeros(1, _U)])
    key = padded[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    low = _U((1 << (64 // lanes)) - 1)
    alive = (key & low) != 0  # the suffix goes on beyond this key
    depth = lanes
    while True:
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        open_ = np.flatnonzero(tied & alive)
        if not len(open_):
            return at
        nxt = padded[np.minimum(at[open_] + depth, len(packed))]
        o = np.lexsort((nxt, group[open_]))
        at[open_], nxt, g = at[open_][o], nxt[o], group[open_]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1])])
        # split groups keep their order and get distinct numbers
        group[open_] = g * (len(at) + 1) + np.cumsum(fresh)
        rest = np.ones(len(at), bool)
        rest[open_] = False
        group[rest] *= len(at) + 1
        _, group = np.unique(group, return_inverse=True)
        now = np.zeros(len(at), bool)
        now[open_] = (nxt & low) != 0
        alive = now
        depth += lanes


def bound(tests: Tests, sa: np.ndarray, packed: np.ndarray, lanes: int, upper: bool) -> np.ndarray:
    """For every test suffix, where in sa the suffixes that share its first min_words words begin (or end)."""
    tp, pp = np.concatenate([tests.packed, np.zeros(1, _U)]), np.concatenate([packed, np.zeros(1, _U)])
    columns = [(c * lanes, min(lanes, tests.min_words - c * lanes)) for c in range(-(-tests.min_words // lanes))]
    lo, hi = np.zeros(len(tests.suffix), np.int64), np.full(len(tests.suffix), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        below, tie = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for depth, used in columns:
            cut = _U((64 // lanes) * (lanes - used))
            a = pp[np.minimum(sa[mid] + depth, len(packed))] >> cut
            b = tp[np.minimum(tests.suffix[open_] + depth, len(tests.packed))] >> cut
            below |= tie & (a < b)
            tie &= a == b
            # a suffix that has ended is compared no further
        right = below | tie if upper else below
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def match_lengths(a: np.ndarray, ap: np.ndarray, b: np.ndarray, bp: np.ndarray, lanes: int) -> np.ndarray:
    """Words that the suffixes at a and b have in common."""
    ap, bp = np.concatenate([ap, np.zeros(1, _U)]), np.concatenate([bp, np.zeros(1, _U)])
    n = np.zeros(len(a), np.int64)
    open_, depth, bits = np.arange(len(a)), 0, 64 // lanes
    while len(open_):
        x, y = ap[np.minimum(a[open_] + depth, len(ap) - 1)], bp[np.minimum(b[open_] + depth, len(bp) - 1)]
        whole, got = np.ones(len(open_), bool), np.zeros(len(open_), np.int64)
        for j in range(lanes):
            s = _U(bits * (lanes - 1 - j))
            lane = _U((1 << bits) - 1)
            whole &= ((x >> s) & lane == (y >> s) & lane) & ((x >> s) & lane != 0)
            got += whole
        n[open_] += got
        open_ = open_[whole]
        depth += lanes
    return n


def search(tests: Tests, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(document, item, words, document's word, item's word) of the longest match of each document and item; ties to the least item's word, then document's word."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    w = K.words(texts)
    if len(w.hash) < tests.min_words:
        return none
    two = K.window_hash(w.hash, 2)
    at = np.flatnonzero(tests.seen[(two & _U((1 << 20) - 1)).astype(np.int64)])
    at = at[tests.pairs[np.minimum(np.searchsorted(tests.pairs, two[at]), len(tests.pairs) - 1)] == two[at]]
    if not len(at):
        return none
    lanes = 64 // tests.bits
    # ids of the words, with a 0 after each document; only words near a start are looked up
    near = np.zeros(len(w.hash), bool)
    near[at] = True
    near[np.minimum(at + 1, len(near) - 1)] = True
    found = np.zeros(len(w.hash), np.int64)
    k = np.flatnonzero(near)
    v = np.minimum(np.searchsorted(tests.vocab, w.hash[k]), len(tests.vocab) - 1)
    found[k] = np.where(tests.vocab[v] == w.hash[k], v + 1, 0)
    shift = w.doc - w.doc[0]
    ids = np.zeros(len(w.hash) + int(shift[-1]) + 1, np.int64)
    place = np.arange(len(w.hash)) + shift
    ids[place] = found
    packed = pack(ids, tests.bits)
    sa = sort_suffixes(place[at], packed, lanes)
    lo, hi = bound(tests, sa, packed, lanes, False), bound(tests, sa, packed, lanes, True)
    count = hi - lo
    test = np.repeat(np.arange(len(count)), count)
    if not len(test):
        return none
    where = sa[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(test))]
    n = match_lengths(tests.suffix[test], tests.packed, where, packed, lanes)
    word = np.searchsorted(place, where)
    doc = w.doc[word]
    first = np.searchsorted(w.doc, np.arange(len(texts)))
    item, item_word, doc_word = tests.item[test], tests.offset[test], word - first[doc]
    o = np.lexsort((doc_word, item_word, -n, item, doc))
    o = o[np.concatenate([[True], (doc[o][1:] != doc[o][:-1]) | (item[o][1:] != item[o][:-1])])]
    return doc[o], item[o], n[o], doc_word[o], item_word[o]


def benchmark_slices(benchmark: DataFrame, id_col: str, text_col: str, min_words: int) -> list[Tests]:
    """The benchmark, collected in slices of bounded size; null ids and texts are left out."""
    b = K.ids_and_text(benchmark, id_col, text_col).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    total = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-int(total) // SLICE_CHARS)
    out = []
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k).dropDuplicates().orderBy("doc_id", "text").collect()
        t = prepare([r[0] for r in rows], [r[1] for r in rows], min_words)
        out += [t] if t else []
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): the longest verbatim match of each document and benchmark item that share at least min_words words in a row.

    Words are compared lower-cased, offsets count words from 0, ties go to the least
    item_word, then doc_word.  Items of fewer than min_words words, and null or empty
    texts on either side, match nothing.  Null document ids are kept as null,
    repeated rows give repeated results; an item id with several texts gives a row
    for each slice-wise best text; an empty benchmark gives no rows; other columns
    are not read.
    """
    base = K.ids_and_text(docs, id_col, text_col)
    out = None
    for tests in benchmark_slices(benchmark, item_col, item_text_col, min_words):

        def f(part: pa.RecordBatch, tests: Tests = tests) -> pa.RecordBatch:
            doc, item, n, dw, iw = search(tests, part.column(1))
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(item), *(pa.array(x.astype(np.int32)) for x in (n, dw, iw))], names=["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        one = base.mapInArrow(_stepped(f), SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _stepped(f, text: int = 1):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in K.steps(batch, text, SHARD_BYTES):
                    out = f(part)
                    if out.num_rows:
                        yield out

    return K.released(run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the rows whose text holds a match; all columns as they were, in one pass without a join (one pass more for each further slice of a large benchmark)."""
    at = docs.columns.index(text_col)
    for tests in benchmark_slices(benchmark, item_col, item_text_col, min_words):

        def f(part: pa.RecordBatch, tests: Tests = tests) -> pa.RecordBatch:
            keep = np.ones(part.num_rows, bool)
            keep[search(tests, part.column(at))[0]] = False
            return part.filter(pa.array(keep))

        docs = docs.mapInArrow(_stepped(f, at), docs.schema)
    return docs
