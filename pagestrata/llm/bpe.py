"""Operator 7: byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round packs each two neighbours
of a word into a 64-bit key, finds their ranks by binary search over the sorted keys
of all mergeable pairs, and merges in every word the occurrences of its lowest-ranked
pair; words without a mergeable pair are done.  Decoding gathers token bytes.
"""

from __future__ import annotations

import base64
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkit as K

#: Where the vocabulary lies; read on the driver only.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation that the vocabulary's tokenizer uses.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same on texts without the characters of _WIDE, where classes are plain ranges; twice as fast.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_FAST = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+").findall
_WIDE = re.compile(r"[^\x00-\x1b\x20-\x7e\xa0-\xb1\xb4-\xb8\xba-\xbb\xbf-\xff]").search
#: Words that a worker remembers before it starts over; bounds memory, changes no result.
REMEMBERED = 400_000
SCHEMA = "doc_id long, n_tokens int, tokens array<int>, round_trip boolean"
_NONE = np.iinfo(np.int64).max


class Vocab(NamedTuple):
    keys: np.ndarray  # sorted left << 32 | right of every mergeable pair
    merged: np.ndarray  # token that each pair makes, which is also its rank
    single: np.ndarray  # token of each byte
    raw: np.ndarray  # bytes of all tokens, one after another
    start: np.ndarray
    size: np.ndarray


def load(path: str = VOCAB) -> Vocab:
    """Reads a ranks file (base64 token and rank a line)."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    keys, merged = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                merged.append(rank)
    k = np.array(keys, np.int64)
    o = np.argsort(k)
    by_rank: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
    size = np.array([len(t) for t in by_rank], np.int64)
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    return Vocab(k[o], np.array(merged, np.int64)[o], single, np.frombuffer(b"".join(by_rank), np.uint8), np.cumsum(size) - size, size)


def merge(vocab: Vocab, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words in one array, and the number of each word's."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(b) for b in raw], np.int64)
    sym = vocab.single[np.frombuffer(b"".join(raw), np.uint8)]
    word = np.repeat(np.arange(len(words)), size)
    done_sym, done_word = [], []
    rank = np.full(len(sym), _NONE)
    stale = np.arange(len(sym))  # places whose pair with the next symbol is to be looked up
    while len(sym):
        rank[stale] = _NONE
        inside = stale[stale + 1 < len(sym)]
        inside = inside[word[inside + 1] == word[inside]]
        if len(inside):
            key = sym[inside] << 32 | sym[inside + 1]
            at = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
            rank[inside] = np.where(vocab.keys[at] == key, vocab.merged[at], _NONE)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        count = np.diff(np.concatenate([first, [len(word)]]))
        least = np.repeat(np.minimum.reduceat(rank, first), count)
        over = least == _NONE
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
            on = ~over
            sym, word, rank, least = sym[on], word[on], rank[on], least[on]
            if not len(sym):
                break
        # of occurrences that overlap (aaa), every second one of a run, from the left
        h = np.flatnonzero(rank == least)
        run_at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1] + 1]))
        within = np.arange(len(h)) - np.repeat(run_at, np.diff(np.concatenate([run_at, [len(h)]])))
        h = h[within % 2 == 0]
        sym[h] = least[h]
        keep = np.ones(len(sym), bool)
        keep[h + 1] = False
        place = np.cumsum(keep) - 1
        now = place[h]
        sym, word, rank = sym[keep], word[keep], rank[keep]
        fresh = np.zeros(len(sym), bool)
        fresh[now] = fresh[np.maximum(now - 1, 0)] = True
        stale = np.flatnonzero(fresh)
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    o = np.argsort(word, kind="stable")
    return sym[o], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts, remembering the words it has seen."""

    def __init__(self, vocab: Vocab, pattern: str = PATTERN):
        slow = regex.compile(pattern).findall
        self.vocab = vocab
        self.find = (lambda t: slow(t) if _WIDE(t) else _FAST(t)) if pattern == PATTERN else slow
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = self.size = self.start = np.zeros(0, np.int64)

    def learn(self, words: set[str]) -> None:
        known = self.known
        new = sorted(w for w in words if w not in known)
        if not new:
            return
        flat, size = merge(self.vocab, new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.flat = np.concatenate([self.flat, flat])
        self.size = np.concatenate([self.size, size])
        self.start = np.cumsum(self.size) - self.size

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Numbers of all pre-tokens of the texts, how many each text has, and the pre-tokens."""
        cut = [self.find(t) for t in texts]
        n = np.array([len(c) for c in cut], np.int64)
        seen = set().union(*cut) if cut else set()
        if len(self.known) + len(seen) > REMEMBERED:
            self.forget()
        self.learn(seen)
        get = self.known.__getitem__
        idx = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(n.sum()))
        return idx, n, cut

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in one array, and the number of each text's."""
        idx, n, _ = self.words(texts)
        size = self.size[idx]
        where = np.repeat(self.start[idx] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        total = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(n)])
        return self.flat[where], np.diff(total[edge])


def decode(vocab: Vocab, tokens: np.ndarray) -> bytes:
    """Bytes of a sequence of tokens."""
    size = vocab.size[tokens]
    where = np.repeat(vocab.start[tokens] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return vocab.raw[where].tobytes()


def encode(docs: DataFrame, vocab: Vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every row: its whole text's tokens, and whether decoding them gives the text back.

    Null and empty texts have no tokens (round_trip true); null ids are kept as null;
    repeated rows give repeated results; other columns are not read.
    """
    kept: list[Encoder] = []

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(Encoder(vocab))
        texts = [t or "" for t in part.column(1).to_pylist()]
        tokens, n = kept[0].encode(texts)
        edge = np.concatenate([[0], np.cumsum(n)])
        whole = decode(vocab, tokens)
        bytes_at = np.concatenate([[0], np.cumsum(vocab.size[tokens])])[edge]
        same = [whole[a:b] == t.encode() for a, b, t in zip(bytes_at, bytes_at[1:], texts)]
        lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(tokens.astype(np.int32)))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    return K.map_steps(K.ids_and_text(docs, id_col, text_col), f, SCHEMA)


def decode_column(df: DataFrame, vocab: Vocab, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) of token lists; null lists give null, bytes that are not UTF-8 are replaced as usual."""

    def run(batches):
        for batch in batches:
            texts = [None if t is None else decode(vocab, np.asarray(t, np.int64)).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{tokens_col}` as array<int>) as tokens").mapInArrow(run, "doc_id long, text string")
