"""Operator 4: edit-aware token counts.

Each document keeps two segment trees over its pre-tokens, one of lengths and one of
token counts.  An edit finds its pre-tokens by descending the tree of lengths, scans
again from a boundary that the edit cannot have moved until the new boundaries fall
on old ones, re-encodes what lies between and updates the sums above it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import bpe
from . import textkit as K

SCHEMA = "doc_id long, tokens_before int, edits int, tokens_after int, pretokens int, reencoded int"
Edit = tuple[int, int, str]
_PRIVATE = regex.compile(
    r"(?P<EMAIL>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<PHONE>\+\d{1,3} \(\d{2,4}\) \d{3}-\d{4})|(?P<IP>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]))|(?P<NUMBER>(?<!\d)\d{13,19}(?!\d))"
)


def redactions(text: str) -> list[Edit]:
    """The edits that put a tag in the place of e-mail addresses, phone numbers, IPv4 addresses and card-like numbers."""
    if not any(c in text for c in "0123456789@"):
        return []
    return [(m.start(), m.end(), f"[{m.lastgroup}]") for m in _PRIVATE.finditer(text)]


class SumTree:
    """Segment tree of sums over a fixed number of slots: node k holds the sum of nodes 2k and 2k+1, the slots are the nodes from n on."""

    def __init__(self, nodes: np.ndarray):
        self.n, self.t = len(nodes) // 2, nodes

    @property
    def total(self) -> int:
        return int(self.t[1])

    def find(self, offset: int) -> tuple[int, int]:
        """The slot that holds the unit at offset (the last one beyond the end), and the sum before it."""
        i, before = 1, 0
        while i < self.n:
            i *= 2
            if before + self.t[i] <= offset:
                before += int(self.t[i])
                i += 1
        return i - self.n, before

    def put(self, slot: int, to: int, value: int) -> None:
        """Gives slot the value, and those after it before to none."""
        a, b = self.n + slot, self.n + to - 1
        self.t[a : b + 1] = 0
        self.t[a] = value
        while a > 1:
            a //= 2
            b //= 2
            self.t[a : b + 1] = self.t[2 * a : 2 * b + 2 : 2] + self.t[2 * a + 1 : 2 * b + 2 : 2]


def trees(values: np.ndarray, sizes: np.ndarray) -> list[SumTree]:
    """Trees of successive runs of values, those of one depth built together."""
    out: list[SumTree] = [SumTree(np.zeros(2, np.int64))] * len(sizes)
    first = np.cumsum(sizes) - sizes
    width = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for n in np.unique(width):
        rows = np.flatnonzero(width == n)
        nodes = np.zeros((len(rows), 2 * n), np.int64)
        count = sizes[rows]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        nodes[np.repeat(np.arange(len(rows)), count), n + within] = values[np.repeat(first[rows], count) + within]
        k = n
        while k > 1:
            nodes[:, k // 2 : k] = nodes[:, k : 2 * k : 2] + nodes[:, k + 1 : 2 * k : 2]
            k //= 2
        for r, x in zip(rows, nodes):
            out[r] = SumTree(x)
    return out


class CountedText:
    """A text with its trees of lengths and counts; apply() keeps them right under edits."""

    def __init__(self, text: str, slots: int, lengths: SumTree, counts: SumTree, encoder: bpe.Encoder, scan: Callable):
        self.text, self.slots, self.lengths, self.counts = text, slots, lengths, counts
        self.encoder, self.scan, self.reencoded = encoder, scan, 0

    @classmethod
    def of(cls, texts: list[str], encoder: bpe.Encoder, scan: Callable) -> list[CountedText]:
        """The counted form of each text."""
        idx, n, cut = encoder.words(texts)
        lengths = trees(np.fromiter(map(len, chain.from_iterable(cut)), np.int64, len(idx)), n)
        return [cls(t, int(k), a, b, encoder, scan) for t, k, a, b in zip(texts, n, lengths, trees(encoder.size[idx], n))]

    @property
    def total(self) -> int:
        return self.counts.total

    def apply(self, start: int, end: int, put: str) -> None:
        """Replaces text[start:end]; only the region touched and its context are encoded again."""
        text = self.text = self.text[:start] + put + self.text[end:]
        if not self.slots:
            self.slots = 1
            self.lengths, self.counts = SumTree(np.zeros(2, np.int64)), SumTree(np.zeros(2, np.int64))
        shift = len(put) - (end - start)
        # a boundary stays if all that decided it lies before the edit; white space looks two characters beyond its end
        slot, at = self.lengths.find(max(0, start - 2))
        n, ends, seen = self.lengths.n, at, []
        to, old_end = slot, at
        for m in self.scan(text, at):
            ends = m.end()
            seen.append(m.group())
            while to < self.slots and old_end + shift < ends:
                old_end += int(self.lengths.t[n + to])
                to += 1
            if to > slot and old_end >= end and old_end + shift == ends:
                break
        else:
            to = self.slots
        to = max(to, slot + 1)
        self.encoder.learn(set(seen))
        self.lengths.put(slot, to, sum(map(len, seen)))
        self.counts.put(slot, to, int(sum(self.encoder.size[self.encoder.known[s]] for s in seen)))
        self.reencoded += len(seen)


def recount(docs: DataFrame, vocab: bpe.Vocab, edits: Callable[[str], list[Edit]] = redactions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens_before, edits, tokens_after, pretokens, reencoded) of every row; edits gives a text's edits, ascending and disjoint, as (start, end, replacement).

    Null and empty texts count 0 tokens and are edited as the empty text; null ids are
    kept as null; repeated rows give repeated results; other columns are not read.
    """
    kept: list[bpe.Encoder] = []

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(bpe.Encoder(vocab))
        encoder, scan = kept[0], regex.compile(bpe.PATTERN).finditer
        texts = [t or "" for t in part.column(1).to_pylist()]
        rows = []
        for tree in CountedText.of(texts, encoder, scan):
            before, changes = tree.total, edits(tree.text)
            for a, b, put in reversed(changes):
                tree.apply(a, b, put)
            rows.append((before, len(changes), tree.total, tree.slots, tree.reencoded))
        cols = np.array(rows, np.int32).reshape(-1, 5)
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(cols[:, j]) for j in range(5))], names=["doc_id", "tokens_before", "edits", "tokens_after", "pretokens", "reencoded"])

    return K.map_steps(K.ids_and_text(docs, id_col, text_col), f, SCHEMA)
