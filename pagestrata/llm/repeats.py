"""Operator 6: repeated passages by a depth-limited radix sort of all suffixes.

Suffixes are ordered only through their first ``window`` words, the digits being
blocks of words: the most significant digit (the first half of the window) routes a
suffix to a partition and orders it there; suffixes alone with their digit are
dropped, the others are ordered by the next digit (the second half).  Groups equal
in both are exactly the repeated windows.  Digits are 32-bit block hashes; with the
routing (a modulus of the 64-bit hash of the first block) and the order inside.

Suffixes travel as columnar blocks: of each step of text one row per partition with
the digits and the byte planes of the places' differences, about 9 bytes a suffix.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

WINDOW = 50
STEP_BYTES = 8 << 20
SCHEMA = "doc_id long, start_word int, n_words int, copies int"
_BLOCK = "route int, step long, docs binary, digits binary, places binary"
_U = np.uint64


def planes(x: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers: the upper ones are nearly all zero and compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def windows(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, K.Words]:
    """Place (word of the step), first and second digit of every window that lies in one document."""
    w = K.words(texts)
    half = n // 2
    if len(w.hash) < n:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, _U), np.zeros(0, _U), w
    m = len(w.hash) - n + 1
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    a = K.window_hash(w.hash, half)[at] if half else np.zeros(len(at), _U)
    b = K.window_hash(w.hash, n - half)[at + half]
    return at, a, b, w


def _emit(n: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        step = (context.partitionId() if context else 0) << 32
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in K.steps(batch, 1, STEP_BYTES):
                    at, a, b, w = windows(part.column(1), n)
                    if not len(at):
                        continue
                    route = (a % _U(parts)).astype(np.int64)
                    o = np.argsort(route.astype(np.uint16) if parts <= 65536 else route, kind="stable")
                    at, route = at[o], route[o]
                    digits = np.stack([(a[o] >> _U(32)).astype("<u4"), (b[o] >> _U(32)).astype("<u4")])
                    edge = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1], [True]]))
                    rows = [(int(route[x]), step, None, digits[:, x:y].tobytes(), planes(np.diff(at[x:y], prepend=0))) for x, y in zip(edge[:-1], edge[1:])]
                    # the step's documents travel along once
                    size = np.bincount(w.doc, minlength=part.num_rows)
                    table = np.stack([part.column(0).to_numpy(zero_copy_only=False).astype("<i8"), np.cumsum(size) - size]).astype("<i8").tobytes()
                    rows.append((int(K.mix(np.array([step], _U))[0] % _U(parts)), step, table, None, None))
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["route", "step", "docs", "digits", "places"])
                    step += 1

    return run


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orders a partition's suffixes and sends the repeated ones back to their steps, with the sizes of their groups."""
    steps, sizes, first, second, places = [], [], [], [], []
    names = ["step", "docs", "places", "copies"]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    for batch in batches:
        for s, d, g, p in zip(*(batch.column(c).to_pylist() for c in ("step", "docs", "digits", "places"))):
            if d is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([s], [d], [None], [None]), kinds)], names=names)
            else:
                x = np.frombuffer(g, "<u4")
                steps.append(s)
                sizes.append(len(x) // 2)
                first.append(x[: len(x) // 2])
                second.append(x[len(x) // 2 :])
                places.append(np.cumsum(unplanes(p)))
    if not steps:
        return
    block = np.repeat(np.arange(len(steps)), sizes)
    place = np.concatenate(places)
    # pass 1: the first digit; a suffix alone with it is unique
    d = np.concatenate(first)
    first.clear()
    o = np.argsort(d)
    same = d[o][1:] == d[o][:-1]
    tied = np.zeros(len(o), bool)
    tied[1:] |= same
    tied[:-1] |= same
    o = o[tied]
    group = np.cumsum(np.concatenate([[True], d[o][1:] != d[o][:-1]])) if len(o) else o
    # pass 2: the second digit, among the tied
    e = np.concatenate(second)[o]
    p = np.lexsort((e, group))
    o, group, e = o[p], group[p], e[p]
    if not len(o):
        return
    start = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (e[1:] != e[:-1])]))
    size = np.diff(np.concatenate([start, [len(o)]]))
    copies = np.repeat(size, size)
    o, copies = o[copies > 1], copies[copies > 1]
    back = np.lexsort((place[o], block[o]))
    o, copies = o[back], copies[back]
    edge = np.flatnonzero(np.concatenate([[True], block[o][1:] != block[o][:-1], [True]])) if len(o) else np.zeros(1, np.int64)
    rows = [(steps[block[o[x]]], None, planes(np.diff(place[o[x:y]], prepend=0)), planes(copies[x:y])) for x, y in zip(edge[:-1], edge[1:])]
    for k in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256]), kinds)], names=names)


def spans(place: np.ndarray, copies: np.ndarray, ids: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of successive repeated windows of each document."""
    o = np.argsort(place)
    place, copies = place[o], copies[o]
    doc = np.searchsorted(first, place, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])]))
    run = np.diff(np.concatenate([new, [len(place)]]))
    return ids[doc[new]], place[new] - first[doc[new]], run + n - 1, np.maximum.reduceat(copies, new)


def _spans(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[int, bytes] = {}
        found: dict[int, list[tuple[bytes, bytes]]] = defaultdict(list)
        for batch in batches:
            for s, d, p, c in zip(*(batch.column(k).to_pylist() for k in ("step", "docs", "places", "copies"))):
                if d is not None:
                    docs[s] = d
                else:
                    found[s].append((p, c))
        for s, got in found.items():
            ids, first = np.frombuffer(docs[s], "<i8").reshape(2, -1)
            place = np.concatenate([np.cumsum(unplanes(p)) for p, _ in got])
            copies = np.concatenate([unplanes(c) for _, c in got])
            i, at, size, most = spans(place, copies, ids, first, n)
            yield pa.RecordBatch.from_arrays([pa.array(i), *(pa.array(x.astype(np.int32)) for x in (at, size, most))], names=["doc_id", "start_word", "n_words", "copies"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start_word, n_words, copies): the maximal passages of each document all of whose windows of that many words occur more than once in the table; copies is the most that any of them occurs.

    Words are compared lower-cased and counted from 0; a window may recur in its own
    document.  Rows with a null id, and null, empty or shorter texts, have none;
    repeated rows are copies of each other and each is reported; empty tables give no
    rows; other columns are not read.  docs should be a scan or a checkpoint, whose
    rows come in the same order if a task is run again: steps are named by partition.
    """
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = K.ids_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1))
    blocks = base.mapInArrow(_emit(window, parts), _BLOCK)
    ordered = blocks.repartitionById(parts, F.col("route")).mapInArrow(_order, "step long, docs binary, places binary, copies binary")
    return ordered.repartition(parts, "step").mapInArrow(_spans(window), SCHEMA)
