"""Vectorised text primitives shared by the operators (numpy over Arrow buffers).

A *word* is a maximal run of ``[0-9a-z]`` or non-ASCII bytes of the lower-cased
text; in RE2 syntax ``[0-9a-z\\x{80}-\\x{10FFFF}]+`` over ``lower(text)``.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_RE2 = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Bytes of text that one numpy step works on; a longer document makes a step of its own.
STEP_BYTES = 1 << 20
#: Rows up to which a side of (long, long) rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)
IS_WORD = np.zeros(256, bool)
IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
IS_WORD[0x80:] = True


class Words(NamedTuple):
    """Words of a block of texts: document index, hash and byte span of each."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that low and high bits are both usable."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_POW = np.ones(1, _U)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 256)
        _POW = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, _BASE, _U))])
    return _POW


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(texts: pa.Array) -> pa.Array:
    """Lower-cased texts; nulls become empty."""
    return pc.utf8_lower(pc.fill_null(texts, ""))


def words(texts: pa.Array) -> Words:
    """All words of the texts (see the module's definition), in text order."""
    data, offsets = buffers(lowered(texts))
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, np.zeros(0, _U), z, z)
    is_word = IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = is_word[:-1]
    first = is_word & (~prev | edge[:n])
    start = np.flatnonzero(first)
    following = np.empty(n, bool)
    following[-1] = False
    following[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~following | edge[1:])) + 1
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return Words(z, np.zeros(0, _U), z, z)
    length = end - start
    body = np.flatnonzero(is_word)
    firsts = np.cumsum(length) - length
    place = np.arange(len(body)) - np.repeat(firsts, length)
    value = (data[body].astype(_U) + _U(1)) * _powers(int(length.max()))[place]
    h = mix(np.add.reduceat(value, firsts))
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(doc, h, start, end)


def word_hash(word: str) -> int:
    """The hash that words() gives a single word."""
    return int(words(pa.array([word])).hash[0])


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n successive values, by doubling; length len(h)-n+1."""
    if len(h) < n:
        return np.zeros(0, _U)
    have, size, cur, cur_n = None, 0, h * _MULT, 1
    power = np.array([_BASE])
    while True:
        if n & cur_n:
            if have is None:
                have, size = cur, cur_n
            else:
                m = len(h) - size - cur_n + 1
                have = have[:m] * power + cur[size : size + m]
                size += cur_n
        if size == n:
            return mix(have)
        m = len(cur) - cur_n
        cur = cur[:m] * power + cur[cur_n : cur_n + m]
        power = power * power
        cur_n *= 2


def steps(batch: pa.RecordBatch, text: int = 1, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which memory is given back; else a Python worker, which lives on between tasks, holds the most that any of them took."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return f


def map_steps(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: int = 1) -> DataFrame:
    """Applies f to slices of bounded text size of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in steps(batch, text):
                    out = f(part)
                    if out is not None and out.num_rows:
                        yield out

    return df.mapInArrow(released(run), schema)


def map_partition(df: DataFrame, f: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies f once to all rows of each partition; for narrow numeric rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            got = [b for b in batches if b.num_rows]
            if got:
                out = f(pa.Table.from_batches(got))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(released(run), schema)


def column(table: pa.Table | pa.RecordBatch, name: str, kind=np.int64) -> np.ndarray:
    c = table.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def ids_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that operators read; whatever else a table has stays out of the plan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> None:
    """Sees to it that checkpoint() has a folder: the cluster's own, or one of ours where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"checkpoints-{os.getuid()}")
    sc.setCheckpointDir(there)


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only where its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
