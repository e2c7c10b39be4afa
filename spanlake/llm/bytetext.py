"""Words, shingles and their hashes for whole Arrow batches of texts, as numpy arrays.

A batch is one run of UTF-8 bytes with document offsets.  Words are runs of bytes other than
space and ``\\t``..``\\r``; a word's 64-bit hash comes from one cumulative sum over the bytes, so
the work is a few passes over the bytes whatever the number of words.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_STEP = 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 20


#: Rows and bytes that go to a Python worker at once: whole texts are large, and a worker holds a
#: batch twice.  A longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Have Spark send at most BATCH_ROWS rows or BATCH_BYTES bytes at once from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def worker_cache(name: str) -> types.ModuleType:
    """An object that lives as long as the Python worker and is shared by its tasks."""
    return sys.modules.setdefault(f"_worker_cache_{name}", types.ModuleType(name))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        empty = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
        column = column.fill_null(empty)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes; a longer
    text is a run of its own."""
    data, at = column_bytes(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high, data[at[low]:at[high]], at[low:high + 1] - at[low]
        low = high


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache("powers")
    if getattr(cache, "size", 0) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        step, back = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        step[0] = back[0] = 1
        cache.up, cache.down, cache.size = np.cumprod(step), np.cumprod(back), size
        if size > 4 * CHUNK_BYTES:  # tables of a very long text do not stay
            up, down = cache.up, cache.down
            cache.size = 0
            return up, down
    return cache.up, cache.down


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    n = len(data)
    inside = np.ones(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    joined = cut[inside[cut] & inside[cut + 1]]  # a word ends and another begins between rows
    first[joined] = True
    last[joined] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    rows = np.searchsorted(at, starts, "right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


#: Words of more bytes get a cryptographic hash: a polynomial of 64 bits has equal values for some fixed long texts.
LONG_WORD = 255


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; equal for different words only by chance, also of words made for it."""
    hashes = span_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[k] = int.from_bytes(blake2b(data[starts[k]:ends[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int,
                   short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each run of ``n`` words; with ``short``, a row of fewer words is
    one shingle."""
    count = len(words)
    if not count:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.uint64(_WORD_STEP)

    def rolled(length: int, firsts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(firsts), np.uint64)
        for k in range(length):
            total = total * step + words[firsts + k]
        return mix(total + np.uint64(length))

    firsts = np.arange(max(count - n + 1, 0))
    firsts = firsts[rows[firsts] == rows[firsts + n - 1]]
    hashes, owner = rolled(n, firsts), rows[firsts]
    if short:
        begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        length = np.diff(np.r_[begin, count])
        for k in range(1, n):
            few = begin[length == k]
            if len(few):
                hashes, owner = np.r_[hashes, rolled(k, few)], np.r_[owner, rows[few]]
                firsts = np.r_[firsts, few]
        order = np.argsort(owner, kind="stable")
        hashes, owner, firsts = hashes[order], owner[order], firsts[order]
    return hashes, owner, firsts
