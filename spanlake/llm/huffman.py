"""Canonical length-limited Huffman coding of token ids in independent blocks.

A code is one array of bit lengths, 0 for an id that does not occur.  Rows of ids are packed most
significant bit first, each from a byte boundary; every ``interval`` ids a checkpoint keeps the bit
offset, so that decoding follows all checkpoints of a block side by side, one table look-up per id.
"""

from __future__ import annotations

import struct

import numpy as np

MAX_BITS = 18
INTERVAL = 512
_MAGIC = b"CHB1"
_HEAD = "<4sBIIQ"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best lengths of at most ``max_bits`` for the counts (package-merge); 0 where a count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    merged, is_leaf, levels = leaves, np.ones(len(leaves), bool), []
    levels.append(is_leaf)
    for _ in range(max_bits - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.r_[leaves, packages]
        order = np.argsort(both, kind="stable")
        merged, is_leaf = both[order], order < len(leaves)
        levels.append(is_leaf)
    take, found = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        found[:own] += 1
        take = 2 * (take - own)
    lengths[used] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths.max(initial=1))
    span = np.uint64(1) << (np.uint64(width) - lengths[used].astype(np.uint64))
    first = np.cumsum(span) - span
    codes[used] = (first >> (np.uint64(width) - lengths[used].astype(np.uint64))).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) by the next ``width`` bits, and ``width``."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths.max(initial=1))
    span = np.int64(1) << (width - lengths[used].astype(np.int64))
    ids, size = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    filled = int(span.sum())
    ids[:filled], size[:filled] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, size, width


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray,
         interval: int = INTERVAL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of consecutive rows of ``counts`` ids each.

    Returns the bytes, the byte offset of each row (n + 1), and the bit offset, from its row's
    start, of every ``interval``-th id of each row.
    """
    size = lengths[ids].astype(np.int64)
    done = np.cumsum(size)
    ends = np.cumsum(counts)
    begins = ends - counts
    bits_at = np.r_[0, done]
    row_bits = bits_at[ends] - bits_at[begins]
    offsets = np.r_[0, np.cumsum((row_bits + 7) // 8)]
    in_row = done - size - np.repeat(bits_at[begins], counts)
    place = in_row + np.repeat(offsets[:-1] * 8, counts)
    word = place >> 5
    value = codes[ids].astype(np.uint64) << (64 - (place & 31) - size).astype(np.uint64)
    n = int(offsets[-1] // 4 + 3)
    # The bits of one word never overlap, so its parts add up exactly in a double.
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    data = (high + low).astype(np.uint64).astype(">u4").view(np.uint8)[:offsets[-1]]
    nth = np.arange(len(ids)) - np.repeat(begins, counts)
    return data, offsets, in_row[nth % interval == 0]


def unpack(data: np.ndarray, starts: np.ndarray, counts: np.ndarray,
           table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of segments that begin at the bits ``starts`` and hold ``counts`` ids, in order."""
    ids, size, width = table
    out_at = np.r_[0, np.cumsum(counts)]
    out = np.zeros(out_at[-1], np.uint32)
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint32)
    window = (padded[:-3] << np.uint32(24) | padded[1:-2] << np.uint32(16)
              | padded[2:-1] << np.uint32(8) | padded[3:])
    order = np.argsort(-counts, kind="stable")
    place, target = starts[order].astype(np.int64), out_at[:-1][order].copy()
    left = -counts[order]  # ascending
    mask = np.uint32((1 << width) - 1)
    for step in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(left, -step, "left"))
        at = place[:live]
        shift = (32 - width - (at & 7)).astype(np.uint32)
        key = (window[at >> 3] >> shift) & mask
        out[target[:live] + step] = ids[key]
        at += size[key]
    return out


def segment_counts(counts: np.ndarray, interval: int) -> np.ndarray:
    """Number of ids in each checkpointed segment of rows with ``counts`` ids."""
    whole = (counts + interval - 1) // interval
    row = np.repeat(np.arange(len(counts)), whole)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
    return np.minimum(interval, counts[row] - nth * interval)


def write_block(doc_ids: list, counts: np.ndarray, payloads: list[bytes],
                checkpoints: list[np.ndarray], interval: int = INTERVAL) -> bytes:
    """A block that can be read alone: counts, document ids, checkpoints, bits."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    sizes = np.array([len(p) for p in payloads], np.int64)
    segments = np.array([len(c) for c in checkpoints], np.int64)
    begin = np.repeat((np.cumsum(sizes) - sizes) * 8, segments)
    bits = (np.concatenate(checkpoints) + begin).astype("<u8")
    head = struct.pack(_HEAD, _MAGIC, 1, len(doc_ids), interval, len(bits))
    return b"".join([head, ids.tobytes(), known.tobytes(), counts.astype("<u8").tobytes(),
                     bits.tobytes(), *payloads])


def read_block(block: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, number of ids of each, and all ids of a block."""
    magic, version, n, interval, n_bits = struct.unpack_from(_HEAD, block)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    at = struct.calcsize(_HEAD)
    ids = np.frombuffer(block, "<i8", n, at)
    known = np.frombuffer(block, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(block, "<u8", n, at + 9 * n).astype(np.int64)
    bits = np.frombuffer(block, "<u8", n_bits, at + 17 * n).astype(np.int64)
    data = np.frombuffer(block, np.uint8, offset=at + 17 * n + 8 * n_bits)
    doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
    return doc_ids, counts, unpack(data, bits, segment_counts(counts, interval), table)
