"""Passages of benchmark items in documents, up to an edit budget.

A match of an item of m characters with at most k edits shares at least m - Q + 1 - k * Q of the
item's Q-grams with its region, all on diagonals (place in document minus place in item) that lie
within k of each other.  So shared Q-grams are counted per item in overlapping bands of diagonals,
bands that reach the bound are kept, and a banded alignment decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

Q = 8
#: Edits allowed, as a share of an item's characters.
EDITS = 0.1
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 2_000_000
CHARS_AT_ONCE = 1 << 19
_FILTER_BITS = 22
_STEP = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    """Lower case, one space for each run of white space."""
    return " ".join((text or "").lower().split())


def edit_budget(m: int, edits: float = EDITS) -> int:
    """Edits for an item of m characters: at most what leaves one Q-gram to share."""
    return max(0, min(int(edits * m), (m - Q) // Q)) if m >= Q else 0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    n = max(len(points) - Q + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out = out * np.uint64(_STEP) + points[k:n + k]
    return out ^ (out >> np.uint64(29))


@dataclass(frozen=True)
class ItemIndex:
    """Q-grams of a block of items: sorted hashes, their postings, and each item's bounds."""

    ids: list
    plain: list
    texts: list
    budget: np.ndarray
    need: np.ndarray
    width: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: list

    @staticmethod
    def of(items: list[tuple]) -> "ItemIndex":
        """Items are (id, text); those without characters match nothing."""
        items = [(i, normal(t)) for i, t in items]
        long = [(i, t) for i, t in items if len(t) >= Q]
        size = np.array([len(t) for _, t in long], np.int64)
        budget = np.array([edit_budget(m) for m in size], np.int64)
        grams = [_grams(_points(t)) for _, t in long]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(long)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        every, item, place = every[order], item[order], place[order]
        new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][:len(every)])
        return ItemIndex([i for i, _ in long], [t for _, t in long], [_points(t) for _, t in long], budget,
                         size - Q + 1 - budget * Q, 2 * budget + 1, every[new],
                         np.r_[new, len(every)], item, place, [(i, t) for i, t in items if 0 < len(t) < Q])


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] numbers for each k, one after the other."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - count - first, count)


def candidate_bands(points: np.ndarray, at: np.ndarray, index: ItemIndex,
                    quick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first diagonal) of the bands that reach their item's bound.

    ``points`` are the rows' characters, each row followed by a zero.  A band starts at each
    multiple of the item's width and also holds the next ``budget`` diagonals.
    """
    grams = _grams(points)
    hit = np.flatnonzero(quick[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    found = np.searchsorted(index.hashes, grams[hit])
    found[found == len(index.hashes)] = 0
    real = index.hashes[found] == grams[hit]
    hit, found = hit[real], found[real]
    row = np.searchsorted(at, hit, "right") - 1
    # A region holds all the hits it needs within the reach of the longest item.
    near = int(max(len(t) for t in index.texts) + index.budget.max())
    dense = (np.searchsorted(hit, hit + near, "right") - np.searchsorted(hit, hit - near)
             >= index.need.min())
    hit, found, row = hit[dense], found[dense], row[dense]
    count = index.begin[found + 1] - index.begin[found]
    posting = _expand(index.begin[found], count)
    item, place = index.item[posting], index.place[posting]
    diagonal = np.repeat(hit - at[row], count) - place
    row = np.repeat(row, count)
    width = index.width[item]
    band = diagonal // width
    also = np.flatnonzero(diagonal - band * width <= index.budget[item])
    key = np.r_[(row * len(index.ids) + item) << 32 | (band + (1 << 31)),
                ((row * len(index.ids) + item) << 32 | (band - 1 + (1 << 31)))[also]]
    place = np.r_[place, place[also]]
    keys, group, number = np.unique(key, return_inverse=True, return_counts=True)
    need = index.need[(keys >> 32) % len(index.ids)]
    # The bound is on different grams of the item: a text that repeats itself repeats only a few.
    full = (number >= need)[group]
    group, place = group[full], place[full]
    group = np.unique(group << 32 | place) >> 32
    good = np.bincount(group, minlength=len(keys)) >= need
    keys = keys[good]
    which, band = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
    item = which % len(index.ids)
    return which // len(index.ids), item, band * index.width[item]


def banded_edits(text: np.ndarray, item: np.ndarray, first: int, width: int) -> tuple[int, int]:
    """Least edits of the whole item against any part of ``text`` along ``width`` diagonals from
    ``first``, and the end of that part."""
    far = 1 << 20
    diagonal = first + np.arange(width)
    cost = np.where((diagonal >= 0) & (diagonal <= len(text)), 0, far)
    slope = np.arange(width)
    shift = width + len(item) + max(0, -first)
    around = np.full(shift, 0xFFFFFFFF, np.uint32)
    padded = np.concatenate([around, text, around])
    for k, point in enumerate(item):
        at = diagonal + k  # place of the character that a substitution uses
        seen = padded[first + k + shift:first + k + shift + width]
        new = cost + (seen != point)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new = np.where((at + 1 >= 0) & (at + 1 <= len(text)), new, far)
        cost = np.minimum.accumulate(new - slope) + slope
    best = int(cost.argmin())
    return int(cost[best]), int(diagonal[best]) + len(item)


def _find(index: ItemIndex, quick: np.ndarray, ids: list, texts: list[str]) -> list[tuple]:
    """(document, item, edits, end) rows of the matches in a run of texts."""
    out = []
    clean = [normal(t) for t in texts]
    if index.ids:
        size = np.array([len(t) + 1 for t in clean])
        at = np.r_[0, np.cumsum(size)]
        points = _points("\0".join(clean) + "\0")
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for row, item, first in zip(*(x.tolist() for x in candidate_bands(points, at, index, quick))):
            as_is = clean[row].find(index.plain[item])
            if as_is >= 0:
                best[row, item] = 0, as_is + len(index.plain[item])
                continue
            text = points[at[row]:at[row + 1] - 1]
            # The band's part of the text, so that a long text costs no more than a short one.
            low = max(0, first)
            span = index.width[item] + index.budget[item] + len(index.texts[item])
            some = text[low:max(low, first + span + 1)]
            edits, end = banded_edits(some, index.texts[item], first - low, int(index.width[item] + index.budget[item] + 1))
            if edits <= index.budget[item]:
                held = best.get((row, item))
                if held is None or (edits, low + end) < held:
                    best[row, item] = edits, low + end
        out += [(ids[r], index.ids[i], e, end) for (r, i), (e, end) in best.items()]
    for item_id, short in index.short:
        for doc_id, text in zip(ids, clean):
            place = f" {text} ".find(f" {short} ")
            if place >= 0:
                out.append((doc_id, item_id, 0, place + len(short)))
    return out


_MATCH = "doc_id long, item_id long, edits int, end long"


def _runs(texts: list) -> Iterator[tuple[int, int]]:
    """First and end row of runs of texts of about CHARS_AT_ONCE characters."""
    low, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= CHARS_AT_ONCE or k == len(texts) - 1:
            yield low, k + 1
            low, size = k + 1, 0


def _prepared(items: list[tuple]) -> tuple[ItemIndex, np.ndarray]:
    index = ItemIndex.of(items)
    quick = np.zeros(1 << _FILTER_BITS, bool)
    quick[(index.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return index, quick


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Items in runs of at most ``most`` characters (or one item), one run at a time on the driver."""
    held, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        if held and size + len(row.text or "") > most:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text or "")
    if held:
        yield held


def benchmark_matches(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, edits, end``: each document with each item that it holds.

    Texts and items are compared in lower case with single spaces; ``edits`` is the least number
    found, at most a tenth of the item's characters, ``end`` the place after the match in the
    normalised text.  An item of fewer than Q characters must occur as it is between spaces; one
    without characters (or null) is in no document.  Rows that repeat an id or a text match each;
    equal items match each.  Either table may be empty.  The items are a query set that is sent to
    the tasks in blocks of bounded size; each block is one pass over the documents, without shuffle.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", "text")
    found = spark.createDataFrame([], _MATCH)
    for block in _blocks(items, block_chars):
        sent = spark.sparkContext.broadcast(block)  # at most block_chars characters

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, quick = _prepared(sent.value)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for low, high in _runs(texts):
                    got = _find(index, quick, ids[low:high], texts[low:high])
                    if got:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)],
                                                         ["doc_id", "item_id", "edits", "end"])

        found = found.union(rows.mapInArrow(search, _MATCH))
    return found


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``benchmark_matches``, one per document and item."""
    return benchmark_matches(docs, items).groupBy("doc_id", "item_id").agg(
        F.min("edits").alias("edits"), F.count("*").alias("n_rows"))


def without_matches(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay as they are."""
    for block in _blocks(items, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # at most block_chars characters

        def choose(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, quick = _prepared(sent.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                good = np.ones(len(texts), bool)
                for low, high in _runs(texts):
                    for row, *_ in _find(index, quick, list(range(low, high)), texts[low:high]):
                        good[row] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(choose, docs.schema)
    return docs
