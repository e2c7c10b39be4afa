"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact set checks.

A signature has SLOTS values of 16 bits, and its distance to another is the number of slots that
differ.  The slots are split into CHUNKS; two signatures at a distance of at most MOST_APART differ
in at most ERRORS slots of some chunk, so they agree on one of the keys made by leaving out every
choice of ERRORS slots of every chunk.  Sets with a similarity of 0.8 differ in 20 % of the slots on
average and in more than MOST_APART of 24 with a chance of 0.1 %; at 0.85 it is below 0.01 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanlake.session import cut_lineage

from .bytetext import chunks, fold_case, mix, shingle_hashes, word_hashes, word_spans
from .components import components

SLOTS, CHUNKS, ERRORS = 24, 4, 2
MOST_APART = CHUNKS * (ERRORS + 1) - 1
#: 64-bit words of a set's bitmap.
BITMAP = 32
SHINGLE = 5
SIMILARITY = 80  # percent


def _shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingles of each row, and the rows' offsets."""
    folded = fold_case(data)
    starts, ends, rows = word_spans(folded, at)
    hashes, owner, _ = shingle_hashes(word_hashes(folded, starts, ends), rows, n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(at)))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SLOTS 16-bit values per row: the low bits of the least of SLOTS different hashes."""
    n = len(at) - 1
    out = np.zeros((n, SLOTS), np.uint16)
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full):
        return out
    seeds = mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
    for slot in range(SLOTS):
        values = (hashes ^ seeds[slot]) * seeds[-1 - slot]
        values ^= values >> np.uint64(32)
        least = np.minimum.reduceat(values, at[:-1][full])
        out[full, slot] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, signature`` of every row; equal sets have equal (a, b)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in chunks(batch.column(1)):
                hashes, set_at = _shingle_sets(data, at, n)
                total = np.r_[np.uint64(0), np.cumsum(mix(hashes))]
                other = np.r_[np.uint64(0), np.cumsum(mix(hashes * np.uint64(0xD1342543DE82EF95)))]
                raw = signatures(hashes, set_at).tobytes()
                width = 2 * SLOTS
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(set_at)),
                     _signed(total[set_at[1:]] - total[set_at[:-1]]),
                     _signed(other[set_at[1:]] - other[set_at[:-1]]),
                     pa.array([raw[k:k + width] for k in range(0, len(raw), width)], pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def join_keys(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of each signature (a row each): every chunk with every choice of ERRORS slots left
    out.  The lowest bits of a key are its chunk.

    Beside each key, the values of the slots left out before its last slot, -1 for none.  Two
    signatures that agree on several keys of a chunk agree on just one whose slots left out before its
    last all differ: the one of the first slots they have in common.
    """
    width = SLOTS // CHUNKS
    keys, left = [], []
    none = np.full(len(matrix), -1, np.int64)
    for chunk in range(CHUNKS):
        for number, kept in enumerate(combinations(range(width), width - ERRORS)):
            packed = np.zeros(len(matrix), np.uint64)
            for slot in kept:
                packed = packed << np.uint64(16) | matrix[:, chunk * width + slot].astype(np.uint64)
            key = mix(packed + mix(np.uint64([(chunk << 8) + number + 1]))[0])
            keys.append(key & ~np.uint64(CHUNKS - 1) | np.uint64(chunk))
            out = [matrix[:, chunk * width + s].astype(np.int64) if s < kept[-1] else none
                   for s in range(width) if s not in kept]
            left.append(out)
    return np.stack(keys, 1), *(np.stack([x[k] for x in left], 1) for k in range(ERRORS))


_LEFT = [f"left{k}" for k in range(ERRORS)]


def _keys(sketches: DataFrame) -> DataFrame:
    """``key, node, left0, left1``: every key of every node, and what :func:`join_keys` puts beside it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            matrix = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
            for low in range(0, len(nodes), 5000):
                keys, *left = join_keys(matrix[low:low + 5000])
                own = np.repeat(nodes[low:low + 5000], keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [_signed(keys.ravel()), pa.array(own), *[pa.array(x.ravel().astype(np.int32)) for x in left]],
                    ["key", "node", *_LEFT])

    kinds = ", ".join(f"{c} int" for c in _LEFT)
    return sketches.select("node", "signature").mapInArrow(spread, f"key long, node long, {kinds}")


def _first_key(a: str, b: str):
    """Whether a key is the first of its chunk's that two nodes share, so that a pair meets once a chunk."""
    return reduce(and_, [(F.col(f"{a}_{x}") < 0) | (F.col(f"{a}_{x}") != F.col(f"{b}_{x}")) for x in _LEFT])


def _bits(side: str) -> list[str]:
    return [f"{side}{k}" for k in range(BITMAP)]


def _may_reach(a: str, b: str, percent: int):
    """Whether two sets can reach the similarity, by bitmaps of their shingles.

    Every bit in which the bitmaps differ is due to a shingle that only one set has, and with d such
    shingles the similarity is (n + m - d) / (n + m + d) for sizes n and m; so no pair is lost.
    """
    apart = reduce(add, [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(_bits(a), _bits(b))])
    size = F.col(f"{a}_size") + F.col(f"{b}_size")
    return apart * (100 + percent) <= size * (100 - percent)


def _side(sets: DataFrame, name: str) -> DataFrame:
    """Node, size and bitmap with columns named after one side of a pair."""
    return sets.select(F.col("node").alias(name), F.col("size").alias(f"{name}_size"),
                       *[F.col(x).alias(y) for x, y in zip(_bits("bits"), _bits(name))])


def _shingle_table(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``node, size, bits0..., shingles`` of the nodes: whole sorted sets and bitmaps of them."""
    texts = docs.join(nodes, "node", "left_semi").select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in chunks(batch.column(1)):
                hashes, set_at = _shingle_sets(data, at, n)
                raw, rows = hashes.tobytes(), high - low
                place = (mix(hashes) % np.uint64(64 * BITMAP)).astype(np.int64)
                flags = np.zeros(rows * 64 * BITMAP, np.uint8)
                flags[np.repeat(np.arange(rows), np.diff(set_at)) * 64 * BITMAP + place] = 1
                bits = np.packbits(flags).view(np.int64).reshape(rows, BITMAP)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, rows), pa.array(np.diff(set_at)),
                     *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(BITMAP)],
                     pa.array([raw[8 * set_at[k]:8 * set_at[k + 1]] for k in range(rows)], pa.binary())],
                    ["node", "size", *_bits("bits"), "shingles"])

    columns = ", ".join(f"{c} long" for c in ["node", "size", *_bits("bits")])
    # Rows that repeat an id may give a node twice; any one with the node's id and text is the same.
    return cut_lineage(texts.mapInArrow(sets, columns + ", shingles binary"), "shingle-sets")


def _verified(found: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole shingle sets reach the similarity.

    A document in many pairs is spread by Spark's skew handling: both joins are plain equi joins.
    """
    with_b = pairs.join(found.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    both = with_b.join(found.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            good = []
            for k in range(len(one)):
                a, b = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (one, two))
                merged = np.concatenate([a, b])
                merged.sort(kind="stable")
                shared = int((merged[1:] == merged[:-1]).sum())
                good.append(100 * shared >= percent * (len(a) + len(b) - shared))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])

    return both.select("a", "b", "_a", "_b").mapInArrow(check, "a long, b long")


def _open_side(placed: DataFrame, name: str) -> DataFrame:
    return placed.select("key", F.col("node").alias(name), F.col("component").alias(f"{name}_component"),
                         F.col("size").alias(f"{name}_size"), *[F.col(x).alias(f"{name}_{x}") for x in _LEFT],
                         *[F.col(x).alias(y) for x, y in zip(_bits("bits"), _bits(name))])


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of ``n``-word
    shingles; a component is named by its least doc_id, which is the one kept.  Rows with equal sets
    are one node, so copies make no pairs.  Within a key, nodes first meet a few centres; after the
    components of these links, the nodes of a key that are still in different components meet each
    other, once for each chunk that they agree in, where bitmaps of their sets leave the link possible.
    So no link between components is lost, and a large group makes few pairs.

    A text without words (or null) has an empty set and stands alone.  Rows that repeat a doc_id
    with different texts are linked through that id; a null doc_id is one document of its own with
    a null component.  Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketches = cut_lineage(_sketches(rows, n), "sketches")
    classes = cut_lineage(
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "set_a", "set_b")
        .agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")),
        "sketch-classes")
    members = sketches.join(classes.drop("signature"), ["n_shingles", "set_a", "set_b"])
    same = members.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    nodes = classes.select("node", "signature")
    texts = rows.withColumnRenamed("doc_id", "node")

    keys = _keys(nodes)
    # Keys of one node only are of no use; counts are summed in tasks first.
    used = keys.groupBy("key").count().where("count > 1").select("key")
    shared = cut_lineage(keys.join(used, "key"), "shared-keys")
    sets = _shingle_table(texts, shared.select("node").distinct(), n)

    # First and last node of each key by a hash that depends on the chunk: few centres for many keys.
    place = F.struct(F.xxhash64("node", F.col("key").bitwiseAND(F.lit(CHUNKS - 1))), "node")
    centres = (shared.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high"))
               .select("key", F.array("low.node", "high.node").alias("centres")))
    first = (shared.join(centres, "key").select("node", F.explode("centres").alias("other"))
             .where("node <> other")
             .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    near = (first.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
            .where(_may_reach("a", "b", percent)).select("a", "b"))
    links = cut_lineage(_verified(sets, cut_lineage(near, "pairs"), percent), "verified")

    known = components(links)
    placed = shared.join(known, "node", "left").select("key", "node", *_LEFT, F.coalesce("component", "node").alias("component"))
    open_keys = (placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"))
                 .where("c <> d").select("key"))
    placed = cut_lineage(placed.join(open_keys, "key", "left_semi").join(sets.drop("shingles"), "node"), "open-keys")
    # Second round, by centres that differ from key to key, for nodes that missed the first ones.
    again = F.struct(F.xxhash64("node", "key"), "node")
    ends = (placed.groupBy("key").agg(F.min(again).alias("low"), F.max(again).alias("high"))
            .select("key", F.explode(F.array("low.node", "high.node")).alias("b")))
    second = (_open_side(placed, "a").join(_open_side(placed, "b").join(ends, ["key", "b"], "left_semi"), "key")
              .where((F.col("a_component") != F.col("b_component")) & _may_reach("a", "b", percent))
              .select("a", "b", "a_component", "b_component").distinct())
    second = cut_lineage(second, "pairs")
    linked = cut_lineage(_verified(sets, second.select("a", "b"), percent), "verified")
    merged = components(second.join(linked, ["a", "b"]).select(
        F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    placed = (placed.withColumnRenamed("component", "old").join(merged.withColumnRenamed("node", "old"), "old", "left")
              .withColumn("component", F.coalesce("component", "old")).drop("old"))
    rest = (_open_side(placed, "a").join(_open_side(placed, "b"), "key")
            .where((F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component")) & _first_key("a", "b")
                   & _may_reach("a", "b", percent)).select("a", "b").distinct())
    more = _verified(sets, cut_lineage(rest, "pairs"), percent)
    whole = components(links.union(linked).union(more).union(same))

    return (sketches.select("doc_id", "n_shingles").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("component_id", F.coalesce("component", "doc_id")).drop("component")
            .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))))


def without_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the least doc_id.

    Of rows that repeat that id one stays, the first by text.  Documents with a null id stay.
    """
    found = cut_lineage(near_duplicates(docs, n, percent), "near-duplicates")
    gone = cut_lineage(found.where("NOT kept").select("doc_id").distinct(), "duplicate-ids")
    again = cut_lineage(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count()
                        .where("count > 1").select("doc_id"), "repeated-ids")
    kept = docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    if again.isEmpty():
        return kept
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    place = "_place_of_repeated_id"
    first = (kept.join(again, "doc_id", "left_semi").withColumn(place, rank).where(f"{place} = 1"))
    return (kept.join(again, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
            .unionByName(first.select(*[f"`{c}`" for c in docs.columns])))
