"""Remove long byte strings that occur more than once, across documents and within one.

Every window of LENGTH bytes names an anchor, its least hashed GRAM-byte string (leftmost of
equals), so equal windows have equal anchors and meet under the anchor's hash.  Consecutive windows
with one anchor make a piece of text.  Only pieces whose anchor occurs elsewhere go on; equal
pieces are merged; where an anchor has several different pieces, longest-previous-factor arrays over
them, from previous and next smaller positions in suffix order, tell which windows occur earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanlake.session import cut_lineage

from .bytetext import chunks, mix, span_hashes

LENGTH, GRAM = 400, 100
#: Windows are hashed in runs of so many; a longer text is taken in overlapping runs.
RUN = 600_000
#: Bytes that one suffix order covers; pieces under one anchor beyond which they are compared by
#: hashes of all their windows, dealt over all tasks, instead of in one task.
ORDER_BYTES, ORDER_PIECES = 256_000, 10_000
_NO_ID = -(1 << 63)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, number of windows) of each piece.

    ``ends`` holds, for each byte, where its document ends.  At most 2**20 bytes.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(data, at, at + GRAM)
    least = (grams >> np.uint64(20) << np.uint64(20)) | at.astype(np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while width * 2 <= span:  # least of twice as many in each round
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least[:n] & np.uint64((1 << 20) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.arange(n) + LENGTH <= ends[:n])
    if not len(starts):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    own = anchor[starts]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return grams[own[new]], starts[new], np.diff(np.r_[new, len(starts)])


def _document_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of one document's pieces.

    Pieces never straddle a multiple of RUN, which is a cut at the same place only by chance; a piece so cut
    has other bytes than an equal text cut elsewhere, and the two are compared by window.
    """
    parts = []
    for low in range(0, max(len(data) - LENGTH + 1, 0), RUN):
        some = data[low:low + RUN + LENGTH - 1]
        anchors, first, n = _anchors(some, np.full(len(some), len(some)))
        parts.append((anchors, first + low, n))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _doc_key(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True)


def _key_of(sha: Column) -> Column:
    """The same key out of the SHA-256 in hexadecimal."""
    return F.conv(F.concat(*[F.substring(sha, 15 - 2 * k, 2) for k in range(8)]), 16, -10).cast("long")


def _piece_keys(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cryptographic hash of each piece's bytes."""
    raw = data.tobytes()
    digests = [hashlib.blake2b(raw[f:f + m + LENGTH - 1], digest_size=8).digest() for f, m in zip(first.tolist(), n.tolist())]
    return np.frombuffer(b"".join(digests), "<u8").astype(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _document_anchors(docs: DataFrame) -> DataFrame:
    """``anchor, doc_key, did, twice``: each document's different anchor hashes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, data, at in chunks(batch.column(1), RUN):
                if high - low == 1:
                    hashes = _document_pieces(data)[0]
                    rows = np.zeros(len(hashes), np.int64)
                else:
                    ends = np.repeat(at[1:], np.diff(at))
                    hashes, first, _ = _anchors(data, ends)
                    rows = np.searchsorted(at, first, "right") - 1
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])][:len(rows)])
                twice = np.diff(np.r_[new, len(rows)]) > 1
                hashes, rows = hashes[new], rows[new]
                raw = data.tobytes()
                keys = np.array([_doc_key(raw[at[k]:at[k + 1]]) for k in range(high - low)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [_signed(hashes), pa.array(keys[rows]), pa.array(ids[low:high][rows]), pa.array(twice)],
                    ["anchor", "doc_key", "did", "twice"])

    return docs.mapInArrow(find, "anchor long, doc_key long, did long, twice boolean")


def _candidates(docs: DataFrame) -> DataFrame:
    """``did, doc_key, anchors, text`` of one row per different text that shares an anchor."""
    found = cut_lineage(_document_anchors(docs), "repeat-anchors")
    shared = (found.groupBy("anchor")
              .agg(F.min("doc_key").alias("a"), F.max("doc_key").alias("b"), F.max("twice").alias("t"))
              .where("a <> b OR t").select("anchor"))
    wanted = (found.join(shared, "anchor", "left_semi")
              .groupBy("anchor", "doc_key").agg(F.min("did").alias("did"))
              .groupBy("doc_key").agg(F.min("did").alias("did"), F.collect_list("anchor").alias("anchors")))
    # An id may stand for many texts, so a text is named by its own key too.
    keyed = docs.withColumn("doc_key", _key_of(F.sha2("text", 256)))
    return cut_lineage(keyed.join(wanted, ["did", "doc_key"]).select("did", "doc_key", "anchors", "text"), "repeat-texts")


def _pieces_of(batch: pa.RecordBatch, text: str, anchors: str):
    """(row, bytes, anchor hash, piece key, first window, windows) for pieces of wanted anchors."""
    texts = batch.column(batch.schema.get_field_index(text))
    lists = batch.column(batch.schema.get_field_index(anchors))
    for row in range(len(texts)):
        data = np.frombuffer((texts[row].as_py() or "").encode(), np.uint8)
        hashes, first, n = _document_pieces(data)
        wanted = np.isin(hashes.view(np.int64), lists[row].values.to_numpy(zero_copy_only=False))
        hashes, first, n = hashes[wanted], first[wanted], n[wanted]
        yield row, data, hashes, _piece_keys(data, first, n), first, n


def _occurrences(texts: DataFrame) -> DataFrame:
    """``anchor, piece, doc_key, did, first, n, twice``: different pieces of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, keys = (batch.column(k).to_pylist() for k in (0, 1))
            for row, _, hashes, whole, first, n in _pieces_of(batch, "text", "anchors"):
                order = np.lexsort((first, whole, hashes))
                hashes, whole, first, n = hashes[order], whole[order], first[order], n[order]
                new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (whole[1:] != whole[:-1])][:len(n)])
                twice = np.diff(np.r_[new, len(n)]) > 1
                m = len(new)
                yield pa.RecordBatch.from_arrays(
                    [_signed(hashes[new]), _signed(whole[new]), pa.array([keys[row]] * m, pa.int64()),
                     pa.array([dids[row]] * m, pa.int64()), pa.array(first[new]), pa.array(n[new]), pa.array(twice)],
                    ["anchor", "piece", "doc_key", "did", "first", "n", "twice"])

    return texts.mapInArrow(find, "anchor long, piece long, doc_key long, did long, first long, n long, twice boolean")


def _rounds(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The eight bytes at each place as a number, and (bytes compared, rank of every suffix by so many bytes)
    of each round of prefix doubling."""
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(len(data), np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k:k + len(data)]
    _, rank = np.unique(key, return_inverse=True)
    out = [(8, rank)]
    while out[-1][0] < length:
        have, rank = out[-1]
        step = min(have, length - have)
        later = np.r_[rank[step:], np.zeros(step, rank.dtype)]
        _, rank = np.unique(rank.astype(np.int64) * (len(data) + 1) + later, return_inverse=True)
        out.append((have + step, rank))
    return key, out


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if there is none.

    Every place points at the one before it; as long as it points at a larger value, all between are larger
    too, and it goes on to where that one points.
    """
    to = np.arange(len(values)) - 1
    going = np.flatnonzero(to >= 0)
    while len(going):
        going = going[values[to[going]] > values[going]]
        to[going] = to[to[going]]
        going = going[to[going] >= 0]
    return to


def longest_previous_factors(data: np.ndarray, starts: np.ndarray,
                             length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of the suffixes at ``starts``, ``length`` bytes at most.

    The longest match of a suffix with one that starts earlier is its match with one of two neighbours in
    suffix order: the nearest before and the nearest after it whose position is smaller.  Likewise for later
    starts and larger positions.  ``starts`` rise, and their order stands for position; each has ``length``
    bytes of its own text after it.  Bytes are compared, in rounds of 8, 16, 32 ... of them.
    """
    key, rounds = _rounds(data, length)
    order = np.lexsort((starts, rounds[-1][1][starts]))
    place = order.astype(np.int64)  # number among ``starts``, by suffix order
    n = len(order)

    def matched(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Bytes that suffixes have in common, by ever fewer bytes at a time."""
        a, b = starts[one].copy(), starts[two].copy()
        got = np.zeros(len(a), np.int64)
        last = len(data) - 1
        for have, rank in reversed(rounds):
            same = rank[np.minimum(a, last)] == rank[np.minimum(b, last)]
            same &= (np.maximum(a, b) <= last) & (got + have <= length)
            got[same] += have
            a[same] += have
            b[same] += have
        differ = key[np.minimum(a, last)] ^ key[np.minimum(b, last)]
        for k in range(1, 8):
            got += differ >> np.uint64(64 - 8 * k) == 0
        return np.minimum(got, length)

    out = []
    for values in (place, n - 1 - place):
        factor = np.zeros(n, np.int64)
        before = _smaller_before(values)
        after = n - 1 - _smaller_before(values[::-1])[::-1]
        for to, found in ((before, before >= 0), (after, after < n)):
            here = np.flatnonzero(found)
            length_here = matched(place[here], place[to[here]])
            factor[place[here]] = np.maximum(factor[place[here]], length_here)
        out.append(factor)
    return out[0], out[1]


def repeated_windows(pieces: list[bytes], counts: list[int],
                     length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the first ``counts[k]`` windows of each piece: which occur again, and which occur earlier.

    The pieces stand in text order.  A window occurs earlier where its longest previous factor has all its
    bytes, and again where the longest previous or the longest next one has.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    starts = np.concatenate([b + np.arange(n) for b, n in zip(begin, counts)])
    previous, following = longest_previous_factors(data, starts, length)
    earlier = previous >= length
    cut = np.cumsum(counts)[:-1]
    return np.split(earlier | (following >= length), cut), np.split(earlier, cut)


def _ranges(flags: np.ndarray) -> list[int]:
    """[low, high) pairs of the runs of true flags, flat."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges.tolist()


_RESULT = "anchor long, piece long, again array<int>, earlier array<int>"


def _compare(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """``_RESULT`` of the pieces whose anchor has several different ones."""
    per_text = pieces.groupBy("did", "doc_key").agg(
        F.collect_list("anchor").alias("want"),
        F.collect_list(F.struct("piece", "first", "many")).alias("which"))
    joined = texts.select("did", "doc_key", "text").join(per_text, ["did", "doc_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(batch.schema.get_field_index("which"))
            dids, keys = (batch.column(k).to_pylist() for k in (0, 1))
            for row, data, hashes, whole, first, n in _pieces_of(batch, "text", "want"):
                wanted = {(w["piece"], w["first"]): w["many"] for w in which[row].as_py()}
                rows = []
                for h, p, f, m in zip(hashes.view(np.int64).tolist(), whole.view(np.int64).tolist(),
                                      first.tolist(), n.tolist()):
                    many = wanted.get((p, f))
                    if many is not None:
                        rows.append((h, p, dids[row], keys[row], f, m, many, data[f:f + m + LENGTH - 1].tobytes()))
                if rows:
                    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        ["anchor", "piece", "did", "doc_key", "first", "n", "many", "bytes"])

    cut_out = cut_lineage(joined.mapInArrow(
        cut, "anchor long, piece long, did long, doc_key long, first long, n long, many boolean, bytes binary"), "repeat-pieces")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[2], r[3]))
            again, earlier = repeated_windows([r[5] for r in held], [r[4] for r in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held]), pa.array([r[1] for r in held]),
                 pa.array([_ranges(a) for a in again], pa.list_(pa.int32())),
                 pa.array([_ranges(e) for e in earlier], pa.list_(pa.int32()))],
                ["anchor", "piece", "again", "earlier"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and size >= ORDER_BYTES and row[0] != held[-1][0]:
                    yield made()
                    held, size = [], 0
                if held and row[:2] == held[-1][:2]:
                    continue  # a repeated row of the input
                held.append(row)
                size += len(row[5])
        if held:
            yield made()

    few = (cut_out.where("NOT many").select("anchor", "piece", "did", "first", "n", "bytes")
           .repartition("anchor").sortWithinPartitions("anchor", "piece").mapInArrow(order, _RESULT))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, p, did, key, first, n, raw in zip(*[c.to_pylist() for c in batch.columns]):
                data, at = np.frombuffer(raw, np.uint8), np.arange(n)
                one = span_hashes(data, at, at + LENGTH)
                two = span_hashes(data ^ np.uint8(0x5A), at, at + LENGTH)
                yield pa.RecordBatch.from_arrays(
                    [_signed(one), _signed(mix(two)), pa.array([h] * n), pa.array([p] * n),
                     pa.array([did] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(first + at),
                     pa.array(at.astype(np.int32))],
                    ["w1", "w2", "anchor", "piece", "did", "doc_key", "place", "nth"])

    crowd = (cut_out.where("many").select("anchor", "piece", "did", "doc_key", "first", "n", "bytes")
             .dropDuplicates(["anchor", "piece"])
             .mapInArrow(windows, "w1 long, w2 long, anchor long, piece long, did long, doc_key long, place long, nth int"))
    # An id may stand for several texts, so the place names the text too.
    place = F.struct("did", "place", "doc_key")
    met = (crowd.groupBy("w1", "w2").agg(F.min(place).alias("low"), F.max(place).alias("high"))
           .where("low <> high"))
    step = F.array(F.col("nth"), F.col("nth") + 1)
    many = (crowd.join(met, ["w1", "w2"])
            .groupBy("anchor", "piece")
            .agg(F.flatten(F.collect_list(step)).alias("again"),
                 F.flatten(F.collect_list(F.when(place != F.col("low"), step))).alias("earlier")))
    return few.unionByName(many)


def find_repeats(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row of ``docs``.

    Removed is each byte covered by a LENGTH-byte string that starts elsewhere too, in any text;
    with ``keep_first``, one that starts earlier (by doc_id, null first, then position).  ``spans``
    holds the maximal removed runs as [low, high) byte pairs; null means that an exact copy of the
    whole text exists.  Null text is empty.  Repeated rows are copies of each other, so without
    ``keep_first`` a text of LENGTH bytes or more goes wholly; with it, rows that repeat an id and
    its text are one document, all kept or cut alike.  Shorter texts keep all bytes.  Other columns
    are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = cut_lineage(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                                    F.sha2(F.col("text"), 256).alias("sha")), "repeat-sizes")
    keyed = rows.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), "text").where(
        F.octet_length("text") >= LENGTH)
    texts = _candidates(keyed)
    seen = cut_lineage(_occurrences(texts), "repeat-occurrences")
    kinds = seen.groupBy("anchor", "piece").agg(
        F.min(F.struct("did", "first", "doc_key")).alias("at"), F.max("n").alias("n"),
        ((F.min("doc_key") != F.max("doc_key")) | F.max("twice")).alias("shared"))
    crowds = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    kinds = cut_lineage(kinds.join(crowds, "anchor"), "repeat-kinds")
    several = kinds.where("kinds > 1").select(
        "anchor", "piece", "at.did", "at.first", "at.doc_key", (F.col("kinds") > ORDER_PIECES).alias("many"))
    compared = _compare(texts, several)
    found = kinds.join(compared, ["anchor", "piece"], "left").select(
        "anchor", "piece", F.col("at").alias("home"), "shared",
        F.when(F.col("shared"), F.array(F.lit(0), F.col("n").cast("int"))).otherwise(F.col("again")).alias("again"),
        "earlier", "n").where("size(again) > 0")
    marks = (seen.select("anchor", "piece", "did", "doc_key").join(found, ["anchor", "piece"])
             .groupBy("did", "doc_key").agg(
                 F.collect_list("anchor").alias("want"),
                 F.collect_list(F.struct("piece", "again", "earlier", "n",
                                         F.struct("home.did", "home.doc_key", "home.first").alias("home"))).alias("which")))
    joined = texts.select("did", "doc_key", "text").join(marks, ["did", "doc_key"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, keys = (batch.column(k).to_pylist() for k in (0, 1))
            which = batch.column(batch.schema.get_field_index("which"))
            for row, data, _, whole, first, n in _pieces_of(batch, "text", "want"):
                wanted = {w["piece"]: w for w in which[row].as_py()}
                edge = np.zeros(len(data) + 1, np.int32)
                for p, f in zip(whole.view(np.int64).tolist(), first.tolist()):
                    w = wanted.get(p)
                    if w is None:
                        continue
                    flat = w["again"]
                    if keep_first:
                        home = w["home"]
                        at_home = (home["did"], home["doc_key"], home["first"]) == (dids[row], keys[row], f)
                        flat = (w["earlier"] or []) if at_home else [0, w["n"]] if w["earlier"] is None else flat
                    lows, highs = np.array(flat[::2], int), np.array(flat[1::2], int)
                    np.add.at(edge, f + lows, 1)
                    np.add.at(edge, f + highs - 1 + LENGTH, -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = _ranges(gone)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[row]]), pa.array([dids[row]]), pa.array([int(gone.sum())]),
                     pa.array([len(spans) // 2]), pa.array([hashlib.sha256(data[~gone].tobytes()).hexdigest()]),
                     pa.array([spans], pa.list_(pa.int32()))],
                    ["doc_key", "did", "n_removed", "n_spans", "kept", "spans"])

    cut = joined.mapInArrow(remove, "doc_key long, did long, n_removed long, n_spans long, kept string, spans array<int>")
    return _assemble(sized, cut, keep_first)


def _assemble(sized: DataFrame, cut: DataFrame, keep_first: bool) -> DataFrame:
    """Results of all rows from those of the different texts."""
    key = _key_of(F.col("sha"))
    copies = sized.groupBy("sha").agg(F.count("*").alias("copies"),
                                      F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("home"))
    each = cut.dropDuplicates(["doc_key"]).drop("did")
    # One row per different text here, before the rows join it.
    known = (copies.withColumn("doc_key", key).join(each, "doc_key", "left").drop("doc_key"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    if keep_first:
        whole = whole & (F.coalesce("doc_id", F.lit(_NO_ID)) != F.col("home"))
    none = F.array().cast("array<int>")
    return sized.join(known, "sha").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(~whole, F.coalesce("spans", none)).alias("spans"))


def repeats_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    Beside them ``n_kept``, the bytes that stay, and ``repeats``, whether any are removed.  Nulls, empty, long,
    equal and repeated rows and other columns are as for :func:`find_repeats`; an empty table has no rows.
    """
    found = find_repeats(docs).drop("spans")
    return (found.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))
            .withColumn("repeats", F.col("n_removed") > 0))
