"""Token ids of documents in Huffman-coded block files.

A dataset of token ids is a folder with two Parquet tables: ``codebook`` (id, count, bits) and
``blocks`` (part, block, n_docs, n_ids, data).  Parts are ranges of doc_id, blocks run on within a
part, and ``data`` is a block of :mod:`huffman` that decodes alone, given the codebook.  Spark's
writer commits each file whole, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanlake.session import run_dir

from . import huffman
from .bytetext import CHUNK_BYTES, chunks, column_bytes, worker_cache

END_ID = 2
#: Pieces kept per Python worker with their ids; longer ones are not kept.
CACHED_PIECES, CACHED_CHARS = 500_000, 40
#: Words that one call of the tokenizer gets.
LINE = 256
_MARK = np.zeros(256, bool)
_MARK[list(string.punctuation.encode())] = True
CHARS_AT_ONCE = 4_000_000
BLOCK_BYTES = 1 << 20
DOCS_PER_PART, MOST_PARTS = 5_000, 50_000


def _word_tokenizers(tokenizer):
    """The same vocabulary for lines of words that folding leaves as they are: cut at spaces, nothing folded.
    One for words of a-z, which are their own bytes' characters, and one for all words."""
    from tokenizers import Tokenizer, pre_tokenizers as pre

    small, plain = Tokenizer(tokenizer.model), Tokenizer(tokenizer.model)
    small.pre_tokenizer = pre.WhitespaceSplit()
    plain.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
    return small, plain


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache("tokenizers")
    if getattr(cache, "path", None) != path:
        from tokenizers import Tokenizer

        cache.path = path
        cache.pieces, cache.ids, cache.n = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        cache.letters, cache.others, cache.stable = set(), set(), set(string.ascii_lowercase)
        cache.tokenizer = Tokenizer.from_file(path)
        cache.small, cache.plain = _word_tokenizers(cache.tokenizer)
    return cache.tokenizer, cache


def _one_letter(tokenizer, cache, char: str) -> bool:
    """Whether the tokenizer's folding and cutting leave ``char`` within one word of letters; one that folding
    leaves as it is becomes known as such."""
    folded = tokenizer.normalizer.normalize_str(f"a{char}a")
    if len(tokenizer.pre_tokenizer.pre_tokenize_str(folded)) != 1:
        return False
    if folded == f"a{char}a":
        cache.stable.add(char)
    return True


def _is_word(piece: str, tokenizer, cache) -> bool:
    """Whether the tokenizer takes ``piece`` as one word of letters, also beside ASCII marks.

    Some letters fold to several characters of which one is no letter, and the tokenizer's letters
    need not be Python's: each character outside ASCII is asked for once per worker.
    """
    if not piece.isalpha():
        return False
    if piece.isascii() or cache.letters.issuperset(piece):
        return True
    fresh = set(piece) - cache.letters
    if not cache.others.isdisjoint(fresh):
        return False
    good = {c for c in fresh if c.isascii() or _one_letter(tokenizer, cache, c)}
    cache.letters |= good
    cache.others |= fresh - good
    return good == fresh


def _of_a_z(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which spans are not empty and all of the letters a-z."""
    other = np.r_[0, np.cumsum((data < 97) | (data > 122))]
    return (ends > starts) & (other[ends] == other[starts])


def _strung(ids: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``n`` ids from ``starts`` on, in a row, and the offsets of the runs in it."""
    at = np.r_[0, np.cumsum(n)]
    return ids[np.repeat(starts - at[:-1], n) + np.arange(at[-1])], at


def _encode_pieces(tokenizer, cache, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces in a row, and the number of ids of each, by the tokenizer.

    Pieces that are one word each go in one line, whose word numbers tell them apart; a line
    with another number of words than pieces, and any other piece, is encoded piece by piece.
    Words that folding leaves as they are go to tokenizers that do not fold.
    """
    data, at = column_bytes(pieces)
    easy = _of_a_z(data, at[:-1], at[1:])
    small, odd = np.flatnonzero(easy), np.flatnonzero(~easy)
    texts = pieces.to_pylist()
    words, plain, rest = [], [], []
    for k in odd.tolist():
        piece = texts[k]
        if not _is_word(piece, tokenizer, cache):
            rest.append(k)
        elif cache.stable.issuperset(piece) and (piece.isascii() or unicodedata.is_normalized("NFC", piece)):
            plain.append(k)
        else:
            words.append(k)
    order, n, ids = [], [], []
    for coder, some in ((cache.small, small.tolist()), (cache.plain, plain), (tokenizer, words)):
        lines = [some[k:k + LINE] for k in range(0, len(some), LINE)]
        for low in range(0, len(lines), 100):
            here = lines[low:low + 100]
            coded = coder.encode_batch([" ".join([texts[k] for k in x]) for x in here], add_special_tokens=False)
            for line, got in zip(here, coded):
                numbers = np.array(got.word_ids, np.int64)
                if len(numbers) == 0 or numbers[-1] + 1 != len(line):
                    rest += line
                    continue
                order += line
                n.append(np.bincount(numbers, minlength=len(line)))
                ids.append(np.array(got.ids, "<u4"))
    for low in range(0, len(rest), 20_000):
        some = rest[low:low + 20_000]
        coded = [got.ids for got in tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)]
        order += some
        n.append(np.array([len(c) for c in coded], np.int64))
        ids.append(np.array([i for c in coded for i in c], "<u4"))
    if not order:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    n, back = np.concatenate(n), np.argsort(np.array(order))
    out, _ = _strung(np.concatenate(ids), (np.cumsum(n) - n)[back], n[back])
    return out, n[back]


def _known_pieces(path: str, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and where among them each piece's begin and how many they are, from this worker's cache or the
    tokenizer.  The pieces are all different."""
    tokenizer, cache = _tokenizer(path)
    found = pc.index_in(pieces, value_set=cache.pieces)
    fresh = pieces.filter(pc.is_null(found))
    ids, n = _encode_pieces(tokenizer, cache, fresh)
    place = found.fill_null(-1).to_numpy().astype(np.int64)
    place[place < 0] = len(cache.pieces) + np.arange(len(fresh))
    every = pa.concat_arrays([cache.pieces, fresh])
    ids, n = np.r_[cache.ids, ids], np.r_[cache.n, n]
    starts = np.cumsum(n) - n
    # Once they are too many, only what the last texts had stays.
    keep = place if len(every) > CACHED_PIECES else np.arange(len(every))
    short = pc.less_equal(pc.utf8_length(every), CACHED_CHARS).to_numpy(zero_copy_only=False)
    keep = keep[short[keep]][:CACHED_PIECES]
    if len(keep) == len(every):
        cache.pieces, cache.ids, cache.n = every, ids, n
    else:
        cache.pieces, cache.n = every.take(pa.array(keep)), n[keep]
        cache.ids, _ = _strung(ids, starts[keep], n[keep])
    return ids, starts[place], n[place]


def _cut_marks(path: str, pieces: pa.StringArray) -> pa.StringArray:
    """Two parts of each piece, one after the other: a word and the ASCII marks that end the piece, which are two
    words to the tokenizer; or the whole piece and nothing."""
    tokenizer, cache = _tokenizer(path)
    data, at = column_bytes(pieces)
    starts, ends = at[:-1], at[1:]
    last = np.r_[-1, np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))]
    cut = np.maximum(last[ends] + 1, starts)
    easy = _of_a_z(data, starts, cut)
    for k in np.flatnonzero((starts < cut) & (cut < ends) & ~easy).tolist():
        easy[k] = _is_word(data[starts[k]:cut[k]].tobytes().decode(), tokenizer, cache)
    cut = np.where(easy, cut, ends)
    offsets = np.r_[np.c_[starts, cut].ravel(), at[-1:]].astype(np.int32)
    return pa.StringArray.from_buffers(2 * len(pieces), pa.py_buffer(offsets), pa.py_buffer(data))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Document ids and texts of as many rows as have CHARS_AT_ONCE characters."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars >= CHARS_AT_ONCE:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _id_runs(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, ids and offsets of runs of stored documents."""
    size = np.dtype(kind).itemsize
    for batch in batches:
        for low, high, data, at in chunks(batch.column(1), 4 * CHUNK_BYTES):
            yield batch.column(0).slice(low, high - low).to_pylist(), np.frombuffer(data.tobytes(), kind), at // size


def _folded(text: str) -> str:
    """The text in lower case where that is what the vocabulary's own folding does, lines joined by spaces.

    The vocabulary composes characters first and folds case afterwards, letter by letter: texts
    that folding would compose anew, or fold by context, keep their case.
    """
    if text.isascii():
        text = text.lower()
    elif not ("\u03a3" in text or "\u0130" in text) and unicodedata.is_normalized("NFC", text):
        folded = text.lower()
        if unicodedata.is_normalized("NFC", folded):
            text = folded
    return text.replace("\n", " ")


def _text_ids(path: str, texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the n + 1 offsets of the texts among them.

    The vocabulary folds case and cuts every text at white space before anything else and drops
    the white space, so a text's ids are those of its pieces between spaces; each piece meets the
    tokenizer once while a worker keeps it.  A tokenizer without that property is refused.
    """
    split = pc.split_pattern(pa.array([_folded(t) for t in texts], pa.string()), " ")
    pieces = split.values.dictionary_encode()
    parts = _cut_marks(path, pieces.dictionary).dictionary_encode()
    ids, starts, n = _known_pieces(path, parts.dictionary)
    part = parts.indices.to_numpy()
    ids, at = _strung(ids.astype(kind), starts[part], n[part])
    at = at[::2]  # of the pieces: two parts each
    piece = pieces.indices.to_numpy()
    ids, at = _strung(ids, at[piece], np.diff(at)[piece])
    return ids, at[split.offsets.to_numpy()]


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids (little-endian 32-bit) of each text."""
    ids, at = _text_ids(path, texts, "<u4")
    return [ids[x:y].tobytes() for x, y in zip(at, at[1:])]


def _check_tokenizer(path: str) -> int:
    """Number of ids; refuses a vocabulary whose ids depend on white space."""
    tokenizer, _ = _tokenizer(path)
    both = tokenizer.encode("Aa b.\n c", add_special_tokens=False).ids
    apart = [i for w in ("aa", "b", ".", "c") for i in tokenizer.encode(w, add_special_tokens=False).ids]
    if both != apart:
        raise ValueError("this tokenizer keeps white space; its texts cannot be encoded by pieces")
    return tokenizer.get_vocab_size()


def encode_documents(docs: DataFrame, path: str, n_ids: int, end_id: int | None) -> DataFrame:
    """``doc_id, ids`` of every document, ids as little-endian numbers of 16 or 32 bits."""
    kind = _id_type(n_ids)
    tail = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(kind).itemsize
        for doc_ids, texts in _groups(batches):
            ids, at = _text_ids(path, texts, kind)
            raw, at = ids.tobytes(), (at * size).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()),
                 pa.array([raw[x:y] + tail for x, y in zip(at, at[1:])], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def _id_type(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def count_ids(encoded: DataFrame, n_ids: int) -> np.ndarray:
    """Occurrences of each id over all documents: at most ``n_ids`` sums reach the driver."""
    kind = _id_type(n_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            data, _ = column_bytes(batch.column(0))
            total += np.bincount(np.frombuffer(data.tobytes(), kind), minlength=n_ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    sums = (encoded.select("ids").mapInArrow(count, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(n_ids, np.int64)
    for row in sums:
        counts[row.id] = row.n
    return counts


def _part_bounds(docs: DataFrame) -> list[int]:
    """Least ids of parts of about DOCS_PER_PART documents."""
    n = docs.count()
    parts = min(MOST_PARTS, n // DOCS_PER_PART + 1)
    steps = [k / parts for k in range(1, parts)]
    if not steps:
        return []
    got = docs.agg(F.percentile_approx("doc_id", steps, 20 * parts).alias("b")).first().b
    return sorted(set(got or []))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = END_ID,
                      max_bits: int = huffman.MAX_BITS) -> None:
    """Encode the whole text of every document and write the dataset to ``folder``.

    The ids are stored once in the shared folder, then read twice: for the global counts that give
    the code, and for the coded documents, of which only the bits are shuffled into parts by ranges
    of doc_id and sorted.  Null text is
    empty, so it has the end id alone; null ids come first; repeated ids stand in order of their
    length and bits, so reruns agree.  An empty table gives an empty dataset.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    n_ids = _check_tokenizer(tokenizer_path)
    kind, stored = _id_type(n_ids), run_dir(spark, "token-ids")
    encoded = encode_documents(rows, tokenizer_path, n_ids, end_id)
    encoded.write.option("compression", "zstd").parquet(stored)
    encoded = spark.read.schema(encoded.schema).parquet(stored)
    counts = count_ids(encoded, n_ids)
    lengths = huffman.code_lengths(counts, max_bits)
    used = np.flatnonzero(lengths)
    book = [(int(i), int(counts[i]), int(lengths[i])) for i in used]
    spark.createDataFrame(book, "id int, count long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    codes = huffman.canonical_codes(lengths)
    bounds = np.array(_part_bounds(rows), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, at in _id_runs(batches, kind):
            n = np.diff(at)
            data, at, marks = huffman.pack(ids, n, lengths, codes)
            mark_at = np.r_[0, np.cumsum((n + huffman.INTERVAL - 1) // huffman.INTERVAL)]
            part = np.searchsorted(bounds, [-(1 << 62) if d is None else d for d in doc_ids], "right")
            raw, raw_marks = data.tobytes(), marks.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(part.astype(np.int32)), pa.array(doc_ids, pa.int64()), pa.array(n),
                pa.array([raw[at[k]:at[k + 1]] for k in range(len(n))], pa.binary()),
                pa.array([raw_marks[4 * mark_at[k]:4 * mark_at[k + 1]] for k in range(len(n))], pa.binary()),
            ], ["part", "doc_id", "n", "bits", "marks"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = None, 0, [], 0

        def made() -> pa.RecordBatch:
            n = np.array([h[1] for h in held], np.int64)
            data = huffman.write_block([h[0] for h in held], n, [h[2] for h in held],
                                       [np.frombuffer(h[3], "<u4").astype(np.int64) for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(held)], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                 pa.array([data], pa.binary())], ["part", "block", "n_docs", "n_ids", "data"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for own, doc_id, n, bits, marks in zip(*columns):
                if held and (own != part or size >= BLOCK_BYTES):
                    yield made()
                    number, held, size = (number + 1 if own == part else 0), [], 0
                part = own
                held.append((doc_id, n, bits, marks))
                size += len(bits) + len(marks) + 17
        if held:
            yield made()

    (encoded.mapInArrow(encode, "part int, doc_id long, n long, bits binary, marks binary")
     .repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "n", "bits")
     .mapInArrow(blocks, "part int, block int, n_docs long, n_ids long, data binary")
     .write.option("compression", "none").parquet(f"{folder}/blocks"))


def _lengths(spark: SparkSession, folder: str) -> np.ndarray:
    book = spark.read.parquet(f"{folder}/codebook").collect()  # one row per id of the vocabulary
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.uint8)
    for row in book:
        lengths[row.id] = row.bits
    return lengths


def _read(spark: SparkSession, folder: str, schema: str, rows_of) -> DataFrame:
    """Decode each block with its place in the whole: ``rows_of(first, doc_ids, counts, ids)``."""
    lengths = _lengths(spark, folder)
    stored = spark.read.parquet(f"{folder}/blocks")
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per range of ids
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = (stored.select("part", "block", "n_ids")
             .withColumn("own", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
             .join(parts, "part").select("part", "block", (F.col("before") + F.col("own")).alias("first")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.decode_table(lengths)
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield rows_of(first, *huffman.read_block(data.as_py(), table))

    return (stored.join(heads, ["part", "block"]).select("first", "data").mapInArrow(decode, schema))


def read_token_index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""

    def rows_of(first, doc_ids, counts, ids) -> pa.RecordBatch:
        raw, at = ids.astype("<u4").tobytes(), np.r_[0, np.cumsum(counts)]
        sums = [zlib.crc32(raw[4 * at[k]:4 * at[k + 1]]) for k in range(len(counts))]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(first + at[:-1]), pa.array(counts),
             pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", rows_of)


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, decoded from the files."""

    def rows_of(first, doc_ids, counts, ids) -> pa.RecordBatch:
        at = np.r_[0, np.cumsum(counts)]
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(first + at[:-1]), lists], ["doc_id", "start", "ids"])

    return _read(spark, folder, "doc_id long, start long, ids array<int>", rows_of)


def token_file_index(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read their index back."""
    folder = run_dir(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, folder)
    return read_token_index(docs.sparkSession, folder)
