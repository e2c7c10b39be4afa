"""Language shares of documents by mixture inference over byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .bytetext import chunks

#: n-grams of this many bytes, hashed into this many cells.
GRAM, CELLS = 4, 1 << 17
SMOOTHING = 0.5
#: EM ends after so many rounds or when no share moves by more.
ROUNDS, MOVE = 30, 1e-3
#: A further language must raise the log likelihood by this much per natural log of n-grams.
PENALTY = 6.0
UNKNOWN = "und"

_ADDED_FIELDS = [
    T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()),
    T.StructField("lang_set", T.ArrayType(T.StringType())), T.StructField("lang_gain", T.DoubleType())]
_ADDED = [f.name for f in _ADDED_FIELDS]


@dataclass(frozen=True)
class LanguageModel:
    """``cells``: probability of each n-gram cell (rows) in each language (columns)."""

    languages: tuple[str, ...]
    cells: np.ndarray


def held_out(doc_id: Column, remainder: int, divisor: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor == remainder


def _fold(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case; other ASCII as one space; bytes of other letters as they are."""
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), np.where(letter, data, np.uint8(32)))


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each n-gram that does not begin in a gap, and the offsets of the rows' n-grams."""
    folded = _fold(data)
    n = len(folded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = code << np.uint32(8) | folded[k:n + k]
    inside = folded[:n] != 32
    for cut in at[1:-1]:  # n-grams that run into the next row
        inside[max(0, cut - GRAM + 1):cut] = False
    cell = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(math.log2(CELLS)))
    kept = np.flatnonzero(inside)
    return cell[kept].astype(np.int64), np.searchsorted(kept, at)


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from all rows with a language: hashed n-gram counts, summed in tasks before the shuffle.

    What reaches the driver is one sum per language and cell.  Null text adds nothing; a table
    without languages gives a model that knows none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column(1).to_pylist()
            for low, high, data, at in chunks(batch.column(0)):
                cells, gram_at = _grams(data, at)
                own = languages[low:high]
                for language in set(own):
                    rows = [cells[gram_at[k]:gram_at[k + 1]] for k, x in enumerate(own) if x == language]
                    sums = total.setdefault(language, np.zeros(CELLS, np.int64))
                    sums += np.bincount(np.concatenate(rows), minlength=CELLS)
        for language, sums in total.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used)), pa.array(used.astype(np.int32)), pa.array(sums[used])],
                ["lang", "cell", "n"])

    rows = (docs.where(F.col("lang").isNotNull()).select("text", "lang")
            .mapInArrow(count, "lang string, cell int, n long")
            .groupBy("lang", "cell").agg(F.sum("n").alias("n"))
            .groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).collect())
    rows.sort(key=lambda r: r.lang)
    cells = np.full((CELLS, len(rows)), SMOOTHING)
    for k, row in enumerate(rows):
        for cell, n in row.cells:
            cells[cell, k] += n
    return LanguageModel(tuple(r.lang for r in rows), (cells / cells.sum(0)).astype(np.float32))


def _shares(prob: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, float]:
    """EM for the shares of the columns of ``prob``, and the log likelihood reached."""
    n = float(len(prob) if weight is None else weight.sum())
    share = np.full(prob.shape[1], 1 / prob.shape[1], np.float32)
    for _ in range(ROUNDS):
        seen = prob @ share
        part = 1 / seen if weight is None else weight / seen
        new = share * (part @ prob) / n
        moved = float(np.abs(new - share).max())
        share = new
        if moved < MOVE:
            break
    logs = np.log(prob @ share)
    return share, float(logs.sum() if weight is None else (logs * weight).sum())


def infer(prob: np.ndarray, weight: np.ndarray | None = None) -> tuple[dict[int, float], float]:
    """Languages (columns) of one document with their shares, and the likelihood per n-gram.

    EM over all languages ranks them; languages are then added from the largest share on for as
    long as each raises the log likelihood by more than the penalty.
    """
    n = float(len(prob) if weight is None else weight.sum())
    price = PENALTY * math.log(n + 1)
    full, most = _shares(prob, weight)
    order = np.argsort(-full, kind="stable")
    chosen = [int(order[0])]
    logs = np.log(prob[:, chosen[0]])
    best = float(logs.sum() if weight is None else (logs * weight).sum())
    shares = {chosen[0]: 1.0}
    for k in order[1:]:
        if most - best <= price:
            break
        share, reached = _shares(np.ascontiguousarray(prob[:, [*chosen, int(k)]]), weight)
        if reached - best <= price:
            break
        chosen.append(int(k))
        best, shares = reached, dict(zip(chosen, map(float, share)))
    return shares, best / n


def _labeller(docs: DataFrame, model: LanguageModel):
    """Function of (texts, bytes, offsets) that gives (language, share, languages, gain) of each."""
    languages, known = model.languages, len(model.languages)
    sent = docs.sparkSession.sparkContext.broadcast(model.cells)  # cells x languages, no more

    def rows_of(text: str | None, grams: np.ndarray):
        if not known or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, [], None
        if not len(grams):
            grams = _grams(np.frombuffer((text + " " * GRAM).encode(), np.uint8),
                           np.array([0, len(text.encode()) + GRAM]))[0]
        if not len(grams):  # letters that fold to gaps only cannot occur; kept for safety
            return languages[0], 1.0 / known, [languages[0]], 0.0
        weight = None
        if len(grams) > CELLS:  # a very long text: each cell once, weighted
            sums = np.bincount(grams, minlength=CELLS)
            grams = np.flatnonzero(sums)
            weight = sums[grams].astype(np.float32)
        shares, fit_ = infer(sent.value[grams], weight)
        top = max(shares, key=lambda k: (shares[k], -k))
        return (languages[top], min(1.0, shares[top]), [languages[k] for k in sorted(shares)],
                fit_ + math.log(CELLS))

    def label_rows(texts: list, data: np.ndarray, at: np.ndarray) -> list[tuple]:
        grams, gram_at = _grams(data, at)
        return [rows_of(text, grams[gram_at[k]:gram_at[k + 1]]) for k, text in enumerate(texts)]

    return label_rows


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` in which a language was found.

    Rejected are texts without a letter, null ones, and those under whose best set of languages the
    n-grams are no likelier than under a uniform choice (noise).  All columns stay as they are.
    """
    label_rows = _labeller(docs, model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, good = batch.column(batch.schema.get_field_index("text")), []
            for low, high, data, at in chunks(texts):
                good += [name != UNKNOWN and gain > 0 for name, _, _, gain
                         in label_rows(texts.slice(low, high - low).to_pylist(), data, at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, lang_score, lang_set, lang_gain``.

    ``lang_pred`` has the largest share, ``lang_score`` is that share, ``lang_set`` the selected
    languages, and ``lang_gain`` the log likelihood per n-gram above that of a uniform choice of
    cells.  Null text, text without a letter, or a model that knows no language give ``und`` with
    score 0 and gain null.  A text with letters but without an n-gram (fewer bytes than one) takes
    the language under which its padded form is likeliest.
    """
    label_rows = _labeller(docs, model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = []
            for low, high, data, at in chunks(texts):
                found += label_rows(texts.slice(low, high - low).to_pylist(), data, at)
            names, scores, sets, gains = zip(*found) if found else ((), (), (), ())
            own = [c for c in batch.columns] + [
                pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                pa.array(sets, pa.list_(pa.string())), pa.array(gains, pa.float64())]
            yield pa.RecordBatch.from_arrays(own, [*batch.schema.names, *_ADDED])

    rows = docs.drop(*[c for c in docs.columns if c in _ADDED])
    return rows.mapInArrow(label, T.StructType([*rows.schema.fields, *_ADDED_FIELDS]))




def language_table(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, lang_set``: learned from the rows not held out.

    Nulls, texts without letters, texts of any length, ties and repeated rows are as for :func:`predict`; rows
    of null language teach nothing; other columns, whatever their names, are not read; an empty table gives no
    rows.  The model is half a MB for each language.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 1, 3).alias("held_out"))
    model = fit(rows.where("NOT held_out"))
    return predict(rows.drop("lang"), model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_set")
