"""Mix sources to target weights by repeating documents.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanlake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix per word of the input, and the most copies a source may give on average.
SHARE, MOST = 1.5, 2.0
SEED = "mix"


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``source, source_size, target, rate``: one row per source, null included.

    The targets share ``share`` times all words by weight, none above ``most`` times its source's
    words; what a full source cannot take is shared anew.  With sources in order of size per weight
    the full ones come first, and the level of the rest is the largest of (target left) / (weight
    left) over all places in that order.  The windows see one row per source, never documents.
    A source without words gets target and rate zero.
    """
    totals = cut_lineage(docs.groupBy("source").agg(F.sum(text_size(F.col("text"))).alias("source_size")),
                         "mix-sources")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("_weight", weight.cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(F.col("source_size") * most)
                        .over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    goal = F.sum("source_size").over(whole) * share
    levels = ranked.withColumn("_level", (goal - before) / left)
    target = F.least(F.col("source_size") * most, F.col("_weight") * F.max("_level").over(whole))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (levels.withColumn("target", target).withColumn("rate", rate)
            .select("source", "source_size", "target", "rate"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) fixed by seed and document id: 48 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def with_copies(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """``row, size, source_size, target, copies`` of each document; ``row`` holds its own columns.

    ``rates`` is a stored table of one row per source, so Spark sees its size when it plans the
    join and no document needs to move.  Rows with the same id draw the same number.  Columns of any name
    are fine: they stay inside ``row``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = F.floor("rate")
    extra = (draw(F.col("row.doc_id"), seed) < F.col("rate") - whole).cast("long")
    return (rows.join(rates, F.col("row.source").eqNullSafe(F.col("source")), "left")
            .select("row", text_size(F.col("row.text")).alias("size"), "source_size", "target",
                    (whole + extra).alias("copies")))


def mix_table(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document.

    A document is taken floor(rate) times, and once more with the rate's fraction as probability.
    Null text has size 0; null ids share one draw; repeated rows count each; an empty table gives
    no rows.  Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "source")
    rates = cut_lineage(source_targets(rows), "mix-rates")
    return with_copies(rows, rates, seed).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns, whatever their names."""
    rates = cut_lineage(source_targets(docs.select("source", "text")), "mix-rates")
    counted = with_copies(docs, rates, seed).where("copies > 0")
    return counted.select("row", F.explode(F.expr("sequence(1, int(copies))")).alias("copy")).select("row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight
  FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(source_size * 2.0::DOUBLE) OVER (
      ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
rates AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    CAST(CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(s.doc_id AS VARCHAR), ''))), 1, 12)) AS BIGINT) AS DOUBLE)
      / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""
