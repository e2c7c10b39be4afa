"""Dialogues rendered once from the perspective of each participant.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: This role sets the scene and takes no part.
SYSTEM = "system"
#: Turns per bucket of the two-level running sums.
BUCKET = 256
UNKNOWN = "unknown"


def _clean(text: Column) -> Column:
    """Text that cannot be taken for a header or an end mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame) -> DataFrame:
    """Segments ``conv_id, perspective, place, turn, speaker, rendered_role, start, end, mask_start,
    mask_end, segment``: the dialogue of every conversation once per participant.

    Participants are the distinct roles of a conversation other than system.  From the perspective
    of one, its turns are the assistant's, all others are users named by their role; joined by
    ``place``, the segments are the dialogue, in which a segment covers characters [start, end) and
    is trained on in [mask_start, mask_end), its text and end mark; both are null where another
    speaks.  Turns stand by turn number (null first), then role, then text; equal rows stay as
    several turns.  A null role is a user named unknown and no participant, a null text is empty, a
    null conv_id is one conversation.  A conversation of system turns only gives no rows.

    No conversation is collected: offsets are running sums within buckets of turn numbers plus
    running sums over the buckets, so a conversation with a large part of all rows is spread.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    people = (rows.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM))
              .select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct())
    name = _clean(F.coalesce("role", F.lit(UNKNOWN)))
    body = F.concat(_clean(F.col("text")), F.lit("<|end|>\n"))
    own = F.col("role").eqNullSafe(F.col("perspective"))
    role = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user")
    head = F.concat(F.lit("<|"), F.col("rendered_role"),
                    F.when(F.col("rendered_role") == "user", F.concat(F.lit(":"), F.col("speaker")))
                    .otherwise(""), F.lit("|>\n"))
    said = (rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
            .withColumn("speaker", name).withColumn("rendered_role", role).withColumn("_head", head)
            .withColumn("segment", F.concat("_head", body))
            .withColumn("_length", F.length("segment").cast("long"))
            .withColumn("_bucket", F.floor(F.col("turn") / BUCKET)))
    group = ["conv_id", "perspective"]
    sums = said.groupBy(*group, "_bucket").agg(F.sum("_length").alias("_sum"), F.count("*").alias("_n"))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_bucket").alias("_b"),
                         F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"),
                         F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_place"))
    inner = (Window.partitionBy(*group, "_bucket")
             .orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = (said.withColumn("_own", F.coalesce(F.sum("_length").over(inner), F.lit(0)))
              .withColumn("_nth", F.coalesce(F.count("*").over(inner), F.lit(0)))
              .join(before, F.col("conv_id").eqNullSafe(F.col("_conv_id"))
                    & (F.col("perspective") == F.col("_perspective"))
                    & F.col("_bucket").eqNullSafe(F.col("_b"))))
    start = F.col("_before") + F.col("_own")
    trained = F.col("rendered_role") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("_place") + F.col("_nth")).alias("place"), "turn", "speaker",
        "rendered_role", start.alias("start"), (start + F.col("_length")).alias("end"),
        F.when(trained, start + F.length("_head")).alias("mask_start"),
        F.when(trained, start + F.col("_length") - 1).alias("mask_end"), "segment")


PERSPECTIVES_SQL = """
WITH people AS (SELECT DISTINCT conv_id AS conv, role AS perspective FROM conversations WHERE role <> 'system'),
said AS (
  SELECT c.conv_id, p.perspective, c.turn, c.role, c.text, replace(coalesce(c.role, 'unknown'), '<|', '< |') AS speaker,
    CASE WHEN c.role = p.perspective THEN 'assistant' WHEN c.role = 'system' THEN 'system' ELSE 'user' END AS rendered_role
  FROM conversations c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv),
headed AS (
  SELECT *, '<|' || rendered_role || CASE WHEN rendered_role = 'user' THEN ':' || speaker ELSE '' END || '|>' || chr(10) AS head
  FROM said),
segments AS (
  SELECT *, head || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, length(segment) AS size,
    coalesce(sum(length(segment)) OVER w, 0) AS start, count(*) OVER w AS place
  FROM segments WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, CAST(place AS BIGINT) AS place, turn, speaker, rendered_role, CAST(start AS BIGINT) AS start,
  CAST(start + size AS BIGINT) AS "end",
  CAST(CASE WHEN rendered_role = 'assistant' THEN start + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN rendered_role = 'assistant' THEN start + size - 1 END AS BIGINT) AS mask_end, segment
FROM placed
"""
