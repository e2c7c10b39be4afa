"""Profiles as stacks and flame trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def symbolize(samples: DataFrame, locations: DataFrame, functions: DataFrame,
              strings: DataFrame, root_first: bool = True) -> DataFrame:
    """Named stacks (``a;b;c``) with their summed value and sample count.

    Inputs: samples (location_ids array leaf first, value), locations (location_id, line_no,
    function_id), functions (function_id, name_idx), strings (idx, text).  Unresolved
    locations and empty names are skipped; samples without any frame drop out.
    ``root_first=False`` keeps the stored order.

    Identical stacks are merged before any name is looked up, which also takes the weight off a
    location that nearly every sample holds.  Reassembly groups by stack: its size is the
    stack depth, which the profiler bounds.
    """
    stacks = (samples.groupBy("location_ids")
              .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("samples"))
              .withColumn("_stack", F.md5(F.array_join(F.col("location_ids").cast(
                  "array<string>"), ","))))
    names = (
        locations.join(functions, "function_id")
        .join(strings.withColumnRenamed("idx", "name_idx"), "name_idx")
        .where(F.col("text") != "")
        .select("location_id", "line_no", "text"))
    frames = stacks.select("_stack", "value", "samples",
                           F.posexplode("location_ids").alias("pos", "location_id"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line_no", "text")),
                           asc=not root_first)
    return (
        frames.join(names, "location_id")
        .groupBy("_stack")
        .agg(F.max("value").alias("value"), F.max("samples").alias("samples"),
             ordered.alias("_frames"))
        .groupBy(F.array_join("_frames.text", ";").alias("stack"))
        .agg(F.sum("value").alias("value"), F.sum("samples").alias("samples"))
    )


def folded_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """Folded text lines ``a;b;c 42`` as (stack, value)."""
    trimmed = F.trim(F.col(text))
    return lines.select(
        F.trim(F.regexp_replace(trimmed, "\\s+\\S+$", "")).alias("stack"),
        F.regexp_extract(trimmed, "(\\S+)$", 1).try_cast("long").alias("value"),
    ).where(F.col("value").isNotNull() & (F.col("stack") != ""))


ROOT = "all"


def flame_tree(folded: DataFrame) -> DataFrame:
    """Nodes of the flame tree: path, parent, name, depth, inclusive and self value.

    The root has depth 0 and an empty path.  Equal stacks are summed before their prefixes are
    expanded; node sums combine map-side.
    """
    stacks = (
        folded.groupBy("stack").agg(F.sum("value").alias("value"))
        .withColumn("_parts", F.filter(F.split("stack", ";"), lambda p: p != "")))
    steps = stacks.select("value", "_parts", F.explode(
        F.sequence(F.lit(0), F.size("_parts"))).alias("depth"))
    path = F.array_join(F.slice("_parts", 1, F.col("depth")), ";")
    parent = F.when(F.col("depth") > 0,
                    F.array_join(F.slice("_parts", 1, F.greatest(F.col("depth") - 1, F.lit(0))),
                                 ";"))
    name = F.when(F.col("depth") > 0, F.get("_parts", F.col("depth") - 1)).otherwise(ROOT)
    ends = (F.col("depth") > 0) & (F.col("depth") == F.size("_parts"))
    return steps.groupBy(path.alias("path"), parent.alias("parent"), name.alias("name"),
                         "depth").agg(
        F.sum("value").alias("value"),
        F.sum(F.when(ends, F.col("value")).otherwise(0)).alias("self_value"))


def flame_share(tree: DataFrame) -> DataFrame:
    """Nodes with their inclusive share of the total, in percent."""
    total = tree.where(F.col("depth") == 0).agg(F.max("value").alias("v")).scalar()
    return tree.withColumn("share", F.try_divide(F.col("value") * 100.0, total))


def flame_layout(tree: DataFrame) -> DataFrame:
    """Nodes with ``x`` and ``width`` in [0, 1]; siblings are laid out by name.

    A node's width is value / total.  Its x is the sum, over itself and its ancestors, of the
    values of the siblings before each, so it comes from one join on ancestor paths.
    """
    siblings = W.partitionBy("parent").orderBy("name").rowsBetween(W.unboundedPreceding, -1)
    placed = tree.withColumn("_ahead", F.when(
        F.col("depth") > 0, F.coalesce(F.sum("value").over(siblings), F.lit(0))).otherwise(0))
    parts = F.split("path", ";")
    chain = F.when(F.col("depth") > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1))),
        lambda i: F.array_join(F.slice(parts, 1, i), ";"))).otherwise(F.array(F.lit("")))
    ancestors = placed.select("path", F.explode(chain).alias("_up"))
    shift = (
        ancestors.join(placed.select(F.col("path").alias("_up"), "_ahead"), "_up")
        .groupBy("path").agg(F.sum("_ahead").alias("_shift")))
    total = tree.where(F.col("depth") == 0).agg(F.max("value").alias("v")).scalar()
    return (
        placed.join(shift, "path")
        .withColumn("x", F.try_divide(F.col("_shift").cast("double"), total))
        .withColumn("width", F.try_divide(F.col("value").cast("double"), total))
        .drop("_ahead", "_shift"))
