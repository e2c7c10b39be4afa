"""Metrics derived from logs by rules.

A rule is (tenant_id, rule_id, metric_name, filter_type, filter_value, value_field, enabled,
...).  Filter types: keyword (whole token), severity, service, body_regex.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attrs import attr_number, has_attr
from ..functions.text import SEPARATOR, has_token, words
from ..functions.topk import top_k
from ..session import cut_lineage

FILTER_TYPES = ("keyword", "severity", "service", "body_regex")


def rule_predicate(rule: Mapping[str, str]) -> Column:
    """Predicate of a single rule over a logs frame."""
    kind, value = rule["filter_type"], rule["filter_value"]
    if kind == "keyword":
        return has_token(F.col("body"), value)
    if kind in ("severity", "service"):
        return F.col({"severity": "severity_text", "service": "service"}[kind]) == value
    if kind == "body_regex":
        return F.col("body").rlike(value)
    raise ValueError(f"unknown filter type: {kind}")


def checked_type() -> Column:
    """The rule's filter type; an unknown one fails the job."""
    kind = F.col("filter_type")
    return F.when(kind.isin(*FILTER_TYPES), kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown filter type: "), kind)))


#: Bits of the word filter, in numbers of 64; and the words up to which a set of them is quicker.
FILTER_CELLS, FEW_WORDS = 1 << 14, 64
#: From this many words on, one in 64 bits, the filter lets too many words pass that no rule has.
MANY_WORDS = FILTER_CELLS


def _literals(regex: Column) -> Column:
    """Texts that stand in every match of a regular expression; none where that is hard to tell.

    Classes, dots, anchors and whatever a quantifier lets go are gaps between the texts.  An expression
    with groups, alternatives or escapes gives none.
    """
    quantifier = r"(?:[*+?]|\{[^}]*\})[+?]?"
    gaps = F.regexp_replace(regex, rf"\[\^?[^\[\]&]+\](?:{quantifier})?", "\n")
    gaps = F.regexp_replace(gaps, rf".{quantifier}|[.^$\n]", "\n")
    plain = ~regex.rlike(r"[|()\\\n]|&&") & ~gaps.rlike(r"[\[\]{}*+?]")
    return F.when(plain, F.filter(F.split(gaps, "\n"), lambda t: t != "")).otherwise(F.array().cast("array<string>"))


def _patterns(rules: DataFrame) -> Column:
    """Distinct regexes of the enabled rules with their tenant and literals, as one array."""
    regex = F.col("filter_value")
    wanted = rules.where("enabled AND filter_type = 'body_regex'").select(
        "tenant_id", regex.alias("regex"), _literals(regex).alias("literals")).distinct()
    return wanted.agg(F.collect_list(F.struct("tenant_id", "regex", "literals"))).scalar()


def _cell(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(FILTER_CELLS - 1)).cast("int")


def _bit(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 32).bitwiseAND(F.lit(63)).cast("int")


def _keywords(rules: DataFrame) -> tuple[Column, Column]:
    """The words that rules look for: all of them if there are few, and a filter over their hashes."""
    wanted = rules.where("enabled AND filter_type = 'keyword'").select(F.col("filter_value").alias("w")).distinct()
    few = wanted.limit(FEW_WORDS + 1).agg(F.collect_list("w")).scalar()
    cells = wanted.select(_cell(F.col("w")).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("w")))
                          .alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = rules.sparkSession.range(FILTER_CELLS).join(cells, "id", "left").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))),
                    lambda c: c["bits"]))
    return few, every.scalar()


def _probes() -> Column:
    """What a log can match: its severity, its service, those of its distinct words that some rule may look
    for, and those of the ``_patterns`` of its tenant that its body matches, each tested once however many
    rules share it.

    Few rule words are one set that the log's words are intersected with.  Of many, a bit per hash tells a
    word that no rule has, at the same price for any number of rules; the join sorts out the rest.
    """
    found = words(F.coalesce("body", F.lit("")))
    maybe = F.filter(found, lambda w: F.call_function("getbit", F.get("_cells", _cell(w)), _bit(w)) == 1)
    known = (F.when(F.size("_few") == 0, F.array().cast("array<string>"))
             .when(F.size("_few") <= FEW_WORDS, F.array_intersect(found, F.col("_few")))
             .otherwise(F.array_distinct(maybe)))
    hits = F.filter("_patterns", lambda p: (p["tenant_id"] == F.col("tenant_id"))
                    & F.forall(p["literals"], lambda t: F.contains(F.col("body"), t))
                    & F.coalesce(F.call_function("rlike", F.col("body"), p["regex"]), F.lit(False)))
    return F.concat(F.array(F.concat(F.lit("severity:"), "severity_text"),
                            F.concat(F.lit("service:"), "service")), known,
                    F.transform(hits, lambda p: F.concat(F.lit("body_regex:"), p["regex"])))


def _held_rules(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """The enabled rules without those whose keyword no log of their tenant holds.

    The logs' words are reduced to distinct ones per task, and only words are shuffled.
    """
    rules = rules.where("enabled").select("enabled", "tenant_id", "metric_name", "filter_type", "filter_value", "value_field")
    seen = logs.select("tenant_id", F.explode(F.array_distinct(words(F.coalesce("body", F.lit("")))))
                       .alias("filter_value")).distinct()
    keyword = F.col("filter_type").eqNullSafe("keyword")
    held = rules.where(keyword).join(seen, ["tenant_id", "filter_value"], "left_semi")
    return cut_lineage(rules.where(~keyword).unionByName(held.select(rules.columns)), "rules")


def _rule_key() -> Column:
    """Join key of a rule.  Words hold no ':', so they cannot clash with the prefixed keys; a
    keyword that is empty or has a separator in it is no word and matches nothing."""
    kind, value = checked_type(), F.col("filter_value")
    return (F.when(kind == "keyword", F.when(~value.rlike(SEPARATOR) & (value != ""), value))
            .otherwise(F.concat(kind, F.lit(":"), value)))


def apply_rules(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """One metric row per log and enabled rule that matches it, for any number of rules.

    A log is exploded into the keys it can match, a rule has one key, and an equi join brings them
    together.  Spark broadcasts the rules where their size allows; beyond that a hot key such as one
    severity is split by the skew handling of AQE.  Of so many keywords that the word filter is no
    help, those that no log holds are first left out; a stream cannot be read ahead, so there each
    micro-batch is exploded into all words that pass the filter.
    """
    if not logs.isStreaming and rules.where("enabled AND filter_type = 'keyword'").select(
            "filter_value").distinct().limit(MANY_WORDS).count() == MANY_WORDS:
        rules = _held_rules(logs, rules)
    keyed = rules.where("enabled").select(
        F.col("tenant_id").alias("_tenant"), "metric_name", _rule_key().alias("_key"),
        F.coalesce("value_field", F.lit("")).alias("value_field"))
    few, cells = _keywords(rules)
    probed = logs.withColumn("_patterns", _patterns(rules)).withColumn("_few", few).withColumn("_cells", cells).select(
        "tenant_id", "timestamp", "service", "env", "attrs_keys", "attrs_values",
        F.explode(_probes()).alias("_probe"))
    field = F.col("value_field")
    on = (F.col("tenant_id") == F.col("_tenant")) & (F.col("_probe") == F.col("_key"))
    found = probed.join(keyed, on).where((field == "") | has_attr(field))
    return _metric_rows(found.withColumn(
        "_value", F.when(field == "", 1.0).otherwise(attr_number(field))))


def _metric_rows(matched: DataFrame) -> DataFrame:
    """Counting rules give counters without attributes, value rules gauges with them."""
    counts, empty = F.col("value_field") == "", F.array().cast("array<string>")
    return matched.select(
        "tenant_id", F.timestamp_millis(F.unix_millis("timestamp")).alias("timestamp"),
        F.col("metric_name").alias("name"), F.when(counts, 1).otherwise(0).alias("type"),
        F.col("_value").alias("value"), "service", "env",
        F.when(counts, empty).otherwise(F.col("attrs_keys")).alias("attrs_keys"),
        F.when(counts, empty).otherwise(F.col("attrs_values")).alias("attrs_values"))


def list_rules(rules: DataFrame, limit: int = 1000) -> DataFrame:
    """Rules, newest first."""
    return top_k(rules, [F.col("created_at").desc(), F.col("rule_id")], limit)
