"""Attributes held as two parallel arrays of keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Guardrail values: attributes kept, key length, value length, allowed key characters.
MAX_ATTRS = 32
MAX_KEY_CHARS = 128
MAX_VALUE_CHARS = 512
KEY_PATTERN = "^[a-z0-9._-]+$"


def attr_value(key, prefix: str = "attrs") -> Column:
    """Value at the first position of ``key``; '' when the key is absent."""
    keys, values = F.col(f"{prefix}_keys"), F.col(f"{prefix}_values")
    key = key if isinstance(key, Column) else F.lit(key)
    at = F.array_position(keys, key)
    return F.coalesce(F.when(at > 0, F.get(values, (at - 1).cast("int"))), F.lit(""))


def has_attr(key, prefix: str = "attrs") -> Column:
    key = key if isinstance(key, Column) else F.lit(key)
    return F.coalesce(F.array_contains(F.col(f"{prefix}_keys"), key), F.lit(False))


def attr_equals(key: str, value: str, prefix: str = "attrs") -> Column:
    return has_attr(key, prefix) & (attr_value(key, prefix) == F.lit(value))


def attr_filter(df: DataFrame, key: str, value: str, prefix: str = "attrs") -> DataFrame:
    """Rows that carry attribute ``key`` with exactly ``value`` (first duplicate counts)."""
    return df.where(attr_equals(key, value, prefix))


def attrs_map(prefix: str = "attrs") -> Column:
    """Attributes as a map; the last of duplicate keys wins (session dedup policy)."""
    return F.map_from_arrays(F.col(f"{prefix}_keys"), F.col(f"{prefix}_values"))


def attr_number(key) -> Column:
    """Attribute as a number, 0.0 when it does not parse."""
    return F.coalesce(attr_value(key).try_cast("double"), F.lit(0.0))


def guard_attrs(df: DataFrame, prefix: str = "attrs", dropped: str = "attrs_dropped") -> DataFrame:
    """Apply the tag guardrails and count, per row, the attributes they removed.

    The first 32 attributes are looked at, keys and values are shortened, and keys with
    other than the allowed characters are removed.
    """
    keys, values = F.col(f"{prefix}_keys"), F.col(f"{prefix}_values")
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    short = F.transform(
        F.slice(pairs, 1, MAX_ATTRS),
        lambda p: F.struct(
            F.substring(p["k"], 1, MAX_KEY_CHARS).alias("k"),
            F.substring(p["v"], 1, MAX_VALUE_CHARS).alias("v"),
        ),
    )
    kept = F.filter(short, lambda p: p["k"].rlike(KEY_PATTERN))
    return (
        df.withColumn("_kept", kept)
        .withColumn(dropped, F.size(keys) - F.size("_kept"))
        .withColumn(f"{prefix}_keys", F.col("_kept.k"))
        .withColumn(f"{prefix}_values", F.col("_kept.v"))
        .drop("_kept")
    )
