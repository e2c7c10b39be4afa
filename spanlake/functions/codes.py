"""Enumerations, comparisons, identifiers and text renderings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Wire codes of the telemetry protocol.
SPAN_KINDS = {1: "Internal", 2: "Server", 3: "Client", 4: "Producer", 5: "Consumer"}
STATUS_CODES = {1: "Ok", 2: "Error"}
SEVERITY_FLOORS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "WARNING": 13, "ERROR": 17,
                   "FATAL": 21}
STATUS_ERROR = 2
LOG_ERROR_FLOOR = 17
DOUBLE_EPSILON = 2.220446049250313e-16


def _named(code: Column, names: dict[int, str], default: str) -> Column:
    out = F.lit(default)
    for number, name in names.items():
        out = F.when(code == number, name).otherwise(out)
    return out


def span_kind(code: Column) -> Column:
    return _named(code, SPAN_KINDS, "Unspecified")


def status_name(code: Column) -> Column:
    return _named(code, STATUS_CODES, "Unset")


def severity_band(number: Column) -> Column:
    """Severity name of a number 1..24, four numbers to a band; anything else is Info."""
    bands = F.array(*[F.lit(n) for n in ("Trace", "Debug", "Info", "Warn", "Error", "Fatal")])
    at = F.floor((number - 1) / 4).cast("int")
    return F.when(number.between(1, 24), F.get(bands, at)).otherwise("Info")


def severity_floor(name: str | None) -> int | None:
    """Lowest severity number of a named level; None (no filter) for unknown names."""
    return SEVERITY_FLOORS.get(name.upper()) if name else None


def is_error() -> Column:
    return F.col("status_code") == STATUS_ERROR


def violated(op: Column, value: Column, threshold: Column) -> Column:
    """Threshold comparison chosen per row; a missing value never violates."""
    verdict = (
        F.when(op == "gt", value > threshold)
        .when(op == "gte", value >= threshold)
        .when(op == "lt", value < threshold)
        .when(op == "lte", value <= threshold)
        .when(op == "eq", F.abs(value - threshold) < DOUBLE_EPSILON)
    )
    return F.coalesce(verdict, F.lit(False))


def op_symbol(op: Column) -> Column:
    return F.element_at(
        F.create_map(*[F.lit(x) for x in
                       ("gt", ">", "gte", ">=", "lt", "<", "lte", "<=", "eq", "==")]), op)


def hex_id(raw_hex: Column, width: int) -> Column:
    """Lower-case hex, cut or right-padded with '0' to ``width`` characters."""
    return F.rpad(F.coalesce(F.lower(raw_hex), F.lit("")), width, "0")


def natural_id(*parts: Column, width: int = 32) -> Column:
    """Repeatable identifier of a natural key."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256),
                       1, width)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text such as ``0.1250``."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with at least 1 in the denominator."""
    return part / F.greatest(whole, F.lit(1)) * 100


def series_key(*labels: str) -> Column:
    """``service=a,env=b`` key of a labelled series."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in labels])


def series_labels(key: Column) -> Column:
    return F.str_to_map(key, F.lit(","), F.lit("="))
