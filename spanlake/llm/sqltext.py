"""Pieces of SQL that several queries' reference SQL shares."""

from __future__ import annotations

#: Fixed value: the reflected polynomial of CRC-32.
CRC32_POLYNOMIAL = 3988292384


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an expression of ASCII text, byte by byte and bit by bit."""
    step = f"xor(b >> 1, {CRC32_POLYNOMIAL} * (b & 1))"
    byte = f"list_reduce(list_prepend(xor(s, x), repeat([0::BIGINT], 8)), lambda b, k: {step})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda s, x: {byte}))"
