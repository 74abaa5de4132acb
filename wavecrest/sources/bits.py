"""Bytes and bits of binary columns: numbers of a row's bytes, fields read from the lowest bit up, and bytes made of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_values(data: Column) -> Column:
    """A binary column as an array of its bytes' numbers."""
    values = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))
    return F.when(F.octet_length(data) > 0, values).otherwise(F.array().cast("array<bigint>"))


def low_bits(b: Column, at: Column | int, n: int) -> Column:
    """``n`` (to 32) bits of an array of bytes from bit ``at`` on, where a byte's lowest bit comes first and later bits are higher; null where they reach
    beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    first, shift = F.floor(at / 8).cast("int"), F.pmod(at, F.lit(8)).cast("int")
    word = F.lit(0).cast("bigint")
    for k in range((n + 14) // 8):
        word = word.bitwiseOR(F.shiftleft(F.coalesce(F.get(b, first + k), F.lit(0)).cast("bigint"), 8 * k))
    value = F.call_function("shiftright", word, shift).bitwiseAND(F.lit((1 << n) - 1))
    return F.when(at + n <= 8 * F.size(b), value)


def le_hex(value: Column, n: int) -> Column:
    """A number's ``n`` lowest bytes in hexadecimal, the lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("bigint"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(n)])
