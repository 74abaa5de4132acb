"""Column functions over samples and over arrays of samples. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def lit(x: float) -> Column:
    return F.lit(float(x))


def let(value: Column, make) -> Column:
    """make(value), where make may use value often and it is computed once: a lambda's variable is bound to it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def total(values: Column) -> Column:
    """Sum of an array; 0 of an empty one."""
    return F.reduce(values, lit(0), lambda a, x: a + x)


def energy(values: Column) -> Column:
    return F.reduce(values, lit(0), lambda a, x: a + x * x)


def db(power: Column) -> Column:
    return 10 * F.log10(power)


def ratio_db(signal: Column, noise: Column) -> Column:
    """10 log10 of a power ratio; a silent noise gives a large finite number."""
    return db(signal / (noise + lit(1e-30)) + lit(TINY))


def half_away(x: Column) -> Column:
    """Rounded to the nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, lit(high)), lit(low))


def quantise(x: Column, bits: Column | int) -> Column:
    """A sample in [-1, 1] as a signed integer of so many bits."""
    top = F.lit(2 ** (bits - 1) - 1) if isinstance(bits, int) else F.pow(lit(2), bits - 1) - 1
    return half_away(clamp(x) * top).cast("bigint")


def gain(x: Column, decibels: float) -> Column:
    """x itself at 0 dB, else scaled."""
    return x if decibels == 0 else x * lit(10 ** (decibels / 20))


def power_quantise(x: Column, step: float, magic: float = 0.4054) -> Column:
    return (F.signum(x) * F.floor(F.pow(F.abs(x) / lit(step), lit(0.75)) + lit(magic))).cast("bigint")


def power_dequantise(q: Column, step: float) -> Column:
    return F.signum(q) * F.pow(F.abs(q).cast("double"), lit(4 / 3)) * lit(step)


def zigzag(v: Column) -> Column:
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unzigzag(v: Column) -> Column:
    return F.when(v.bitwiseAND(F.lit(1)) == 1, -F.shiftright(v + 1, 1)).otherwise(F.shiftright(v, 1))


def bark(hz: Column) -> Column:
    """Critical-band rate of a frequency."""
    return 13 * F.atan(hz * 0.00076) + 3.5 * F.atan(F.pow(hz / 7500, lit(2)))


def spread_db(dz: Column) -> Column:
    """Schroeder's spreading function of a distance in critical bands."""
    y = dz + 0.474
    return 15.81 + 7.5 * y - 17.5 * F.sqrt(1 + y * y)


def crc_table(width: int, poly: int) -> list[int]:
    """The 256 remainders of a most-significant-bit-first checksum."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for byte in range(256):
        r = byte << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & mask
        out.append(r)
    return out


def crc(data: Column, width: int, poly: int) -> Column:
    """Most-significant-bit-first checksum of a binary column, from 0, without a final inversion, as bigint."""
    mask = (1 << width) - 1
    table = F.array(*[F.lit(v).cast("bigint") for v in crc_table(width, poly)])
    values = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))
    values = F.when(F.octet_length(data) > 0, values).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, byte: Column) -> Column:
        at = F.shiftright(acc, width - 8).bitwiseXOR(byte).bitwiseAND(F.lit(255)).cast("int")
        return F.shiftleft(acc, 8).bitwiseXOR(F.get(table, at)).bitwiseAND(F.lit(mask))

    return F.reduce(values, F.lit(0).cast("bigint"), step)


def db_gain(decibels: float) -> float:
    return math.pow(10, decibels / 20)
