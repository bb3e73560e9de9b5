"""Arithmetic and mathematics with checked results: overflow and undefined values are errors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """A float that must be finite."""
    return F.when(F.isnan(x) | (F.abs(x) == math.inf), F.raise_error(F.lit("not a finite number"))).otherwise(x)


def int_div(a: str, b: str) -> Column:
    """Of two expressions: truncates toward zero; division by zero is an error."""
    return F.expr(f"({a}) div ({b})")


def rem(a: Column, b: Column) -> Column:
    return a % b


def abs(x: Column) -> Column:
    return F.abs(x)


def int_pow(x: Column, exponent: int) -> Column:
    """Exact, with an overflow error."""
    return F.aggregate(F.array_repeat(x.cast("bigint"), exponent), F.lit(1).cast("bigint"), lambda a, b: a * b)


def pow(x: Column, exponent: Column | float) -> Column:
    return finite(F.pow(x, exponent if isinstance(exponent, Column) else F.lit(exponent)))


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("bigint")


def float(x: Column) -> Column:  # noqa: A001
    return x.cast("double")


def int(x: Column) -> Column:  # noqa: A001
    return x.cast("bigint")


def decimal(x: Column, precision: int = 38, scale: int = 18) -> Column:  # type: ignore[valid-type]
    """The shortest digits of a float."""
    return x.cast("string").cast(f"decimal({precision},{scale})")


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 93 reach the end for any two 64-bit numbers."""
    pair = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % F.when(s.y == 0, F.lit(1)).otherwise(s.y)).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), pair, step, lambda s: s.x)


def sqrt(x: Column) -> Column:
    return finite(F.sqrt(x))


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round(x: Column) -> Column:
    """Half away from zero."""
    return F.round(x)


def round_decimal(x: Column, places: int = 0) -> Column:  # type: ignore[valid-type]
    """Half to even."""
    return F.bround(x, places)


def exp(x: Column) -> Column:
    return finite(F.exp(x))


def ln(x: Column) -> Column:
    return F.when(x <= 0, F.raise_error(F.lit("ln of a number that is not positive"))).otherwise(F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x <= 0, F.raise_error(F.lit("log10 of a number that is not positive"))).otherwise(F.log10(x))


def sin(x: Column) -> Column:
    return F.sin(x)


def cos(x: Column) -> Column:
    return F.cos(x)


def tan(x: Column) -> Column:
    return F.tan(x)


def random_int(low: Column | object, high: Column | object, key: Column, seed: object = 0) -> Column:
    """Both ends included; by the hash of the seed and a key, so a repeated task draws the same."""
    return (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), key), F.lit(high) - F.lit(low) + 1)).cast("bigint")


def random_float(key: Column, seed: object = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) / F.lit(2.0**53)


def uuid5(name: Column, namespace: str) -> Column:
    """A name-based UUID (version 5) of SHA-1 over namespace and name."""
    import uuid as u

    h = F.sha1(F.concat(F.to_binary(F.lit(u.UUID(namespace).hex), F.lit("hex")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant.substr(nibble, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def uuid() -> Column:
    return F.uuid()
