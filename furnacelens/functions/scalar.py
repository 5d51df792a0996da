"""Column expressions shared by the operators. Everything here stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 4294967296  # stable_hash yields 0 .. HASH_SPAN - 1
ROUND_SHIFT = 0.0317


def _col(x: Column | str) -> Column:
    return F.col(f"`{x}`") if isinstance(x, str) else x


def _num(x: Column | str | float | int) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else _col(x)


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), _col(x)))


def ramp(x: Column | str, start: float, full: float) -> Column:
    """0 below ``start``, 100 above ``full``, linear between."""
    return clamp((_col(x) - F.lit(float(start))) / F.lit(full - start) * F.lit(100.0), 0.0, 100.0)


def excess(x: Column | str, limit: float) -> Column:
    """How far x lies above a limit, never below 0."""
    return F.greatest(F.lit(0.0), _col(x) - F.lit(float(limit)))


def is_finite(x: Column | str) -> Column:
    c = _col(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def null_if_not_finite(x: Column | str) -> Column:
    return F.when(is_finite(x), _col(x))


def finite_or(x: Column | str, default: float = 0.0) -> Column:
    return F.when(is_finite(x), _col(x)).otherwise(F.lit(float(default)))


def truthy_or(x: Column | str, default: float) -> Column:
    """A missing value and a zero both read as the default."""
    c = _col(x)
    return F.when(c.isNull() | (c == F.lit(0.0)), F.lit(float(default))).otherwise(c)


def trunc_score(x: Column, low: int, high: int) -> Column:
    """Truncate towards zero, then clamp: the form every operational score takes."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x.cast("int")))


def r6(x: Column | str, digits: int = 6) -> Column:
    """Round for reporting.

    The small shift moves values that sit exactly on a rounding boundary off it, so the last bit of a
    sum cannot decide the digit; adding 0.0 turns -0.0 into 0.0.
    """
    return F.round(_col(x).cast("double") + F.lit(ROUND_SHIFT * 10.0**-digits), digits) + F.lit(0.0)


def stable_hash(ident: Column | str, seed: int | str) -> Column:
    """Uniform 32-bit number from an id and a seed; independent of partitioning."""
    text = F.concat_ws("|", _col(ident).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform01(ident: Column | str, seed: int | str) -> Column:
    """Uniform in (0, 1): never exactly 0, so log() is safe."""
    return (stable_hash(ident, seed) + F.lit(0.5)) / F.lit(float(HASH_SPAN))


def gaussian(ident: Column | str, seed: int | str) -> Column:
    """Standard normal by Box-Muller on two hashed uniforms; same draw for the same id and seed."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform01(ident, f"{seed}/a")))
    return radius * F.cos(F.lit(6.283185307179586) * uniform01(ident, f"{seed}/b"))
