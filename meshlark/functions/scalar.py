"""Scalar operations with IEEE semantics, where those of Spark's ANSI mode differ."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def _nan() -> Column:
    return F.lit(float("nan"))


def divide(a: Column, b: Column) -> Column:
    """Quotient of doubles; by zero an infinity, whose sign a negative zero turns, or NaN instead of an error."""
    # Spark compares zeros of both signs as equal; their texts differ.
    negative = (a < 0) != b.cast("double").cast("string").startswith("-")
    by_zero = F.when(F.isnan(a) | (a == 0), _nan()).otherwise(F.when(negative, F.lit(-INF)).otherwise(F.lit(INF)))
    return F.when((b != 0) | F.isnan(b), a / b).otherwise(by_zero)


def int_divide(a: Column, b: Column) -> Column:
    """Integer quotient truncated toward zero; null by zero."""
    return F.when(b != 0, F.call_function("div", a, b))


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return F.try_mod(a, b)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(_nan())


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-INF)).otherwise(_nan())


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x)).otherwise(_nan())


def rsqrt(x: Column) -> Column:
    return divide(F.lit(1.0), sqrt(x))


def sign(x: Column) -> Column:
    """-1, 0 or 1; 0 for NaN."""
    return F.when(F.isnan(x), F.lit(0.0)).when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def maximum(a: Column, b: Column) -> Column:
    """The larger one; a NaN is ignored if the other is a number."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def minimum(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return minimum(maximum(x, low), high)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def square(x: Column) -> Column:
    return x * x


def floor(x: Column) -> Column:
    """A double, as large as it may be; Spark's own gives a long."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def ceil(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x)


def round_even(x: Column) -> Column:
    return F.rint(x)


def round_away(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    size = F.abs(x)
    whole = floor(size)
    # Adding a half first would round the largest double below a half up.
    return F.signum(x) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def compare(op: str, a: Column, b: Column) -> Column:
    """EQ NE LT LE GT GE; with a NaN only NE holds."""
    plain = {"EQ": a == b, "NE": a != b, "LT": a < b, "LE": a <= b, "GT": a > b, "GE": a >= b}[op]
    return F.when(F.isnan(a) | F.isnan(b), F.lit(op == "NE")).otherwise(plain)


def to_int(x: Column, kind: str = "bigint") -> Column:
    """Truncates toward zero; null where it doesn't fit."""
    return x.try_cast(kind)


def count_leading_zeros(x: Column, bits: int = 32) -> Column:
    """Of an integer of 32 or 64 bits."""
    return F.when(x < 0, 0).when(x == 0, bits).otherwise(bits - F.length(F.bin(x))).cast("int")


def popcount(x: Column, bits: int = 32) -> Column:
    """Set bits of an integer of 8, 16, 32 or 64 bits."""
    wide = x.cast("bigint")
    return F.bit_count(wide if bits == 64 else wide.bitwiseAND(F.lit((1 << bits) - 1))).cast("int")


def wrapping(op: Callable[[Column, Column], Column], a: Column, b: Column, bits: int = 32) -> Column:
    """Sum, difference or product of integers of up to 32 bits, which wraps around instead of failing."""
    half = 1 << (bits - 1)
    low = op(a.cast("bigint"), b.cast("bigint")).bitwiseAND(F.lit((1 << bits) - 1))
    return (low - F.when(low >= half, 2 * half).otherwise(0)).cast({8: "tinyint", 16: "smallint", 32: "int"}[bits])


def _halves(x: Column) -> tuple[Column, Column]:
    """The upper and lower 32 bits of a long, both as they are unsigned."""
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))


def _long(high: Column, low: Column) -> Column:
    """A long of two unsigned halves; what is over 32 bits in ``high`` is dropped."""
    return F.shiftleft(high.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(low)


def wrapping_add(a: Column, b: Column) -> Column:
    """Sum of longs, which wraps around instead of failing."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    low = al + bl
    return _long(ah + bh + F.shiftrightunsigned(low, 32), low.bitwiseAND(F.lit(0xFFFFFFFF)))


def wrapping_subtract(a: Column, b: Column) -> Column:
    return wrapping_add(wrapping_add(a, F.bitwise_not(b)), F.lit(1).cast("bigint"))


def wrapping_multiply(a: Column, b: Column) -> Column:
    """Product of longs, which wraps around instead of failing: of 16-bit words, as products of halves would not fit."""
    words = lambda x: [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    x, y = words(a), words(b)
    out, carry = [], F.lit(0).cast("bigint")
    for n in range(4):
        total = sum((x[i] * y[n - i] for i in range(n + 1)), carry)
        out.append(total.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftrightunsigned(total, 16)
    return _long(out[3] * 65536 + out[2], out[1] * 65536 + out[0])


def case(selector: Column, branches: Sequence[Column]) -> Column:
    """The branch that ``selector`` numbers; out of range the last one."""
    out = branches[-1]
    for i, b in reversed(list(enumerate(branches[:-1]))):
        out = F.when(selector == i, b).otherwise(out)
    return out


def repeat(times: int, step: Callable[[int, Column], Column], start: Column) -> Column:
    """A loop whose number of rounds is known when the plan is built."""
    for i in range(times):
        start = step(i, start)
    return start


def _erf_near(x: np.ndarray) -> np.ndarray:
    """Its power series times exp(-x^2): terms of one sign, for |x| up to 3."""
    term = x * (2 / math.sqrt(math.pi)) * np.exp(-x * x)
    total = term.copy()
    for n in range(1, 80):
        term = term * (2 * x * x / (2 * n + 1))
        total += term
    return total


def _erfc_far(x: np.ndarray) -> np.ndarray:
    """Its continued fraction, for x of 2 and more."""
    tail = np.zeros_like(x)
    for k in range(120, 0, -1):
        tail = (k / 2) / (x + tail)
    return np.exp(-x * x) / (x + tail) / math.sqrt(math.pi)


@F.pandas_udf(T.DoubleType())
def _erf(x: pd.Series) -> pd.Series:
    v = x.to_numpy("f8")
    far = np.clip(np.abs(v), 3, 40)
    return pd.Series(np.where(np.abs(v) < 3, _erf_near(np.clip(v, -3, 3)), np.sign(v) * (1 - _erfc_far(far))))


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    v = x.to_numpy("f8")
    inner = 1 - _erf_near(np.clip(v, -3, 2))
    out = np.where(v > 2, _erfc_far(np.clip(v, 2, 40)), np.where(v < -3, 1 + (1 - _erfc_far(np.clip(-v, 3, 40))), inner))
    return pd.Series(out)


def erf(x: Column) -> Column:
    """Null stays null, as a pandas function can't tell it from NaN."""
    return F.when(F.isnan(x), _nan()).otherwise(_erf(x))


def erfc(x: Column) -> Column:
    return F.when(F.isnan(x), _nan()).otherwise(_erfc(x))


@F.pandas_udf(T.LongType())
def double_bits(x: pd.Series) -> pd.Series:
    """The bits of a double as a long."""
    return pd.Series(x.to_numpy("f8").view("i8"))


@F.pandas_udf(T.DoubleType())
def bits_double(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy("i8").view("f8"))


@F.pandas_udf(T.IntegerType())
def float_bits(x: pd.Series) -> pd.Series:
    """The bits of a 32-bit float as an int."""
    return pd.Series(x.to_numpy("f4").view("i4"))


@F.pandas_udf(T.FloatType())
def bits_float(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy("i4").view("f4"))
