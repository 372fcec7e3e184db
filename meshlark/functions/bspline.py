"""Cardinal B-splines: stencil offsets, polynomial weights, deconvolution factors.  Exact rationals, no Spark job."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

Polynomial = tuple[Fraction, ...]


def _times(p: Polynomial, q: Polynomial) -> Polynomial:
    out = [Fraction(0)] * (len(p) + len(q) - 1)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            out[i + j] += a * b
    return tuple(out)


def _plus(p: Polynomial, q: Polynomial) -> Polynomial:
    n = max(len(p), len(q))
    return tuple((p[i] if i < len(p) else Fraction(0)) + (q[i] if i < len(q) else Fraction(0)) for i in range(n))


def spline_pieces(order: int) -> list[Polynomial]:
    """Piece k of the spline is its polynomial in t on [k, k + 1), with t counted from k."""
    if order == 1:
        return [(Fraction(1),)]
    below, out = [(), *spline_pieces(order - 1), ()], []
    for k in range(order):
        # M_n(x) = (x M_{n-1}(x) + (n - x) M_{n-1}(x - 1)) / (n - 1) at x = k + t
        rising = _times((Fraction(k), Fraction(1)), below[k + 1]) if below[k + 1] else (Fraction(0),)
        falling = _times((Fraction(order - k), Fraction(-1)), below[k]) if below[k] else (Fraction(0),)
        out.append(tuple(c / (order - 1) for c in _plus(rising, falling)))
    return out


def horner(coefficients: tuple[float, ...], t: Column) -> Column:
    """A polynomial in ``t``, ascending coefficients."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * t + F.lit(c) if c else out * t
    return out


@dataclass(frozen=True)
class Spline:
    """Offsets of the stencil and, for each, the weight as ascending coefficients in the fractional coordinate."""

    order: int
    offsets: tuple[int, ...]
    polynomials: tuple[tuple[Fraction, ...], ...]

    def coefficients(self, k: int, derivative: int = 0) -> tuple[float, ...]:
        p = self.polynomials[k]
        for _ in range(derivative):
            p = tuple(i * c for i, c in enumerate(p))[1:] or (Fraction(0),)
        return tuple(map(float, p))

    def weights(self, t: Column, derivative: int = 0) -> list[Column]:
        return [horner(self.coefficients(k, derivative), t) for k in range(self.order)]

    def fourier_factor(self, n: int) -> list[float]:
        """The size of the stencil's transform on ``n`` points; at an even grid's middle the neighbours' mean square."""
        if n < self.order:
            raise ValueError("the grid must have at least as many points as the spline's order")
        pieces = spline_pieces(self.order)
        samples = [float(pieces[k + 1][0]) if k + 1 < self.order else 0.0 for k in range(self.order)]
        power = []
        for k in range(n):
            re = sum(s * math.cos(2 * math.pi * (j * k % n) / n) for j, s in enumerate(samples))
            im = sum(s * math.sin(2 * math.pi * (j * k % n) / n) for j, s in enumerate(samples))
            power.append(re * re + im * im)
        if n % 2 == 0:
            power[n // 2] = (power[n // 2 - 1] + power[(n // 2 + 1) % n]) / 2
        return [math.sqrt(p) for p in power]


def bspline(order: int) -> Spline:
    """The stencil of a cardinal B-spline of an order of 2 or more."""
    if order < 2:
        raise ValueError("B-spline order must be at least 2")
    first = 1 - order // 2 if order % 2 == 0 else -(order - 1) // 2
    # The weight of offset number k is piece order-1-k at 1-t from above, that is M(k + 1 - t).
    pieces = spline_pieces(order)
    flipped = []
    for k in range(order):
        out: Polynomial = (Fraction(0),)
        power: Polynomial = (Fraction(1),)
        for c in pieces[k]:
            out = _plus(out, tuple(c * x for x in power))
            power = _times(power, (Fraction(1), Fraction(-1)))
        flipped.append(out)
    return Spline(order, tuple(range(first, first + order)), tuple(flipped))
