"""Complex numbers as pairs of Columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar


class Complex(NamedTuple):
    re: Column
    im: Column

    def __add__(self, o: Complex) -> Complex:
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Complex) -> Complex:
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o: Complex) -> Complex:
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o: Complex) -> Complex:
        d = o.re * o.re + o.im * o.im
        return Complex(scalar.divide(self.re * o.re + self.im * o.im, d), scalar.divide(self.im * o.re - self.re * o.im, d))

    def __neg__(self) -> Complex:
        return Complex(-self.re, -self.im)

    def scale(self, x: Column) -> Complex:
        return Complex(self.re * x, self.im * x)

    def conjugate(self) -> Complex:
        return Complex(self.re, -self.im)

    def square(self) -> Complex:
        return self * self

    def abs(self) -> Column:
        return F.sqrt(self.re * self.re + self.im * self.im)

    def equals(self, o: Complex) -> Column:
        return scalar.compare("EQ", self.re, o.re) & scalar.compare("EQ", self.im, o.im)

    def differs(self, o: Complex) -> Column:
        return scalar.compare("NE", self.re, o.re) | scalar.compare("NE", self.im, o.im)

    def struct(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))


def cis(angle: Column) -> Complex:
    return Complex(F.cos(angle), F.sin(angle))
