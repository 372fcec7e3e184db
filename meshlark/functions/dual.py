"""Forward-mode derivatives: expressions that carry their tangent along."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dual:
    """A Column and its tangent."""

    value: Column
    tangent: Column

    @staticmethod
    def of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(x if isinstance(x, Column) else F.lit(float(x)), F.lit(0.0))

    def __add__(self, o) -> Dual:
        o = Dual.of(o)
        return Dual(self.value + o.value, self.tangent + o.tangent)

    def __sub__(self, o) -> Dual:
        o = Dual.of(o)
        return Dual(self.value - o.value, self.tangent - o.tangent)

    def __mul__(self, o) -> Dual:
        o = Dual.of(o)
        return Dual(self.value * o.value, self.tangent * o.value + self.value * o.tangent)

    def __truediv__(self, o) -> Dual:
        o = Dual.of(o)
        q = self.value / o.value
        return Dual(q, (self.tangent - q * o.tangent) / o.value)

    def __neg__(self) -> Dual:
        return Dual(-self.value, -self.tangent)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o) -> Dual:
        return Dual.of(o) - self

    def __rtruediv__(self, o) -> Dual:
        return Dual.of(o) / self

    def outputs(self, name: str) -> dict[str, Column]:
        """Value and tangent as kernel outputs."""
        return {name: self.value, f"{name}_tangent": self.tangent}


def exp(x: Dual) -> Dual:
    e = F.exp(x.value)
    return Dual(e, e * x.tangent)


def log(x: Dual) -> Dual:
    return Dual(F.ln(x.value), x.tangent / x.value)


def sqrt(x: Dual) -> Dual:
    r = F.sqrt(x.value)
    return Dual(r, x.tangent / (2 * r))


def sin(x: Dual) -> Dual:
    return Dual(F.sin(x.value), F.cos(x.value) * x.tangent)


def cos(x: Dual) -> Dual:
    return Dual(F.cos(x.value), -F.sin(x.value) * x.tangent)


def tanh(x: Dual) -> Dual:
    t = F.tanh(x.value)
    return Dual(t, (1 - t * t) * x.tangent)


def horner(coefficients: tuple[float, ...], t: Dual) -> Dual:
    out = Dual.of(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * t + c
    return out


def horner_pick(spline, t: Dual, index: Column) -> Dual:
    """The spline weight that ``index`` numbers, and its tangent."""
    weights = [horner(spline.coefficients(k), t) for k in range(spline.order)]
    return Dual(F.get(F.array(*[w.value for w in weights]), index), F.get(F.array(*[w.tangent for w in weights]), index))
