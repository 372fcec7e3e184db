"""Expressions that record how they came about, and derivatives of them both ways.

A ``Node`` is a Column that remembers its operands and, for each, the partial
derivative.  ``forward`` carries tangents from leaves to results, ``backward``
cotangents from results to leaves; partials are Nodes too, so derivatives can be
differentiated again.  What is known to be zero is left out of both.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar

Partial = Callable[[], "Node"]


class Node:
    """A value and, for each operand that it depends on smoothly, its partial derivative."""

    __slots__ = ("column", "operands", "constant")

    def __init__(self, column: Column, operands: tuple[tuple[Node, Partial], ...] = (), constant: float | None = None):
        self.column, self.constant = column, constant
        self.operands = tuple((x, p) for x, p in operands if x.constant is None)

    @staticmethod
    def of(x) -> Node:
        if isinstance(x, Node):
            return x
        return Node(x) if isinstance(x, Column) else Node(F.lit(float(x)), constant=float(x))

    def __add__(self, o) -> Node:
        o = Node.of(o)
        if self.constant == 0 or o.constant == 0:
            return o if self.constant == 0 else self
        return Node(self.column + o.column, ((self, _one), (o, _one)))

    def __sub__(self, o) -> Node:
        o = Node.of(o)
        return self if o.constant == 0 else Node(self.column - o.column, ((self, _one), (o, lambda: Node.of(-1))))

    def __mul__(self, o) -> Node:
        o = Node.of(o)
        for a, b in ((self, o), (o, self)):
            if a.constant in (0, 1):
                return b if a.constant else a
        return Node(self.column * o.column, ((self, lambda: o), (o, lambda: self)))

    def __truediv__(self, o) -> Node:
        o = Node.of(o)
        return Node(scalar.divide(self.column, o.column), ((self, lambda: 1 / o), (o, lambda: -(self / (o * o)))))

    def __neg__(self) -> Node:
        return Node.of(-self.constant) if self.constant is not None else Node(-self.column, ((self, lambda: Node.of(-1)),))

    def __pow__(self, p) -> Node:
        p = Node.of(p)
        if p.constant is not None:
            return Node(F.pow(self.column, p.column), ((self, lambda: p * self ** (p.constant - 1)),))
        out = Node(F.pow(self.column, p.column))
        out.operands = tuple((x, d) for x, d in ((self, lambda: p * self ** (p - 1)), (p, lambda: out * log(self))) if x.constant is None)
        return out

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o) -> Node:
        return Node.of(o) - self

    def __rtruediv__(self, o) -> Node:
        return Node.of(o) / self

    def __rpow__(self, o) -> Node:
        return Node.of(o) ** self

    def __abs__(self) -> Node:
        return Node(F.abs(self.column), ((self, lambda: sign(self)),))


def _one() -> Node:
    return Node.of(1)


def leaf(column: Column) -> Node:
    """An input by which results may be differentiated; every call makes another one."""
    return Node(column)


def _unary(value: Callable[[Column], Column], slope: Callable[[Node, Node], Node]) -> Callable[[Node], Node]:
    """A function of one operand; ``slope`` gets the operand and the result."""

    def apply(x) -> Node:
        x = Node.of(x)
        out = Node(value(x.column))
        if x.constant is None:
            out.operands = ((x, lambda: slope(x, out)),)
        return out

    return apply


exp = _unary(F.exp, lambda x, y: y)
expm1 = _unary(F.expm1, lambda x, y: y + 1)
log = _unary(scalar.log, lambda x, y: 1 / x)
log1p = _unary(scalar.log1p, lambda x, y: 1 / (1 + x))
sqrt = _unary(scalar.sqrt, lambda x, y: 1 / (2 * y))
rsqrt = _unary(scalar.rsqrt, lambda x, y: -(y / (2 * x)))
square = _unary(scalar.square, lambda x, y: 2 * x)
sin = _unary(F.sin, lambda x, y: cos(x))
cos = _unary(F.cos, lambda x, y: -sin(x))
tan = _unary(F.tan, lambda x, y: 1 + y * y)
tanh = _unary(F.tanh, lambda x, y: 1 - y * y)
sinh = _unary(F.sinh, lambda x, y: cosh(x))
cosh = _unary(F.cosh, lambda x, y: sinh(x))
asin = _unary(F.asin, lambda x, y: rsqrt(1 - x * x))
acos = _unary(F.acos, lambda x, y: -rsqrt(1 - x * x))
atan = _unary(F.atan, lambda x, y: 1 / (1 + x * x))
asinh = _unary(F.asinh, lambda x, y: rsqrt(1 + x * x))
acosh = _unary(F.acosh, lambda x, y: rsqrt(x * x - 1))
atanh = _unary(F.atanh, lambda x, y: 1 / (1 - x * x))
logistic = _unary(scalar.logistic, lambda x, y: y * (1 - y))
erf = _unary(scalar.erf, lambda x, y: 2 / math.sqrt(math.pi) * exp(-(x * x)))
erfc = _unary(scalar.erfc, lambda x, y: -2 / math.sqrt(math.pi) * exp(-(x * x)))


def _flat(value: Callable[[Column], Column]) -> Callable[[Node], Node]:
    """A step function, whose slope is zero wherever it has one."""
    return lambda x: Node(value(Node.of(x).column))


sign, floor, ceil, round_even, round_away = map(_flat, (scalar.sign, scalar.floor, scalar.ceil, scalar.round_even, scalar.round_away))


def select(condition: Column, a, b) -> Node:
    """``a`` where the condition holds, else ``b``; only the one chosen has a slope."""
    a, b = Node.of(a), Node.of(b)
    pick = lambda yes, no: Node(F.when(condition, F.lit(float(yes))).otherwise(F.lit(float(no))))
    return Node(F.when(condition, a.column).otherwise(b.column), ((a, lambda: pick(1, 0)), (b, lambda: pick(0, 1))))


def _either(value: Callable[[Column, Column], Column], wins: Callable[[Column, Column], Column]) -> Callable:
    """The one of two operands that wins has the slope; where they are equal each has half of it."""

    def apply(a, b) -> Node:
        a, b = Node.of(a), Node.of(b)
        share = lambda x, y: Node(F.when(x.column == y.column, F.lit(0.5)).when(wins(x.column, y.column), F.lit(1.0)).otherwise(F.lit(0.0)))
        return Node(value(a.column, b.column), ((a, lambda: share(a, b)), (b, lambda: share(b, a))))

    return apply


maximum = _either(scalar.maximum, lambda a, b: F.isnan(b) | (~F.isnan(a) & (a > b)))
minimum = _either(scalar.minimum, lambda a, b: F.isnan(b) | (~F.isnan(a) & (a < b)))


def clamp(x, low, high) -> Node:
    return minimum(maximum(x, low), high)


def _order(results: Iterable[Node]) -> list[Node]:
    """All that the results depend on, operands first."""
    seen, out, todo = set(), [], [(r, False) for r in results]
    while todo:
        node, ready = todo.pop()
        if ready:
            out.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            todo.append((node, True))
            todo += [(x, False) for x, _ in node.operands]
    return out


def forward(results: Mapping[str, Node], tangents: Mapping[Node, Node | Column]) -> dict[str, Node]:
    """The tangents of results, given those of leaves; without those that are zero for certain."""
    found: dict[int, Node] = {id(x): Node.of(t) for x, t in tangents.items()}
    for node in _order(results.values()):
        if id(node) not in found:
            parts = [p() * found[id(x)] for x, p in node.operands if id(x) in found]
            parts = [p for p in parts if p.constant != 0]
            if parts:
                found[id(node)] = sum(parts[1:], parts[0])
    return {name: found[id(r)] for name, r in results.items() if id(r) in found}


def backward(cotangents: Iterable[tuple[Node, Node | Column]], leaves: Mapping[str, Node]) -> dict[str, Node]:
    """The cotangents of leaves, given those of results; without those that are zero for certain."""
    cotangents = list(cotangents)
    found: dict[int, Node] = {}

    def add(node: Node, c: Node) -> None:
        if c.constant != 0:
            found[id(node)] = found[id(node)] + c if id(node) in found else c

    for node, c in cotangents:
        add(node, Node.of(c))
    for node in reversed(_order(r for r, _ in cotangents)):
        if id(node) in found:
            for x, p in node.operands:
                add(x, p() * found[id(node)])
    return {name: found[id(x)] for name, x in leaves.items() if id(x) in found}
