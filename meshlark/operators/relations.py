"""Tables that functions of points, cells and frequencies may read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_number = count()
_reading: ContextVar[dict[Relation, set[str]] | None] = ContextVar("reading", default=None)


@dataclass(eq=False)
class Relation:
    """A table that shares the columns ``keys`` with what it is read from; without keys it has one row.

    ``relation[column]`` in a kernel or a spectral function is the value of the
    matching row, so the function may be given the relation or just close over
    it.  Without a match numbers are 0.  A relation that is ``many`` may match
    several rows: the function is evaluated for each and its results are added.
    Catalyst decides by its own size check whether the join is a broadcast.
    """

    table: DataFrame
    keys: Sequence[str] = ()
    many: bool = False

    def __post_init__(self):
        missing = set(self.keys) - set(self.table.columns)
        if missing:
            raise ValueError(f"a relation lacks its keys {sorted(missing)}")
        self.name = f"_relation{next(_number)}_"

    def __getitem__(self, column: str) -> Column:
        read = _reading.get()
        if read is None:
            raise ValueError("a relation is read by the functions of operators only")
        if column not in self.table.columns:
            raise ValueError(f"a relation has no column {column}")
        read.setdefault(self, set()).add(column)
        value = F.col(self.name + column)
        return F.coalesce(value, F.lit(0)) if self.table.schema[column].dataType.typeName() in ("double", "float", "long", "integer") else value

    def joined(self, df: DataFrame, columns: Iterable[str]) -> DataFrame:
        """``df`` with these columns, under names of their own."""
        own = [F.col(c).alias(self.name + c) for c in sorted(columns)]
        if not self.keys:
            # A grouped sum has one row whatever the table has; more than one is an error.
            row = self.table.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*own)).alias("row"))
            one = row.select(F.when(F.col("n") <= 1, F.col("row")).otherwise(F.raise_error(F.lit("a relation without keys has one row"))).alias("row"))
            return df.join(F.broadcast(one.select("row.*")))
        missing = set(self.keys) - set(df.columns)
        if missing:
            raise ValueError(f"a relation is keyed by {sorted(missing)}, which is not there")
        return df.join(self.table.select(*self.keys, *own), list(self.keys), "inner" if self.many else "left")


def traced(fn: Callable, *args) -> tuple[object, dict[Relation, set[str]]]:
    """What ``fn`` returns, and the columns of relations that it read."""
    read: dict[Relation, set[str]] = {}
    token = _reading.set(read)
    try:
        return fn(*args), read
    finally:
        _reading.reset(token)


def attach(df: DataFrame, read: dict[Relation, set[str]]) -> DataFrame:
    """Joins what was read."""
    for relation, columns in read.items():
        df = relation.joined(df, columns)
    return df
