"""The tables and parameters of a periodic particle system."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernel import Damping

Matrix = Sequence[Sequence[float]]
COLUMNS = {
    "atoms": {"atom_id", "species", "rcov", "x", "y", "z"},
    "edges": {"src", "dst", "sx", "sy", "sz"},
    "references": {"species", "ref", "cnref"},
    "v_q": {"species", "ref", "rank", "v"},
    "eigs": {"rank", "eig"},
    "selfcont": {"species", "s"},
    "species": {"species", "sqrt_qz"},
}


def determinant(m: Matrix) -> float:
    return sum(m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3))


def inverse(m: Matrix) -> list[list[float]]:
    d = determinant(m)
    return [[(m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3]) / d for j in range(3)] for i in range(3)]


@dataclass
class Model:
    """Atoms and directed edges of any size; species tables are small dimensions.

    ``selfcont`` without a ``rank`` column holds for every rank.  A ``cnref`` of
    -1 marks an absent reference.
    """

    atoms: DataFrame
    edges: DataFrame
    references: DataFrame
    v_q: DataFrame
    eigs: DataFrame
    selfcont: DataFrame
    species: DataFrame
    lattice: Matrix
    damping: Damping
    r_cut: float
    grid_shape: tuple[int, int, int]
    order: int = 4

    def __post_init__(self):
        for name, columns in COLUMNS.items():
            missing = columns - set(getattr(self, name).columns)
            if missing:
                raise ValueError(f"{name} lacks {sorted(missing)}")
        if len(self.grid_shape) != 3 or any(n < self.order for n in self.grid_shape):
            raise ValueError("a grid has three dimensions of at least the spline's order")
        if len(self.lattice) != 3 or any(len(r) != 3 for r in self.lattice) or not determinant(self.lattice):
            raise ValueError("a lattice has three independent vectors")
        if "rank" not in self.selfcont.columns:
            self.selfcont = self.selfcont.join(self.eigs.select("rank"))

    @property
    def volume(self) -> float:
        return abs(determinant(self.lattice))

    @property
    def spacing(self) -> float:
        return math.prod(self.grid_shape)

    def strained(self, strain: Matrix) -> Model:
        """Positions and lattice vectors v as v (1 + strain)^T."""
        from dataclasses import replace

        from ..operators.coordination import strained

        x, y, z = strained([F.col(c) for c in "xyz"], strain, transposed=True)
        atoms = self.atoms.select("atom_id", "species", "rcov", x.alias("x"), y.alias("y"), z.alias("z"))
        lattice = [[row[a] + sum(strain[a][b] * row[b] for b in range(3)) for a in range(3)] for row in self.lattice]
        return replace(self, atoms=atoms, lattice=lattice)
