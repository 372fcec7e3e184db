"""Coordination numbers and mesh densities of growing tables, by Structured Streaming.

Both are plain sums, so new edges or points only add to what has been summed.
Run the results in ``update`` or ``complete`` mode; the state is one row per
source atom or per batch and cell, kept by Spark on all executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coordination import Matrix, edge_geometry, switching
from ..operators.scatter import Outputs, Stencil, Support, scatter_to_mesh


def streaming_coordination(atoms: DataFrame, edges: DataFrame, lattice: Matrix, r_cut: float) -> DataFrame:
    """``(src, cn)`` so far for a stream of edges among fixed atoms; an atom without edges has no row."""
    terms = edge_geometry(atoms, edges, lattice).select("src", switching(F.col("rc"), F.col("d"), r_cut).alias("c"))
    return terms.groupBy("src").agg(F.sum("c").alias("cn"))


def streaming_density(points: DataFrame, support: Support, kernel: Callable[[Stencil], Outputs], grid_shape: Sequence[int], **more) -> DataFrame:
    """Values per batch and cell so far for a stream of points."""
    return scatter_to_mesh(points, support, kernel, grid_shape, **more)
