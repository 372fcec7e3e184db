import math

import numpy as np
import pytest

from meshlark.operators.coordination import coordination_numbers
from meshlark.plans.energy import atom_coefficients, coordination, density, dispersion_energy, dispersion_energy_and_derivatives, mesh_coordinates

from .fixtures import PER_ATOM, SCALARS, STRAIN_GRADIENT, f32, system


def test_coordination_and_its_strain_convention(spark):
    rows = [(0, 0, 0, 0, 0.7), (1, 1.1, 0.2, 0, 0.8), (2, 0.3, 1.4, 0.1, 0.75), (3, 1.0, 1.2, 1.3, 0.9)]
    atoms = spark.createDataFrame([(i, 0, f32(r), *map(f32, x)) for i, *x, r in rows], "atom_id bigint, species int, rcov double, x double, y double, z double")
    edges = spark.createDataFrame([(0, 1, 0, 0, 0), (1, 2, 0, 0, 0), (2, 3, 0, 0, 0), (0, 3, 1, 0, 0), (3, 0, -1, 0, 0)], "src bigint, dst bigint, sx int, sy int, sz int")
    strain = [[f32(v) for v in r] for r in ((0.01, 0.02, 0), (0, -0.01, 0.015), (0, 0, 0.005))]
    cell = [[5.0, 0, 0], [0, 5.0, 0], [0, 0, 5.0]]
    got = {r.atom_id: r.cn for r in coordination_numbers(atoms, edges, cell, 6.0, strain).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.9999952348, 0.999214588, 0.9998778061, 1.836981852e-21], rel=1e-9)
    plain = {r.atom_id: r.cn for r in coordination_numbers(atoms, edges, cell, 6.0).collect()}
    assert plain[3] == pytest.approx(9.327169244e-32, rel=1e-8)


def test_per_atom_values(spark):
    model = system(spark)
    cn = {r.atom_id: r.cn for r in coordination(model).collect()}
    c6 = {(r.atom_id, r["rank"]): r.c6 for r in atom_coefficients(model).collect()}
    cells = {r.atom_id: (r.cx, r.cy, r.cz) for r in mesh_coordinates(model).collect()}
    for i, (cell, want, a, b, *_) in PER_ATOM.items():
        assert cells[i] == cell and cn[i] == pytest.approx(want, rel=1e-8) and (c6[i, 0], c6[i, 1]) == pytest.approx((a, b), rel=1e-8)
    assert cn[3] == 0
    mass = density(model, atom_coefficients(model)).agg({"rho": "sum"}).first()[0]
    assert mass == pytest.approx(10.7052290055, rel=1e-10)


@pytest.mark.parametrize("name", ["A", "C", "D", "E"])
def test_energy_and_gradients(spark, name):
    lattice, grid, order, absent, energy, total, vself, norm, trace = SCALARS[name]
    e, by_position, by_strain = dispersion_energy_and_derivatives(system(spark, lattice, grid, order, absent))
    row = e.first()
    assert (row.energy, row.total, row.vself) == pytest.approx((energy, total, vself), rel=1e-10)
    g = {r.atom_id: (r.gx, r.gy, r.gz) for r in by_position.collect()}
    assert math.sqrt(sum(x * x for v in g.values() for x in v)) == pytest.approx(norm, rel=1e-7)
    s = {(r.row, r.col): r.g for r in by_strain.collect()}
    assert sum(s[i, i] for i in range(3)) == pytest.approx(trace, rel=1e-7)
    assert all(s[i, j] == pytest.approx(s[j, i], abs=1e-12) for i, j in s)
    if name == "A":
        assert np.array([[s[i, j] for j in range(3)] for i in range(3)]) == pytest.approx(np.array(STRAIN_GRADIENT), rel=1e-7)
        for i, (*_, x, y, z) in PER_ATOM.items():
            assert g[i] == pytest.approx((x, y, z), rel=1e-6, abs=1e-13)


def test_strain_gradient_is_the_energys_slope(spark):
    model, h = system(spark, SCALARS["B"][0]), 1e-4
    strain = lambda v: [[0, v, 0], [0, 0, 0], [0, 0, 0]]
    up, down = (dispersion_energy(model, strain(v)).first().energy for v in (h, -h))
    slope = {(r.row, r.col): r.g for r in dispersion_energy_and_derivatives(model)[2].collect()}[0, 1]
    assert (up - down) / (2 * h) == pytest.approx(slope, rel=1e-5)


def test_bad_models(spark):
    model = system(spark)
    with pytest.raises(ValueError):
        system(spark, grid=(8, 8, 2))
    with pytest.raises(ValueError):
        model.__class__(**{**model.__dict__, "edges": model.atoms})
