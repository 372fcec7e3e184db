"""Seeded systems with known results.  Fixed values: inputs as 32-bit floats, results computed apart in 64 bits."""

import numpy as np

from meshlark.operators.kernel import Damping
from meshlark.plans.model import Model
from meshlark.sources.storage import small_table

CUBIC = ((10.0, 0.0, 0.0), (0.0, 10.0, 0.0), (0.0, 0.0, 10.0))
TRICLINIC = ((10.0, 0.4, 0.2), (1.1, 9.0, 0.3), (0.7, -0.8, 11.0))
# atom, species, rcov, x, y, z
ATOMS = [
    (0, 0, 1.185541987, 1.487640142, 9.726287842, 8.899355888),
    (1, 1, 1.15045929, 8.22373867, 4.799879074, 2.323729277),
    (2, 1, 1.18844676, 8.018805504, 9.235301971, 2.661302805),
    (3, 0, 0.8889214396, 5.389344215, 4.427528381, 9.310173035),
    (4, 0, 0.6350964904, 0.4051071107, 7.32006216, 6.143732548),
    (5, 1, 1.221488357, 0.2836536467, 7.1921978, 0.159917295),
    (6, 1, 1.025354266, 7.579510212, 5.127587318, 9.291042328),
    (7, 1, 0.810241878, 0.6608249545, 8.413172722, 0.6669000983),
]
# src, dst, sx, sy, sz
EDGES = [
    (6, 1, 0, 0, 1),
    (5, 4, -1, 1, -1),
    (4, 0, 0, 0, 1),
    (2, 3, -1, 1, 1),
    (2, 0, 1, -1, 1),
    (0, 6, 1, -1, 0),
    (0, 6, 0, -1, 0),
    (0, 2, 0, 1, 1),
    (1, 2, 0, 0, 0),
    (6, 5, 1, -1, 0),
    (5, 6, -1, 0, 1),
    (7, 3, 0, 0, 1),
    (4, 5, 0, 1, -1),
    (4, 7, 0, 1, 1),
    (7, 3, 0, 0, 0),
    (5, 0, 0, -1, 1),
    (5, 0, -1, 0, -1),
    (4, 5, 1, 1, 1),
    (4, 5, 1, 1, -1),
    (7, 0, -1, -1, 1),
    (2, 3, 1, 1, 1),
    (6, 3, 1, 1, -1),
    (5, 1, -1, 1, -1),
    (0, 5, 1, 1, 1),
]
# species, ref, cnref, v of rank 0, v of rank 1
REFERENCES = [
    (0, 0, 2.429176807, 1.345875382, 0.7813113928),
    (0, 1, 4.447439194, 0.2644556165, -0.3139228225),
    (0, 2, 4.670217514, 1.458020687, 1.960258365),
    (1, 0, 1.788975954, 1.801634908, 1.315103769),
    (1, 1, 2.857649088, 0.35738042, -1.208318591),
    (1, 2, 1.609346986, -0.004454133101, 0.6564749479),
]
EIGS = [0.402505368, 0.2352515161]
SELFCONT = [0.4503393769, 0.7963242531]
SQRT_QZ = [0.8459632993, 0.5780319571]
PARAMS = [1.0, 0.7875, 0.4289, 4.4407]
# atom: cell, cn, c6 of rank 0 and 1, gradient by x, y, z
PER_ATOM = {
    0: ((1, 7, 7), 5.804522811e-06, 1.345875382, 0.7813113928, 2.608735714e-06, 5.875887797e-06, 1.09643059e-06),
    1: ((6, 3, 1), 0.008123747952, 0.141672735, 0.7097632211, -0.005281679419, 0.003048789727, -0.02473380746),
    2: ((6, 7, 2), 1.207320766e-06, 0.1401127401, 0.7091943358, 1.16435222e-05, -0.000372857167, -2.304870919e-05),
    3: ((4, 3, 7), 0, 1.345875382, 0.7813113928, 3.681468557e-06, -7.728866153e-06, 1.309352658e-06),
    4: ((0, 5, 4), 1.85851912e-06, 1.345875382, 0.7813113928, 3.758564308e-06, 9.131399471e-08, -1.178714765e-05),
    5: ((0, 5, 0), 1.029507043e-05, 0.140114477, 0.7091949692, 3.382040492e-06, 2.977481867e-06, 2.074307439e-07),
    6: ((6, 4, 7), 0.2476249988, 0.1950725552, 0.7292365985, 0.005252444703, -0.002683744043, 0.02476595583),
    7: ((0, 6, 0), 1.100435484e-06, 0.1401127197, 0.7091943283, 4.381575087e-06, 6.158407057e-06, 6.91996427e-07),
}
STRAIN_GRADIENT = [
    [-0.002981122038, 0.00183415468, -0.0159440596],
    [0.00183415468, -0.002126786794, 0.00799066123],
    [-0.0159440596, 0.00799066123, -0.07471968813],
]
# lattice, grid, order, absent references, energy, total, vself, norm of the position gradient, trace of the strain gradient
SCALARS = {
    "A": (CUBIC, (8, 8, 8), 4, (), 0.846088623667, 1.025567141415, 1.693202814474, 3.60171591e-02, -0.0798275970),
    "A2": (CUBIC, (8, 8, 8), 2, (), 0.846087239195, 1.028336084048, 1.693202814474, 3.60179485e-02, -0.0798103257),
    "A3": (CUBIC, (8, 8, 8), 3, (), 0.846086712207, 1.029390060363, 1.693202814474, 3.60166491e-02, -0.0798557346),
    "A6": (CUBIC, (8, 8, 8), 6, (), 0.846088238667, 1.026337139543, 1.693202814474, 3.60170457e-02, -0.0798322247),
    "B": (TRICLINIC, (8, 8, 8), 4, (), 0.840519135866, 0.997174004537, 1.682049391096, 6.18566152e-04, -0.0011657320),
    "C": (CUBIC, (8, 8, 8), 4, ((0, 2), (1, 1)), 0.846088624408, 1.025567142349, 1.693202815958, 3.60171661e-02, -0.0798276123),
    "D": (TRICLINIC, (9, 7, 7), 4, (), 0.840519558196, 0.996340994104, 1.682049391096, 6.18548503e-04, -0.0011693026),
    "E": (TRICLINIC, (8, 10, 12), 6, (), 0.840519099445, 0.997245843726, 1.682049391096, 6.18419069e-04, -0.0011697925),
}


def f32(x):
    return float(np.float32(x))


def system(spark, lattice=CUBIC, grid=(8, 8, 8), order=4, absent=(), positions=None):
    """8 atoms, 24 edges, 2 species with 3 references and 2 ranks."""
    where = positions or [[f32(x) for x in a[3:]] for a in ATOMS]
    atoms = [(a[0], a[1], f32(a[2]), *map(float, x)) for a, x in zip(ATOMS, where)]
    frame = lambda rows, schema: small_table(spark, rows, schema)
    return Model(
        atoms=frame(atoms, "atom_id bigint, species int, rcov double, x double, y double, z double"),
        edges=frame(EDGES, "src bigint, dst bigint, sx int, sy int, sz int"),
        references=frame([(z, p, -1.0 if (z, p) in absent else f32(c)) for z, p, c, *_ in REFERENCES], "species int, ref int, cnref double"),
        v_q=frame([(z, p, r, f32(v[r])) for z, p, _, *v in REFERENCES for r in range(2)], "species int, ref int, rank int, v double"),
        eigs=frame([(r, f32(e)) for r, e in enumerate(EIGS)], "rank int, eig double"),
        selfcont=frame([(z, f32(s)) for z, s in enumerate(SELFCONT)], "species int, s double"),
        species=frame([(z, f32(q)) for z, q in enumerate(SQRT_QZ)], "species int, sqrt_qz double"),
        lattice=lattice, damping=Damping(*map(f32, PARAMS)), r_cut=6.0, grid_shape=grid, order=order,
    )
