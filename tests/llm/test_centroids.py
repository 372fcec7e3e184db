import hashlib
import random

import numpy as np
import pytest

from meshlark.llm.centroids import cluster, nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k):
    """The contract in whole Python integers."""
    kept = [(v, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for v, x in rows if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x)]
    centroids = [q for _, q in sorted((hashlib.sha256(f"2:{'' if v is None else v}".encode()).hexdigest(), q) for v, q in kept)[:k]]
    distance = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    for turn in range(6):
        placed = [min((distance(q, c), i) for i, c in enumerate(centroids)) for _, q in kept]
        if turn < 5:
            for i in range(len(centroids)):
                own = [q for (_, q), (_, at) in zip(kept, placed) if at == i]
                if own:
                    centroids[i] = [sum(col) // len(own) for col in zip(*own)]
    inertia = [sum(d for d, at in placed if at == i) for i in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(v), at, d, inertia[at], sum(inertia), digest[at]) for (v, _), (d, at) in zip(kept, placed))


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(rng, n, scale=1.0):
    return [(i, [rng.gauss(i % 5, 1) * scale for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 0.004, 3000.0])
def test_against_brute_force(spark, clashing, scale):
    """The small scale gives many equal distances, the large one distances past 2**53."""
    rng = random.Random(3)
    rows = vectors(rng, 200, scale)
    rows += [(i, rows[3][1]) for i in range(200, 260)] + [(5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65), (904, [nan] + [0.0] * 63), (905, [0.0] * 63 + [-inf]), (906, [None] + [1.0] * 63), (907, [-0.0] * 64)]
    df = clashing(spark.createDataFrame([(v, x, 0) for v, x in rows], SCHEMA).repartition(5))
    assert got(cluster(df, k=12)) == brute(rows, 12)


def test_screening_never_decides_what_rounding_could_turn():
    """Centroids one apart, far from the origin: float32 can't tell them, integers can."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 26), 1 << 26, 64)
    centroids = base + rng.integers(-1, 2, (40, 64))
    centroids[7] = centroids[3]
    x = np.concatenate([base + rng.integers(-1, 2, (500, 64)), centroids])
    best, distance = nearest(x, centroids)
    exact = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert best[-40 + 7] == 3


def test_few_none_and_too_large(spark):
    rng = random.Random(5)
    rows = vectors(rng, 3)
    make = lambda rs: spark.createDataFrame([(v, x, 0) for v, x in rs], SCHEMA)
    assert got(cluster(make(rows))) == brute(rows, 40)
    none = cluster(make([(1, None)]))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not none.collect()
    with pytest.raises(Exception, match="a component is beyond"):
        cluster(make([(1, [1e9] * 64)]))
