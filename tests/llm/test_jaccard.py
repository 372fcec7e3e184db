import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.llm import jaccard
from meshlark.llm.components import components
from meshlark.llm.jaccard import jaccard_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """``{doc: (n_shingles, component)}``; rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if both and 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def changed(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return words


def corpus(seed):
    """Chains of near copies, exact copies, a common passage, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(40)]
    rows, ids = [], iter(rng.sample(range(10_000), 5000))
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 8, 12, 20, 60, 200, 400]))]
        words = base
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            rows.append((next(ids), " ".join(words)))
            words = changed(words, rng.choice([0, 1, 1, 2, len(words) // 50]), rng)
    for k in range(90):  # a common passage that dominates some texts
        own = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 10, 50]))]
        rows.append((next(ids), " ".join(own + passage[: rng.choice([20, 40])])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 3])
def test_matches_brute_force(documents, clashing, seed):
    rows = corpus(seed)
    got = jaccard_components(clashing(documents(rows, parts=6)), leader_rounds=seed - 1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_large_group_of_near_copies(documents, monkeypatch):
    """2,000 near copies of one text, of which about a fifth of the pairs link; the last round may meet few of them."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(changed(base, rng.choice([0, 1, 1, 1, 2, 2, 3, 4, 5]), rng))) for i in rng.sample(range(100_000), 2000)]
    number, sets = {}, []
    for _, t in rows:
        sets.append([number.setdefault(s, len(number)) for s in shingles(t)])
    seen = [0] * len(number)
    for s in sets:
        for x in s:
            seen[x] += 1
    column = {x: i for i, x in enumerate(x for x, k in enumerate(seen) if k > 1)}
    has = np.zeros((len(rows), len(column)), "f4")
    for i, s in enumerate(sets):
        has[i, [column[x] for x in s if x in column]] = 1
    n = np.array([len(s) for s in sets])
    both = has @ has.T
    link = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(link, True)
    assert 0.1 < link.mean() < 0.4
    ids = np.array([i for i, _ in rows])
    label = ids.copy()
    while True:
        new = np.where(link, label[None, :], 1 << 40).min(axis=1)
        if (new == label).all():
            break
        label = new
    met = []
    real = jaccard._pairs_apart
    monkeypatch.setattr(jaccard, "_pairs_apart", lambda sets: met.append(pairs := jaccard.materialize(real(sets), "met")) or pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(rows)).collect()}
    assert got == {int(i): (int(k), int(c)) for i, k, c in zip(ids, n, label)}
    assert met[0].count() < 10 * len(rows)


def test_short_texts_link_whatever_their_hashes(documents):
    """Pairs of 11 or 12 words that differ in the last one: 7 of 8 shingles, wherever these lie in the order."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = [f"q{i}-{j}" for j in range(11)]
        rows += [(4 * i, " ".join(words)), (4 * i + 1, " ".join([*words, "end"])), (4 * i + 2, " ".join([*words, "close"])), (4 * i + 3, f"other {rng.random()} words {i} at all")]
    got = {r.doc_id: r.component_id for r in jaccard_components(documents(rows)).collect()}
    assert got == {4 * i + j: 4 * i + (3 if j == 3 else 0) for i in range(400) for j in range(4)}


def test_very_long_text(documents):
    rng = random.Random(5)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(changed(words, 2000, rng))), (3, " ".join(changed(words, 20_000, rng))), (4, " ".join(words[:100]))]
    got = {r.doc_id: r.component_id for r in jaccard_components(documents(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one two"), (6, "one  TWO"), (9, "one two three four five"), (8, "ONE two three four five"), (7, "É é"), (10, "é é"), (None, "one two"), (20, "a b c d e f g h i j"), (20, "one two"), (21, "a b c d e f g h i j")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(documents(rows)).collect())
    want = [("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 1, 5), ("6", 1, 4), ("9", 1, 8), ("8", 1, 8), ("7", 1, 7), ("10", 1, 10), ("None", 1, None), ("20", 6, 4), ("20", 1, 4), ("21", 6, 4)]
    assert got == sorted(want)


def test_repeated_rows_count_once(documents):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, shared + " " + " ".join(f"a{i}" for i in range(40)))] * 3 + [(2, shared + " " + " ".join(f"b{i}" for i in range(40)))] * 2
    assert {(r.doc_id, r.component_id) for r in jaccard_components(documents(rows)).collect()} == {(1, 1), (2, 2)}


def test_empty_table(documents):
    assert jaccard_components(documents([(1, "a")]).limit(0)).count() == 0


def test_components_of_long_chains(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001), (1001, 1002)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_least_overlap_is_the_threshold(spark):
    df = spark.range(1, 60).select(F.col("id").alias("n")).crossJoin(spark.range(1, 60).select(F.col("id").alias("m")))
    for r in df.select("n", "m", jaccard.least_overlap(F.col("n"), F.col("m")).alias("o")).collect():
        assert r.o == next(i for i in range(200) if 100 * i >= 75 * (r.n + r.m - i))
