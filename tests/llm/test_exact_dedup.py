import hashlib
import random
import re

from pyspark.sql import functions as F

from meshlark.llm.exact_dedup import CHUNKS, chunks_of, exact_dedup

WORDS = "alpha beg. gamma dog\n kim; zed |and 3 häuser 東京 🙂 of".split(" ")


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 300, 3000]))) for _ in range(n)]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    base = texts(40)
    rng = random.Random(2)
    out = [(i, rng.choice(base)) for i in range(150)]
    out += [(200, None), (201, ""), (202, " "), (203, "x" * 50_000), (204, "x" * 50_000), (205, "x" * 49_999), (205, "x" * 49_999), (None, "lost"), (None, "ti"), (206, "ti")]
    return out


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_matches_brute_force(documents, clashing):
    assert result(exact_dedup(clashing(documents(rows())))) == brute(rows())


def test_shared_identifiers_are_told_apart_by_text(documents):
    """With an identifier of one bit nearly all chunks clash; the result is the same."""
    weak = exact_dedup(documents(rows()), digest=lambda c: F.length(c) % 2)
    assert result(weak) == brute(rows())


def test_chunks_rebuild_the_text_and_follow_content(spark, documents):
    rng = random.Random(5)
    letters = "eeetaoinshrdlucmfwypvbgkxz"
    long = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    df = documents([(1, long), (2, "inserted up front: " + long), (3, "")])
    got = {r.doc_id: r.c for r in df.select("doc_id", chunks_of(F.col("text")).alias("c")).collect()}
    assert "".join(got[1]) == long and got[3] == []
    assert len(set(got[1]) & set(got[2])) > 0.8 * len(set(got[1]))
    assert all(len(c) <= 4096 for c in got[1]) and re.compile(CHUNKS)


def test_empty_table(documents):
    assert exact_dedup(documents([(1, "a")]).limit(0)).count() == 0
