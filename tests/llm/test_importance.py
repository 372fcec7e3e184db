import hashlib
import math
import random
import re
import zlib

from meshlark.llm.importance import Shifts, hashed_runs, importance_sample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(run):
    return zlib.crc32(run.encode()) % 10000


def brute(rows, target):
    s, t = [0] * 10000, [0] * 10000
    for texts, n in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            for f in runs(text)[1]:
                n[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out, fit = [], []
    for doc, text in rows:
        n, found = runs(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        row = [doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        fit += [row] * (n >= 20)
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, row in enumerate(fit[: 5 * len(fit) // 100], 1):
        row[4] = i
    return sorted(map(str, out))


def got(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


def test_run_hashes_are_those_of_the_joined_words():
    rng, shifts = random.Random(1), Shifts()
    texts = ["".join(rng.choice("abcXYZ09 -.\né東") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", "a" * 1000 + " b " + "c" * 100_000 + " d"]
    n_words, n_runs, buckets = hashed_runs([t.encode() for t in texts], shifts)
    at = 0
    for text, words, n in zip(texts, n_words, n_runs):
        assert (words, n) == (runs(text)[0], len(runs(text)[1]))
        assert sorted(buckets[at : at + n]) == sorted(map(bucket, runs(text)[1]))
        at += n
    assert at == len(buckets)


def test_against_brute_force(spark, documents, clashing):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "CAT", "d'accord", "東京"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    same = text(30)
    rows = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(i, same) for i in range(300, 500)]
    rows += [(500, None), (501, ""), (502, "?!"), (503, text(5000)), (7, same), (7, same), (None, same), (None, text(25))]
    target = [text(12) for _ in range(20)] + ["CAT 東京 cat", None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    assert got(importance_sample(clashing(documents(rows)), clashing(items))) == brute(rows, target)


def test_ties_go_to_the_smaller_id(documents):
    """Without a target and with one text, scores follow noise alone; rows with one id tie."""
    rows = [(i % 50, "a b " * 20) for i in range(400)]
    out = importance_sample(documents(rows), documents([]))
    assert got(out) == brute(rows, [])
    assert sorted(r["rank"] for r in out.collect() if r["rank"]) == list(range(1, 21))


def test_few_and_empty(documents):
    few = documents([(1, "one two"), (2, None)])
    assert got(importance_sample(few, few.limit(0))) == brute([(1, "one two"), (2, None)], [])
    empty = importance_sample(few.limit(0), few)
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank"] and not empty.collect()
