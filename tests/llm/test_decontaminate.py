import hashlib
import random
import re

import pytest

from meshlark.llm import decontaminate as module
from meshlark.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(rows, items):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    sizes, out = {len(k) for k in windows}, []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                its = windows.get(tuple(w[j : j + n]))
                if its:
                    hit.update(range(j, j + n))
                    found |= {str(x) for x in its if x is not None}
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.fixture
def case(spark, documents):
    rng = random.Random(6)
    common = ["the", "of", "a", "Élan", "élan", "x1", "東京"]
    item = lambda n: [rng.choice(common) if rng.random() < 0.7 else f"rare{rng.randrange(40)}" for _ in range(n)]
    items = [(k, " ".join(item(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for k in range(30)]
    items += [(30, None), (31, ""), (32, "..."), (33, items[3][1]), (None, "nobody counts this item though its words are all hit indeed"), (34, "solo"), (9, "two texts of one item id"), (35, "a a a a a a a a a a")]
    rows = []
    for i in range(80):
        w = item(rng.choice([0, 3, 30, 200]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = rng.choice(items)[1] or ""
            at = rng.randrange(len(w) + 1)
            w[at:at] = re.split(r"\s", part.upper() if rng.random() < 0.3 else part)
        rows.append((i, rng.choice([" ", ", ", "\n-- "]).join(w)))
    rows += [(100, None), (101, ""), (102, "solo"), (103, "nobody counts this item though its words are all hit indeed"), (104, "a " * 3000), (None, items[5][1]), (None, "clean"), (105, items[5][1]), (105, "other text")]
    return documents(rows), spark.createDataFrame(items, "item_id bigint, text string"), brute(rows, items)


def test_matches_brute_force(case, clashing):
    docs, items, want = case
    assert result(decontaminate(clashing(docs), items)) == want
    assert sum(w[5] for w in want) > 20


def test_benchmarks_too_large_to_broadcast_give_the_same(case, monkeypatch):
    docs, items, want = case
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert result(decontaminate(docs, items)) == want


def test_columns_are_carried_by_row(case):
    docs, items, want = case
    got = decontaminate(docs, items, carry=("text", "lang")).collect()
    known = [tuple(i) for i in items.collect()]
    assert all(r.contaminated == brute([(0, r.text)], known)[0][5] for r in got) and {r.lang for r in got} == {"en"}
    assert sum(r.doc_id is None and r.contaminated for r in got) == 1 and sorted(r.contaminated for r in got if r.doc_id == 105) == [False, True]


def test_very_long_text(spark, documents):
    text = "filler of some kind " * 100_000 + "one two three four five six seven eight nine ten " + "and more of it " * 50_000
    got = decontaminate(documents([(1, text), (2, None)]), spark.createDataFrame([("i", "One, two three four five six seven eight nine ten")], "item_id string, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_hit) for r in got} == {(1, 600_010, 10), (2, 0, 0)}


def test_empty_tables(case):
    docs, items, want = case
    assert decontaminate(docs.limit(0), items).count() == 0
    assert not any(r[5] for r in result(decontaminate(docs, items.limit(0))))


@pytest.mark.parametrize("rows,size", [(20, 1 << 30), (1000, 20_000)])
def test_more_windows_than_shingles_are_not_broadcast(spark, documents, monkeypatch, rows, size):
    """Two words make 4 word pairs, and hundreds of windows."""
    rng = random.Random(1)
    items = [(k, " ".join(rng.choice("ab") for _ in range(60))) for k in range(8)]
    docs = [(i, "x " + items[i % 8][1] + " y") for i in range(12)] + [(100, "a b a b"), (101, None)]
    monkeypatch.setattr(module, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(module, "BROADCAST_BYTES", size, raising=False)
    sent, broadcast = [], module.F.broadcast
    monkeypatch.setattr(module.F, "broadcast", lambda df: sent.append(df.columns) or broadcast(df))
    got = decontaminate(documents(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert ["shingle"] in sent and not [c for c in sent if "window" in c]
    assert result(got) == brute(docs, items)
