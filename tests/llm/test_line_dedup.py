import hashlib
import random

import numpy as np

from meshlark.llm.line_dedup import Bloom, line_dedup

BLANKS = " \t\n\x0b\x0c\r"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line):
    return line.strip(BLANKS).translate(str.maketrans(UP, LOW))


def brute_lines(texts):
    """``{doc: (n_lines, n_dropped, kept)}`` for ``{doc: text}``."""
    held = {}
    for i, t in texts.items():
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, []).append(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (key(x) in gone and i != gone[key(x)])]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def corpus():
    rng = random.Random(4)
    pool = ["Exactly twenty chars", "exactly 19 charsss..", "EXACTLY TWENTY CHARS", " \t exactly twenty chars\r", "É" * 20, "é" * 20, "東京" * 10, "short", "", "  ", "a line of the pool that is long", "Another line; of the pool, long", "x" * 5000]
    texts = {i: "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"line {rng.random()} of its own" for _ in range(rng.choice([1, 2, 8, 40]))) for i in range(60)}
    return texts | {100: None, 101: "", 102: "\n\n", 103: "exactly twenty chars\nexactly twenty chars", 104: " exactly twenty chars"}


def test_matches_brute_force(documents, clashing):
    texts = corpus()
    got = line_dedup(clashing(documents(texts.items(), parts=5)), carry=("lang", "pos")).collect()
    want = {i: (n, d, hashlib.sha256(k.encode()).hexdigest(), k) for i, (n, d, k) in brute_lines(texts).items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256, r.kept_text) for r in got} == want
    assert sum(w[1] for w in want.values()) > 50 and {(r.lang, r.pos) for r in got} == {("en", "x")}


def test_null_and_repeated_ids(documents):
    line = "this line is long enough to count"
    rows = [(None, line), (1, line), (1, line), (None, "another line that is long enough"), (None, "another line that is long enough"), (None, "another line that is long enough")]
    got = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup(documents(rows)).collect())
    assert got == [("1", 0), ("1", 0), ("None", 0), ("None", 0), ("None", 0), ("None", 0)]
    more = [(1, line), (1, line), (2, line)]
    assert {r.n_dropped for r in line_dedup(documents(more)).collect()} == {0}
    more += [(3, line + "\n" + line), (None, line), (None, "its own")]
    got = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup(documents(more)).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 0), ("None", 0), ("None", 1)]


def test_very_long_texts_and_lines(documents):
    line, long = "a line that many documents hold", "y" * 1_000_000
    rows = {i: "\n".join([line] * 20_000 + [f"own {i} {long}", long]) for i in range(4)}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(documents(rows.items())).collect()}
    assert got == brute_lines(rows) and got[0][1] == 20_001


def test_empty_table(documents):
    assert line_dedup(documents([(1, "a")]).limit(0)).count() == 0


def test_bloom_filter_has_what_it_was_given():
    rng = np.random.default_rng(1)
    bloom, given, other = Bloom(10_000), rng.integers(0, 1 << 63, 10_000, dtype="u8"), rng.integers(0, 1 << 63, 10_000, dtype="u8")
    bloom.add(given)
    assert bloom.has(given).all() and bloom.has(other).mean() < 0.01
