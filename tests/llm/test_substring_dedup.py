import hashlib
import random

import pytest

from meshlark.llm import substring_dedup as module
from meshlark.llm.substring_dedup import FingerprintIndex, substring_dedup


def brute(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        for j in range(len(w) - 19):
            seen.setdefault(tuple(w[j : j + 20]), (i, j))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if seen[tuple(w[j : j + 20])] != (i, j):
                gone[j : j + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passages = [words(n) for n in (19, 20, 21, 60, 200)]
    rows = []
    for i in rng.sample(range(1000), 60):
        w = words(rng.choice([0, 5, 19, 40, 300]))
        for _ in range(rng.choice([0, 1, 1, 3])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    # Repeats inside one text, overlapping themselves too.
    return rows + [(2000, "tick " * 100), (2001, "tick tock " * 40), (2002, " ".join(passages[3] * 3)), (2003, None), (2004, ""), (2005, "Über straße " * 30)]


def outcome(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in df.collect()}


@pytest.mark.parametrize("seed,cuts", [(1, ()), (2, module.CUTS)])
def test_matches_brute_force(documents, clashing, seed, cuts):
    rows = corpus(seed)
    assert outcome(substring_dedup(clashing(documents(rows, parts=5)), batch_cuts=cuts)) == brute(rows)


def test_index_is_reopened_for_every_batch_and_compacts(spark, documents, tmp_path):
    rows = corpus(3)
    path, got, history, most = f"{tmp_path}/index", {}, [], 0
    for low in range(0, 3000, 400):
        batch = [(i, t) for i, t in rows if low <= i < low + 400]
        index = FingerprintIndex(spark, path, fragments=8)
        assert low == 0 or index.version > 0
        got |= outcome(substring_dedup(documents(batch), index, documents(history) if history else None))
        history += batch
        most = max(most, len(index.runs))
        assert len(index.runs) <= module.MAX_RUNS
    assert got == brute(rows) and most == module.MAX_RUNS and index.version > 8


def test_history_is_earlier_whatever_its_ids(spark, documents):
    words = [f"v{i}" for i in range(60)]
    index = FingerprintIndex(spark)
    index.dedup(documents([(500, " ".join(words[:40]))]).selectExpr("doc_id AS doc", "text"))
    got = outcome(substring_dedup(documents([(1, " ".join(words)), (2, " ".join(words[30:]))]), index, documents([(500, " ".join(words[:40]))])))
    assert got[1][3] == " ".join(words[40:]) and got[2][1] == 30


def test_ids_with_several_texts_and_ids_that_come_again(spark, documents, tmp_path):
    """Batch by batch against one index: a document is its id and its text, whatever else has that id."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, b, six = words("a", 30), words("b", 25), "only six words are in here"
    path = f"{tmp_path}/index"
    first = [(1, a), (2, words("c", 40))]
    substring_dedup(documents(first), FingerprintIndex(spark, path, fragments=8)).collect()
    second = [(4, a), (5, a), (5, b), (5, six), (1, b + " tail"), (None, a)]
    got = substring_dedup(documents(second), FingerprintIndex(spark, path), documents(first)).collect()
    removed = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got)
    # Of b, the smaller id is earlier: (1, b + tail) keeps it, (5, b) loses it.
    assert removed == [("1", 26, 0), ("4", 30, 30), ("5", 6, 0), ("5", 25, 25), ("5", 30, 30), ("None", 30, 0)]
    third = [(9, b), (9, "new " + six + " " + words("c", 40)), (2, words("d", 22))]
    got = substring_dedup(documents(third), FingerprintIndex(spark, path), documents(first + second)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(2, 22, 0), (9, 25, 25), (9, 47, 40)]
    assert substring_dedup(documents([]), FingerprintIndex(spark, path), documents(first + second + third)).count() == 0


def test_index_grows_into_more_fragments(spark, documents, monkeypatch):
    monkeypatch.setattr(module, "FRAGMENT_ROWS", 50)
    rows = corpus(5)
    index = FingerprintIndex(spark, fragments=2)
    base = documents(rows).selectExpr("doc_id AS doc", "coalesce(text, '') AS text")
    index.dedup(base.where("doc < 300"))
    index.dedup(base.where("doc >= 300 AND doc < 600"), base)
    index.compact()
    index.dedup(base.where("doc >= 600 AND doc < 800"), base)
    index.compact()
    assert index.fragments > 2 and len(index.runs) == 1
    index.fragments *= 2  # runs are cut anew as they are read
    got = outcome(substring_dedup(documents([r for r in rows if r[0] >= 800]), index, documents(rows)))
    want = brute(rows)
    assert got == {i: want[i] for i, _ in rows if i >= 800}


def test_equal_hashes_of_different_words_remove_nothing(documents, monkeypatch):
    real = module.windows
    monkeypatch.setattr(module, "windows", lambda words, size: real(words, size) % module.np.uint64(7) if size == 20 else real(words, size))
    rows = corpus(6)
    want = brute(rows)
    got = outcome(substring_dedup(documents(rows), batch_cuts=[0.5]))
    assert all(got[i][1] <= want[i][1] for i, _ in rows) and any(w[1] for w in want.values())


def test_long_text(documents):
    rng = random.Random(2)
    long = [f"w{rng.randrange(3000)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[5000:90_000] + ["x"] + long[:100])), (3, " ".join(long[::-1]))]
    assert outcome(substring_dedup(documents(rows), batch_cuts=[0.5])) == brute(rows)


def test_null_and_repeated_ids(documents):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text)]
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup(documents(rows), batch_cuts=[0.5]).collect()) == [("1", 0), ("1", 0), ("2", 30), ("None", 0)]
    assert substring_dedup(documents(rows).limit(0)).count() == 0
    other = " ".join(f"o{i}" for i in range(25))
    rows = [(1, text), (5, text), (5, other), (None, other)]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup(documents(rows), batch_cuts=[0.5]).collect()) == [("1", 30, 0), ("5", 25, 0), ("5", 30, 30), ("None", 25, 0)]


def test_no_two_passes_have_to_agree_on_batches(documents, monkeypatch):
    """Every pass over the candidates cuts its rows in another way, as after the loss of an executor."""
    make, passes = module._candidate_windows, []

    def cut(*args):
        run, rows = make(*args), 1 if passes else 1_000_000
        passes.append(rows)
        return lambda batches: run(part for b in batches for part in (b.slice(at, rows) for at in range(0, b.num_rows, rows)))

    monkeypatch.setattr(module, "_candidate_windows", cut)
    rows = corpus(4)
    got = substring_dedup(documents(rows), batch_cuts=[0.5]).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got} == brute(rows)


def test_more_later_windows_than_a_row_carries(documents):
    text = " ".join(f"v{i}" for i in range(700))
    rows = [(i, text) for i in range(40)]
    got = substring_dedup(documents(rows, parts=2), batch_cuts=()).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got} == brute(rows)
