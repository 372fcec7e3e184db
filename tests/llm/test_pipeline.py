import random

import corpus_pipeline
from meshlark.llm.common import materialize
from meshlark.llm.packing import SegmentEncoder

from .test_jaccard import brute_components
from .test_line_dedup import brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(11)
    words = {"en": "the and of that with this from which have were".split(), "de": "der die und nicht mit auch sich eine über für".split()}
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append((i, "\n".join(" ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(12)) for _ in range(4)), lang))
    out = list(rows)
    for i, t, lang in rows[:10]:
        out.append((100 + i, t.replace(" ", "  ", 1).rsplit(" ", 1)[0] + " changed", lang))
    for i in range(4):
        out.append((200 + i, f"unique opening number {i} of this text\nA shared line of boilerplate, long enough.\nand its end {i}", "en"))
    return [*out, (300, None, "en"), (301, "12345 -- 678", "en"), (302, "leaks: one two three four five six seven eight nine ten, and on", "en"), (303, "", None)]


def test_every_stage_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = {i: t for i, t, _ in rows}
    want = []
    now = {i: t for i, t in now.items() if t and any(map(str.isalpha, t))}
    want.append(dict(now))
    now = {i: kept for i, (_, _, kept) in brute_lines(now).items()}
    want.append(dict(now))
    comps = brute_components(list(now.items()))
    now = {i: t for i, t in now.items() if comps[i][1] == i}
    want.append(dict(now))
    now = {i: t for i, t in now.items() if i != 302}
    want.append(dict(now))
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == COLUMNS
        got = {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in docs.collect()}
        assert {i: x[0] for i, x in got.items()} == expected, name
        assert all(x[3] == len(x[0]) for x in got.values())
    assert 302 in want[2] and len(want[2]) < len(want[1]) and want[1][200] != want[0][200]
    ends = {i: len(SegmentEncoder(None).encode(t)) // 4 + 1 for i, t in now.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == ends and sum(r.length for r in pieces) == sum(ends.values())


DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, row string, component_id string, alt string"


def odd(spark, tmp_path, rows):
    spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return spark.createDataFrame([(i, t, "en", "src", 1, "x", "x", "x", "x") for i, t in rows], DDL).repartition(3)


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    leak, clean, other = "one two three four five six seven eight nine ten", "a clean text of a few words that nobody else has", "another clean text, not like any other of this table"
    rows = [(None, leak), (None, clean), (5, leak), (5, other), (6, None), (None, None)]
    got = corpus_pipeline.benchmark_leaks(spark, odd(spark, tmp_path, rows), str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(None, clean), (5, other), (6, None), (None, None)]))


def test_near_duplicates_of_odd_rows(spark, tmp_path):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (3, a), (3, a), (4, a), (None, a), (7, b), (7, a + " more"), (None, b + " x"), (None, "alone"), (None, "alone"), (8, None), (9, ""), (None, None), (None, None)]
    got = corpus_pipeline.near_duplicates(spark, odd(spark, tmp_path, rows), str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(3, a), (7, b), (None, "alone"), (8, None), (9, ""), (None, None)]))


def test_every_stage_takes_odd_rows_and_empty_tables(spark, tmp_path):
    text = "a text of some words that can be read"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (4, "½ ²"), (5, text + " again"), (6, " ".join(f"{text} {i}" for i in range(40_000)))]
    for docs in (odd(spark, tmp_path, rows), odd(spark, tmp_path, rows).limit(0)):
        empty = docs.limit(1).count() == 0
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == COLUMNS
        assert (docs.count() == 0) == empty
        assert (corpus_pipeline.packed(spark, docs, str(tmp_path)).count() == 0) == empty
