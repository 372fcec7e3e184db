import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from meshlark.llm.langid import CENTROIDS, DIMS, _document_frequency, _fit_language, fit, identify, predict, spherical_kmeans
from meshlark.llm.packing import SegmentEncoder

SYLLABLES = {"en": "th ing er on the and wh ou ed ly".split(), "de": "sch ung ei ich der ü ver keit au ß".split(), "fr": "eau é tion ou è que aux ment ç la".split()}


def corpus(n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([3, 30, 200]))), lang if rng.random() < 0.9 else None, lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, t, lang, *_ in rows], "doc_id bigint, text string, lang string, source string").repartition(3)


def test_held_out_accuracy(spark, clashing):
    rows = corpus()
    truth = {i: x for i, _, _, x in rows}
    got = identify(clashing(frame(spark, rows)), per_language=60).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus(200)
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang, _ in rows]
    assert "xx" not in {r.lang_pred for r in identify(frame(spark, wrong)).collect()}


def test_odd_texts_and_rejection(spark):
    rows = corpus(200)
    model = fit(frame(spark, rows))
    odd = [(1, None), (2, ""), (3, "123 !? 🙂 ½ ² ① Ⅷ"), (4, "the thing"), (5, "ЖЖЖЖЖЖ ЪЪЪЪЪЪ"), (4, "the thing"), (None, "the thing"), (6, "the and " * 200_000)]
    got = {(r.doc_id, r.text): r for r in predict(frame(spark, [(i, t, None) for i, t in odd]), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in odd[:3])
    assert got[odd[3]].lang_pred == "en" and got[odd[7]].lang_pred == "en" and not got[odd[3]].rejected
    assert got[odd[4]].rejected and got[odd[4]].lang_pred in SYLLABLES


def test_rejection_tells_other_scripts_and_noise_from_short_clean_texts(spark):
    rows = corpus(600)
    model = fit(frame(spark, rows))
    rng = random.Random(2)
    foreign = ["".join(rng.choice("бвгджзклмн") for _ in range(n)) + " " + "".join(rng.choice("абвгдежз") for _ in range(n)) for n in (30, 100, 400)]
    noise = ["".join(rng.choice("qxzjkwv") + rng.choice("qxzjkv ") for _ in range(n)) for n in (40, 200, 1000)]
    clean = [" ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n)) for lang in SYLLABLES for n in (1, 2, 5, 20, 300) for _ in range(20)]
    texts = foreign + noise + clean
    got = {r.text: r.rejected for r in predict(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), model).collect()}
    assert all(got[t] for t in foreign + noise)
    assert sum(got[t] for t in clean) <= 0.01 * len(clean)


def test_many_labels(spark):
    rows = [(i, t, f"label{i}" if i % 3 == 0 else lang) for i, t, lang, _ in corpus(300)]
    model = fit(frame(spark, rows), languages=3)
    assert set(model.labels) == set(SYLLABLES)


def test_no_label_is_left_out_and_blocks_change_nothing(spark, monkeypatch):
    """230 labels, most with a few texts: all are learned, and comparing them in blocks gives the same answers."""
    import meshlark.llm.langid as module

    rng = random.Random(12)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{n:03d}": ["".join(rng.choice(alphabet) for _ in range(3)) for _ in range(6)] for n in range(230)}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(40)), lang, lang) for i, lang in enumerate(sorted(own) * 4)]
    model = fit(frame(spark, rows))
    trained = {lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(model.labels) == trained and len(trained) > 220
    answers = []
    for block in (1000, 64):
        monkeypatch.setattr(module, "BLOCK", block)
        got = {r.doc_id: r for r in predict(frame(spark, rows), model).collect()}
        answers.append({i: (r.lang_pred, round(r.score, 5), r.rejected) for i, r in got.items()})
    assert answers[0] == answers[1]
    assert np.mean([answers[0][i][0] == lang for i, _, lang, _ in rows if lang in trained]) > 0.97
    noise = frame(spark, [(1, "ЖЖЖЖЖЖ ЪЪЪЪЪЪ ЖЪЖЪЖЪ ЩЩЩЩЩ" * 5, None)])
    assert predict(noise, model).first().rejected  # few texts a language are enough to reject by


def test_document_frequencies_by_hand(spark):
    rows = corpus(80)
    model = fit(frame(spark, rows))
    train = [t for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 5]
    df = np.zeros(8192)
    for t in train:
        raw = b" " + t.lower().encode() + b" "
        df[list({(int.from_bytes(raw[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 19 for i in range(len(raw) - 2)})] += 1
    assert np.allclose(model.idf, np.log((1 + len(train)) / (1 + df)) + 1, atol=1e-6)


def test_nearest_centroid_by_definition(spark):
    """Predictions from the model's own numbers, one by one."""
    rows = corpus(120)
    model = fit(frame(spark, rows))
    for r in predict(frame(spark, rows), model).collect():
        if not r.text:
            continue
        raw = b" " + r.text.lower().encode() + b" "
        counts = np.zeros(8192)
        for i in range(len(raw) - 2):
            counts[(int.from_bytes(raw[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 19] += raw[i : i + 3] != b"   "
        v = np.log1p(counts) * model.idf
        near = model.centroids @ (v / np.linalg.norm(v))
        assert abs(near.max() - r.score) < 1e-4 and near[[x == r.lang_pred for x in model.labels]].max() > near.max() - 1e-5


def test_nothing_to_learn_from(spark):
    df = frame(spark, [(i, "some text", None) for i in range(5)])
    assert {(r.lang_pred, r.rejected) for r in identify(df).collect()} == {("und", True)}
    assert identify(df.limit(0)).count() == 0


def test_kmeans_finds_directions():
    x = np.repeat(np.eye(3, 8, dtype="f4"), 5, axis=0)
    assert sorted(np.argmax(spherical_kmeans(x, 3), axis=1)) == [0, 1, 2]
    assert len(spherical_kmeans(x[:2], 3)) == 2


def test_a_language_is_fitted_in_one_copy_of_its_vectors():
    """A thousand vectors take 32 MB; a few copies of them at once in each worker add up to more than an executor has."""
    sample = pd.DataFrame({"text": [t for _, t, *_ in corpus(1000)], "lang": "en"})
    run = _fit_language(np.ones(DIMS, "f4"), CENTROIDS)
    tracemalloc.start()
    try:
        assert len(run(sample)) == CENTROIDS
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()


def test_workers_let_go_of_what_packing_remembers():
    kept = SegmentEncoder.of_worker(None)
    assert SegmentEncoder.of_worker(None) is kept
    assert len(list(_document_frequency(iter([pa.RecordBatch.from_pydict({"text": ["some text"]})])))) == 1
    assert SegmentEncoder.of_worker(None) is not kept


def test_columns_keep_their_order_and_texts(spark):
    rows = [(1, "the thing and other", "en"), (2, None, None), (3, "", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(frame(spark, corpus(100)))
    out = predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    assert sorted(tuple(r)[:3] for r in out.collect()) == rows
    assert sorted(str(r.text) for r in predict(df.select("text"), model).collect()) == sorted(str(t) for _, t, _ in rows)
