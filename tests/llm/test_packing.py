import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshlark.llm import packing
from meshlark.llm.packing import Memo, SegmentEncoder, pack, piece_lengths

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = [
    "It's they'll DON'T i'm 'sam ''s", "a\x1cb\x1f c\x85d\xa0e f", "ΑΣ ΟΔΟΣ ΣΣ. İstanbul ſt Kelvin", "é ́x Å ŀ",
    "<|endoftext|> x<|startoftext|>y <|end", "東京 タワー 3.14 ½ ² ①", "🙂👩‍👩‍👧 \x00\x07 �﻿", "100,000 a_b-c--d \t\t\n\r\n\x0b\x0c z", "  lead trail  ", "'", "''", "ǅ ǆ ﬁ",
]


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_segments_give_the_tokenizers_ids():
    encoder = SegmentEncoder(None)
    rng = random.Random(3)
    alphabet = "ab'sSTtREe 1. -\n\tÉéß́Σ<|>\x0b\x1c 東"
    for text in [*ODD, *("".join(rng.choice(alphabet) for _ in range(60)) for _ in range(600))]:
        for _ in range(2):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(text), repr(text)


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12_289, 1_000_003])
def test_piece_lengths(n):
    got = piece_lengths(n)
    assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 4096 for x in got)


def test_round_trip(documents, clashing):
    rng = random.Random(1)
    long = " ".join(rng.choice(["the", "Über", "cat,", "12"]) for _ in range(9000))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, long), (101, None), (102, ""), (103, "same"), (103, "same"), (None, "no id")]
    got = pack(clashing(documents(rows))).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by = {}
    for r in got:
        assert r.length == len(r.ids) == 1 << r.bucket <= 4096 and r.offset == 0
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, _ in rows}
    for i, t in rows:
        want = ids(t or "") + [2]
        parts = sorted(by[i], key=lambda r: r.start)
        assert all(r.doc_tokens == len(want) for r in parts)
        if i == 103:
            assert sorted(r.start for r in parts) == sorted(2 * [s.start for s in parts[::2]])
        else:
            assert [x for r in parts for x in r.ids] == want and [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])


def test_empty_table_and_bad_length(documents):
    df = documents([(1, "a")])
    assert pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(df, longest=1000)


def test_shortcuts_follow_the_tokenizers_settings_not_its_name(tmp_path):
    """A copy under another name is cut the same way; another tokenizer under the usual name isn't."""
    import shutil

    copy, other = f"{tmp_path}/own.json", f"{tmp_path}/word_bpe_49k.json"
    shutil.copy(public_tokenizers.path("word_bpe_49k.json"), copy)
    shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), other)
    assert SegmentEncoder(copy).cut and not SegmentEncoder(other).cut
    text = "Two  words, and\nmore"
    assert np.frombuffer(SegmentEncoder(other).encode(text), "<u4").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


def test_texts_cut_at_any_place_and_every_plain_character(monkeypatch):
    for name, size in (("SLICE", 7), ("CUT", 30), ("CHUNK", 90)):
        monkeypatch.setattr(packing, name, size)
    encoder, rng = SegmentEncoder(None), random.Random(1)
    plain = [c for c in map(chr, range(33, 0x3000)) if encoder.is_plain(c)]
    tables = [[f"{c} x{c}{c}y 1{c}2 '{c} {c}'s '{c}t -{c}é" for c in plain], [], ["", "\n \t", ""]]
    usual, odd = "''sStTrReEvVlLmMdD 19.-\n\téЖ“’€Бß", "東\x0b\u0301\0"
    for _ in range(200):
        tables.append(["".join(rng.choice(odd if rng.random() < 0.05 else usual) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(20))])
    for texts in tables:
        for text, got in zip(texts, encoder.encode_all(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids(text), repr(text)


def many_words(n):
    rng = random.Random(2)
    return " ".join("".join(rng.choice("abcdefghié") for _ in range(9)) + "," for _ in range(n))


def test_plain_words_skip_the_tokenizers_own_cutting():
    class Counting:
        def __init__(self, made):
            self.made, self.calls = made, 0

        def encode(self, *args, **more):
            self.calls += 1
            return self.made.encode(*args, **more)

    encoder, text = SegmentEncoder(None), many_words(500)
    encoder.tokenizer = Counting(encoder.tokenizer)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(text)
    assert encoder.tokenizer.calls == 0


def test_a_worker_keeps_no_plain_words():
    """Each of an executor's idle workers keeps what it remembers; before, that was all words of its tasks, up to 1.6 million."""
    encoder, text = SegmentEncoder(None), many_words(100_000)
    tracemalloc.start()
    try:
        ids = len(encoder.encode(text)) // 4
        kept, most = tracemalloc.get_traced_memory()
        assert ids > 100_000 and kept < 2e6 and most < 60e6
    finally:
        tracemalloc.stop()


def test_memory_is_bounded_in_bytes():
    memo = Memo(str.encode, room=1_000_000)
    tracemalloc.start()
    try:
        for i in range(1000):
            assert memo[f"{i} " + "x" * 5000] == f"{i} ".encode() + b"x" * 5000
        assert memo["y" * 2_000_000] == b"y" * 2_000_000
        assert tracemalloc.get_traced_memory()[0] < 2_200_000
    finally:
        tracemalloc.stop()
