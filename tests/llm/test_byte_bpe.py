import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from meshlark.llm.byte_bpe import ByteBPE, PerfectHash, bpe_decode, bpe_encode, pre_tokens
from meshlark.llm.queries import op13_byte_bpe

ODD = ["It's they'll DON'T i'm 'sam ''s  's", " \n\n x\t\ty \r\n", "a\x1cb\x85c\xa0d e", "東京 タワー 3.14 ½²①", "🙂👩‍👩‍👧 \x00\x07 �", "<|endoftext|>", "z" * 3000, "'" * 7 + " " * 300]


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE()


@pytest.fixture(scope="module")
def library(bpe):
    ranks = {token: rank for rank, token in enumerate(bpe.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(bpe, library, texts):
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert np.frombuffer(ids, "i4").tolist() == library.encode_ordinary(text), repr(text[:80])


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = random.Random(1)
    for n in (1, 2, 5, 1000, 5003):
        keys = list({rng.randbytes(rng.randint(0, 6)) for _ in range(n)})
        made = PerfectHash(keys)
        assert made.find_all(keys).tolist() == list(range(len(keys))) == [made.find(k) for k in keys]
        assert sorted(made.slot_key) == list(range(len(keys)))
        strangers = [k + b"!" * 7 for k in keys]
        assert set(made.find_all(strangers)) == {-1} == set(map(made.find, strangers))


def test_every_character(bpe, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    same(bpe, library, ["".join(f"x{c} {c}1" for c in every[i : i + 512]) for i in range(0, len(every), 512)])


def test_random_texts(bpe, library):
    rng = random.Random(2)
    same(bpe, library, ODD + ["".join(rng.choice("ab'sstrevmlld'  \n\t1²é東 \x1c\x85\xa0!.-") for _ in range(rng.randint(0, 60))) for _ in range(5000)])


def test_long_pre_tokens_take_n_log_n(bpe, library):
    rng = random.Random(3)
    long = ["a" * 200_000, "".join(rng.choice("abcdefgh") for _ in range(200_000))]
    same(bpe, library, long)
    assert "".join(pre_tokens(long[1] + " é")) == long[1] + " é"


def test_round_trip(spark, documents, clashing, library):
    rng = random.Random(4)
    long = " ".join(rng.choice(["the", "Über", "cat,", "12"]) for _ in range(300_000))
    rows = list(enumerate(ODD)) + [(100, long), (101, None), (102, ""), (103, "same"), (103, "same"), (None, "no id")]
    encoded = bpe_encode(clashing(documents(rows)))
    key = lambda p: str(p[0])
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=key) == want
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in bpe_encode(documents(rows), with_bytes=True).collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    decoded = bpe_decode(clashing(encoded.withColumnRenamed("ids", "tokens")), ids_col="tokens")
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in decoded.collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)


def test_null_lists_bad_ids_and_empty_tables(spark, documents):
    lists = spark.createDataFrame([(1, None), (2, []), (3, [0, 1]), (4, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.bytes and bytes(r.bytes) for r in bpe_decode(lists.coalesce(1)).collect()} == {1: None, 2: bytearray(b""), 3: b'!"', 4: None}
    assert bpe_decode(bpe_encode(documents([]))).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe_decode(spark.createDataFrame([(1, [50256])], "doc_id bigint, ids array<int>")).collect()


def test_query_digests(spark, documents, library, tmp_path):
    rows = [*enumerate(ODD), (50, None)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_byte_bpe(spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
