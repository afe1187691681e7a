import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkrisk.llm import bpe
from sparkrisk.llm.queries import QUERIES, RANKS

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
TOKENS = bpe.load_ranks(open(PATH, "rb").read())
CODEC = bpe.Codec(TOKENS, PATTERN, bpe.newer_characters())
TIKTOKEN = tiktoken.Encoding("same", pat_str=PATTERN, special_tokens={}, mergeable_ranks={t: i for i, t in enumerate(TOKENS)})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "  ", "\n", " the", "tion", "'s", "éè", "՘", "aaaa"]))))
def test_same_ids_as_the_library_and_exact_round_trip(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = CODEC.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, "=" * 9_999, " " * 5_000 + "x", "xyzq" * 5_000, "͡" * 3000])
def test_long_pieces(text):
    assert CODEC.encode(text) == TIKTOKEN.encode_ordinary(text)


def test_small_vocabulary_needs_backtracking():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"bcd"]
    codec = bpe.Codec(tokens, r"[a-z]+")
    other = tiktoken.Encoding("t", pat_str=r"[a-z]+", special_tokens={}, mergeable_ranks={t: i for i, t in enumerate(tokens)})
    for word in ["abcd", "abcdabcbcd", "bcdabcd", "aabbccdd", "abcabcd"]:
        assert codec.encode(word, word_split=False) == other.encode_ordinary(word)


def test_memos_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 3)
    codec = bpe.Codec(TOKENS, PATTERN)
    text = "thinking about unthinkable reorderings of seldomly mentioned words, thinking"
    assert codec.encode(text) == TIKTOKEN.encode_ordinary(text)
    assert all(len(m) <= 3 for m in (*codec._words, *codec._pieces))


def test_odd_rows(odd_docs, no_docs):
    out = bpe.token_digests(odd_docs, PATH, PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    want = []
    for key, text in texts:
        ids = TIKTOKEN.encode_ordinary(text)
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert bpe.token_digests(no_docs, PATH, PATTERN).count() == 0


def test_columns_encode_and_decode(spark, odd_docs):
    ids = odd_docs.select("text", bpe.encode_ids(spark, F.col("text"), PATH, PATTERN).alias("ids"))
    back = ids.select("text", "ids", bpe.decode_ids(spark, F.col("ids"), PATH, PATTERN).alias("data")).collect()
    assert all(bytes(r.data) == (r.text or "").encode() and r.ids == TIKTOKEN.encode_ordinary(r.text or "") for r in back)


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
