"""Byte-level BPE: the tree's result is that of the library over the whole text, at any leaf and block size."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import frame

from skarn.llm.bpe_monoid import Codec, decode, encode, read_ranks

PIECES = ["a", "b", "the", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "'l", "l", "e", "r", "v", "é", "ü", "ß", "日本", "語", "😀", "1", "23", "!", "!!", "...", "　", "\t", "\r\n", "ing", "tion", "A", "\x1c", "\x85", "İ", "s", "t", "d", "m", "́", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return Codec(ranks, public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 40])
def test_any_cuts_give_the_whole_text_s_encoding(codec, leaf):
    rng = random.Random(leaf)
    codec.leaf = leaf
    for k in range(1500):
        pool = PIECES if k % 2 else rng.sample(PIECES, 4)
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(80)))
        raw, ids = codec.encode(text)
        assert ids == codec.base.encode_ordinary(text), text
        assert raw == text.encode() == codec.decode(np.array(ids, np.int32))


def test_join_is_associative(codec):
    rng = random.Random(5)
    of = lambda t: (t.encode(), codec.base.encode_ordinary(t))
    for _ in range(500):
        x, y, z = (of("".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))) for _ in range(3))
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z))


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 30_000, " " * 50_000, "\n" * 30_001 + "x", "日本語" * 20_000, "'re" * 20_000, "-=" * 20_000])
def test_long_runs_without_a_break(codec, text):
    codec.leaf = 512
    assert codec.encode(text)[1] == codec.base.encode_ordinary(text)


def test_every_token_is_its_own_encoding(codec):
    assert codec.unreachable() == []


def test_tables_with_odd_rows_and_texts_above_a_block(spark, odd, none, ranks, codec):
    found = decode(encode(odd, ranks, public_tokenizers.PATTERN, block=5000), ranks)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").encode(), codec.base.encode_ordinary(r["text"] or "")) for r in odd.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["decoded"]), r["ids"]) for r in found.collect()) == want
    assert decode(encode(none, ranks, public_tokenizers.PATTERN), ranks).collect() == []


def test_clashing_columns_are_not_read(spark, ranks):
    docs = frame(spark, [(1, "some text", "en", "a")]).withColumnRenamed("n_chars", "ids").withColumnRenamed("lang", "block").withColumnRenamed("source", "raw")
    assert [r.asDict() for r in encode(docs, ranks, public_tokenizers.PATTERN).collect()] == [{"doc_id": 1, "ids": [11246, 2420]}]


def test_query_on_the_smallest_tables(spark, codec):
    from skarn.llm.queries import op13_byte_bpe

    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = op13_byte_bpe(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = codec.base.encode_ordinary(texts[r["doc_id"]])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))
