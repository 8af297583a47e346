from __future__ import annotations

import itertools
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from spiketide.llm import bpe, queries, token_counts
from spiketide.llm.frames import load

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPEC = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n: int) -> list[str]:
    draw = random.Random(5)
    letters = "ab cd  \n\t\x85\xa0\x1c'sd'll12½²éñÑ中文😀 　.,!?\x00\x7f"
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(n)]
    return made + ["", " ", "  ", "a" * 5000, "ab " * 3000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]


def test_hash_is_minimal_and_perfect(ranks):
    keys = list(ranks)[:3000]
    table = bpe.MinimalPerfectHash(keys)
    assert sorted(table.at) == list(range(len(keys)))
    assert [table.find(k) for k in keys] == list(range(len(keys)))
    assert all(table.find(k) == -1 for k in list(ranks)[3000:6000])
    assert bpe.MinimalPerfectHash([]).find(b"a") == -1
    assert bpe.MinimalPerfectHash([b"one"]).find(b"one") == 0


def test_encode_as_the_library(spark, ranks, library):
    texts = odd_texts(400)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(7, texts[7], "x", "y"), (None, "ab", None, None), (901, None, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    shared = bpe.share(docs, ranks, public_tokenizers.PATTERN)
    got = bpe.decode(bpe.encode(docs, shared), shared).collect()
    assert len(got) == len(rows)
    for (key, text, *_), out in zip(rows, got):
        ids = library.encode_ordinary(text or "")
        assert (out.doc_id, bytes(out.ids)) == (key, struct.pack(f"<{len(ids)}I", *ids))
        assert bytes(out.decoded) == (text or "").encode()


def test_counts_as_the_library(spark):
    library = Tokenizer.from_file(SPEC)
    texts = odd_texts(400)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 2), (3, texts[3], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.token_counts(docs, SPEC, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for (key, text, _), out in zip(rows, got):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert tuple(out) == (key, len((text or "").encode()), n, n > 512)


def test_empty_tables(spark, ranks):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(docs, ranks, public_tokenizers.PATTERN).collect() == []
    assert token_counts.token_counts(docs, SPEC, public_tokenizers.PATTERN).collect() == []


def test_memo_forgets_and_stays_right(ranks, library):
    tokens = list(ranks)
    codec = bpe.Encoder(tokens, [ranks[t] for t in tokens], bpe.MinimalPerfectHash(tokens), public_tokenizers.PATTERN)
    codec.known.bound = codec.known.words.bound = 3
    for text in ["the the and of the and a b c d e f g the", *odd_texts(30)]:
        ids = library.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_queries(spark, library):
    texts = {r.doc_id: r.text or "" for r in load(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in queries.op5_bpe_codec(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = library.encode_ordinary(text)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    counter = Tokenizer.from_file(SPEC)
    for r in queries.op6_token_counts(spark, SF).collect():
        assert r.n_tokens == len(counter.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_pieces_of_many_texts_are_remembered():
    tokens = [bytes([b]) for b in range(256)]
    encoder = bpe.Encoder(tokens, list(range(256)), bpe.MinimalPerfectHash(tokens), r" ?\p{L}+")
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 150_000)]
    first = encoder.encode(" ".join(words))
    made = []
    keep = encoder.known.make
    encoder.known.make = lambda piece: made.append(piece) or keep(piece)
    assert encoder.encode(" ".join(words)) == first and not made
