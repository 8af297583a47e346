from __future__ import annotations

import hashlib
import math
import struct

import public_tokenizers
import tiktoken

import corpus_pipeline
from spiketide.llm import bpe, ranking
from spiketide.llm.frames import load
from tests.llm import test_decontam, test_jaccard, test_secrets

SF = "/root/testdata/sf0.001"


def masked(text: str) -> str:
    out, at = "", 0
    for start, _, end in test_secrets.brute(text)[1]:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def brute(spark, rows: list[tuple], fitted: ranking.Ranking, items: list[tuple]) -> dict:
    def good(text) -> bool:
        raw = sum(a * b for a, b in zip(ranking.features_of(text), fitted.weights))
        return 1 / (1 + math.exp(fitted.threshold - math.log(3 / 7) - raw)) >= 0.3

    rows = [r for r in rows if good(r[1])]
    top = test_jaccard.brute(rows)
    rows = list(dict.fromkeys(r for r in rows if top[r[0]] == r[0]))
    rows = [(k, t) for k, t in rows if not test_decontam.brute(t, items)[1]]
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.TOKENS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for key, text in rows:
        text = masked(text or "")
        ids = library.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        out[key] = len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), packed
    return out


def test_run_as_brute_force(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    fitted = ranking.fit(docs, labels, ranking.crc("doc_id") % 5 != 0)
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    want = brute(spark, [(r.doc_id, r.text) for r in docs.collect()], fitted, items)
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) < docs.count()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got} == want and len(got) == len(want)


def test_unlike_texts_of_one_id(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    leak = load(spark, SF, "benchmark").filter("length(text) > 80").first().text
    rows = [(7, text("a")), (7, text("b")), (7, text("b")), (3, text("b") + " more"), (8, text("c")), (9, text("c") + " more"), (9, text("d")), (5, text("e")), (5, text("e") + " more")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    first = sorted((r.doc_id, r.text.split()[0]) for r in got)
    assert first == [(3, "b0"), (5, "e0"), (7, "a0"), (8, "c0"), (9, "d0")]
    leaky = spark.createDataFrame([(7, text("a"), "en", "s", 1), (7, leak, "en", "s", 1)], docs.schema)
    assert [r.text for r in corpus_pipeline.drop_contaminated(spark, leaky, SF).collect()] == [text("a")]


def test_odd_rows_in_every_stage(spark):
    real = load(spark, SF, "documents")
    plain = next(r.text for r in real.collect() if r.n_chars > 500)
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, plain, "en", "s", 9), (None, None, None, None, None),
            (3, plain + " password=abcdefgh12 end", "en", "s", 9), (4, plain[: len(plain) // 2], "en", "s", 9), (4, plain[: len(plain) // 2], "en", "s", 9), (5, "ab cd " * 30_000, "en", "s", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0), odd.unionByName(real.limit(5))):
        for name, fn in corpus_pipeline.STAGES[1:]:
            out = fn(spark, docs, SF)
            if fn is not corpus_pipeline.tokens:
                assert out.columns == real.columns, name
            n = out.count()
            assert n <= docs.count()
            if fn in (corpus_pipeline.mask_secrets, corpus_pipeline.tokens):
                assert n == docs.count()
    kept = corpus_pipeline.one_of_each_group(spark, odd, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4", "5", "None", "None"]
    shown = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, odd, SF).collect()}
    assert shown[3].text.endswith(" [SECRET] end") and shown[3].n_chars == len(shown[3].text) and shown[1].text is None
    good = corpus_pipeline.keep_good(spark, real, SF)
    assert good.columns == real.columns and 0 < good.count() < real.count()
