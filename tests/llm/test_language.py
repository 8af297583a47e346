from __future__ import annotations

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spiketide.llm import language
from spiketide.llm.queries import op12_language_id

DDL = "doc_id long, text string, lang string"


def brute_grams(text: str | None) -> Counter:
    """Grams by the definition, one character after the other."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
    if not any(unicodedata.category(c)[0] == "L" for c in (text or "").lower()):
        return Counter()
    s = " " + " ".join(words) + " "
    return Counter(g for n in (1, 2, 3) for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g != " ")


def listed(counts: Counter) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], g.encode()))[: language.PROFILE]


def brute(rows: list[tuple], learn) -> list[tuple]:
    by: dict[str, Counter] = {}
    for key, text, lang in rows:
        if key is not None and lang is not None and learn(key):
            by.setdefault(lang, Counter()).update(brute_grams(text))
    ranks = {x: {g: r for r, g in enumerate(listed(c))} for x, c in by.items() if c}
    out = []
    for key, text, _ in rows:
        own = listed(brute_grams(text))
        if not own or not ranks:
            out.append((key, "und", 0.0))
            continue
        away = {x: sum(abs(p[g] - k) if g in p else language.PROFILE for k, g in enumerate(own)) for x, p in ranks.items()}
        best = min(away, key=lambda x: (away[x], x.encode()))
        out.append((key, best, 1 - away[best] / (language.PROFILE * len(own))))
    return sorted(out, key=str)


def spark_rows(spark, rows: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame(rows, DDL)
    for name in ("id", "key", "language", "gram", "n", "rank", "k", "score", "lang_pred"):
        docs = docs.withColumn(name, F.lit("taken"))
    learned = language.profiles(docs, F.col("doc_id") % 2 == 0)
    return sorted((tuple(r) for r in language.predict(docs, learned).collect()), key=str)


ROWS = [
    (0, "The cat sat on the mat, and the dog ate it.", "en"), (2, "Der Hund und die Katze saßen auf der Matte.", "de"), (4, "", "fr"),
    (6, None, "fr"), (8, "12 345 !!", "fr"), (10, "不知道 说什么 好", "zh"), (1, "The dog and the cat", "en"), (3, "DIE KATZE UND DER HUND!!", None),
    (5, None, None), (7, "", "en"), (9, "€ 99 -- ..", "en"), (11, "好 说", "zh"), (13, "̈ ̈", "en"), (None, "the mat", "xx"), (None, "the mat", "xx"),
    (15, "the same", "en"), (15, "the same", "en"), (12, "the same", None), (17, "ét́ x\u0000y a_b", "en"), (19, "ab " * 40_000, "en"),
]


def test_odd_rows(spark):
    assert spark_rows(spark, ROWS) == brute(ROWS, lambda k: k % 2 == 0)


@pytest.mark.parametrize("rows", [[], [(1, "nothing learned", "en")]])
def test_nothing_to_learn_from(spark, rows):
    assert spark_rows(spark, rows) == brute(rows, lambda k: False)


def test_grams_in_blocks(monkeypatch):
    text = "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 7
    points = language.Letters.get().points(text)
    for block in (1 << 18, 1, 5, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        codes, n = language.grams(points)
        assert {language.text_of(c): k for c, k in zip(codes.tolist(), n.tolist())} == brute_grams(text)
        assert [language.text_of(c) for c in language.profile(codes, n)] == listed(brute_grams(text))


def test_sample_is_bounded_and_of_each_language(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 490, "big").otherwise("small").alias("lang"))
    got = Counter(r.language for r in language.sample(docs, F.lit(True), per_lang=20).collect())
    assert got == {"big": 20, "small": 10}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op12_language_id(spark, sf).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert [r.held_out for r in map(got.get, (r[0] for r in held))] == [True] * len(held)
    assert np.mean([got[k].lang_pred == lang for k, _, lang in held]) > 0.99
    want = brute(rows, lambda k: zlib.crc32(str(k).encode()) % 3 != 1)
    assert sorted(((r.doc_id, r.lang_pred, r.score) for r in got.values()), key=str) == want
