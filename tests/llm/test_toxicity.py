from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spiketide.llm import queries, toxicity
from spiketide.llm.frames import load

SF = "/root/testdata/sf0.1"


def corpus(n: int) -> tuple[list[tuple], list[tuple]]:
    """One sentence of a toxic text holds a bad word, in one of many endings."""
    draw = random.Random(2)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("san", "dor", "vel", "pim", "gus")]
    rows, labels = [], []
    for i in range(n):
        sentences = [[draw.choice(plain) for _ in range(draw.randint(3, 9))] for _ in range(draw.randint(1, 8))]
        if toxic := i % 4 == 0:
            sentences[draw.randrange(len(sentences))][1] = "zorgul" + draw.choice("abcdefghij") + str(draw.randrange(30))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", "x", 0.5))
        labels.append((i, int(toxic)))
    return rows, labels


ODD = [(5001, None), (5002, ""), (5003, " ..!\n"), (None, "zorgula1 here."), (5004, "kasan lodor. " * 20_000 + "you zorgulb2!"), (5004, "kasan"), (5004, "kasan")]


def test_learns_and_locates(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows + [(*r, None, None) for r in ODD], "doc_id long, text string, toxic string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (5001, None), (5002, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") < 300)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    texts = {r[0]: r[1] for r in rows}
    held = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 98
    spotted = [texts[r.doc_id][s.start : s.end] for r in held if r.predicted for s in r.offending]
    assert spotted and all("zorgul" in s for s in spotted)
    odd = {(r.doc_id, r.predicted, len(r.offending)) for r in got if r.doc_id is None or r.doc_id > 5000}
    assert odd == {(5001, 0, 0), (5002, 0, 0), (5003, 0, 0), (None, 1, 1), (5004, 1, 1), (5004, 0, 0)}


def test_without_labels(spark):
    rows, labels = corpus(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.limit(0), F.lit(True))
    assert all(r.predicted == 0 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_noisy_or():
    scorer = toxicity.Scorer(["bad", "worse"], [5.0, 9.0], -4.0)
    p, found = scorer.score("so bad. fine\nworse bad!")
    each = [1 / (1 + math.exp(-s)) for s in (1.0, -4.0, 10.0)]
    assert np.isclose(p, 1 - math.prod(1 - x for x in each))
    assert [(a, b) for a, b, _ in found] == [(0, 6), (13, 22)]


def test_held_out(spark):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, SF).collect()}
    assert len(got) == load(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in load(spark, SF, "labels").collect() if got[r.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.96
    assert sum(p == 1 for p, y in held if y) / sum(y for _, y in held) > 0.75
