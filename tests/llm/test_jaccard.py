from __future__ import annotations

import random
import re

import numpy as np
import pytest

from spiketide.llm import jaccard
from tests.llm import oracle
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


def grams(text: str | None) -> set[tuple]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows: list[tuple]) -> dict:
    sets = [(k, grams(t)) for k, t in rows if k is not None]
    up = {k: k for k, _ in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {k: top(k) for k in up}


def drawn(seed: int) -> list[tuple]:
    """Families of texts at all similarities around 0.8, beside a passage that all share."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(500)}"
    shared = [word() for _ in range(12)]
    rows: list[tuple] = []
    for _ in range(12):
        base = [word() for _ in range(draw.choice([3, 6, 20, 60, 120]))] + (shared if draw.random() < 0.7 else [])
        for _ in range(draw.randint(1, 9)):
            words = list(base)
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(len(words))] = word()
            rows.append((len(rows) * 3 % 1000, " ".join(words)))
    return rows


ODD = [(5000, None), (5001, ""), (5002, " \n"), (None, "a b c d e f"), (5003, "a b c d e f"), (5004, "A B c\td E f"), (5005, "one"), (5006, "ONE "),
       (5007, "x " * 60_000), (5007, "x " * 60_000), (5008, "x " * 59_000), (5009, "ß É"), (5010, "ß é"), (5011, "one"), (5011, "a b c d e f")]


@pytest.mark.parametrize("salt", [jaccard.SALT_LEVEL, -2])
def test_components(spark, monkeypatch, salt):
    monkeypatch.setattr(jaccard, "SALT_LEVEL", salt)
    monkeypatch.setattr(jaccard, "MEMBERS_PER_TASK", 2)
    rows = drawn(salt) + ODD
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, comp string, n int")
    got = jaccard.similar(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(k, want.get(k)) for k, _ in rows}
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(k), len(grams(t))) for k, t in rows)


def test_no_partial_count_of_links(spark):
    """60 near copies are all linked; a column that counts some of the links would be wrong."""
    rows = [(i, " ".join(f"w{k if k != i else 1000 + i}" for k in range(200))) for i in range(60)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_shingles", "component_id"}
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0) for i in range(60)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar(docs).collect() == []


def test_parity_is_a_lower_bound():
    draw = np.random.default_rng(1)
    for n in (1, 30, 33, 500):
        a = np.unique(draw.integers(0, 1 << 62, n).astype("u8"))
        b = np.unique(np.concatenate([a[: n - n // 4], draw.integers(0, 1 << 62, n // 3).astype("u8")]))
        assert jaccard.apart(jaccard.parity(a).tobytes(), jaccard.parity(b).tobytes()) <= len(np.setxor1d(a, b))
        assert jaccard.apart(jaccard.parity(a).tobytes(), jaccard.parity(a).tobytes()) == 0


def test_query(spark):
    assert oracle.compare(spark, connect(SF), "op8_ngram_jaccard", SF) == []
