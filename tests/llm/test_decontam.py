from __future__ import annotations

import random
import time

import pytest

from spiketide.llm import decontam
from tests.llm import oracle
from tests.oracle import connect

SF = "/root/testdata/sf0.001"
A = " ".join(f"w{i}" for i in range(14))


def brute(text: str | None, items: list[tuple]) -> tuple[int, set[int], set]:
    words = decontam.words_of(text)
    hit, found = set(), set()
    for key, item in items:
        for window in decontam.windows_of(decontam.words_of(item)):
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(key)
    return len(words), hit, found - {None}


ITEMS = [(1, A), (2, "short one"), (2, "short one"), (3, None), (4, "  ,. "), (None, "no id here"), (10, "Ünder the 12 the the the")]
DOCS = [
    (1, f"x {A.upper()} y"),
    (2, "a SHORT, one; short one one"),
    (3, None),
    (4, ""),
    (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8"),
    (6, f"{A} {A} short-one no id here"),
    (6, f"{A} {A} short-one no id here"),
    (None, "short one"),
    (7, "Ünder the 12 the the the the the the 12 the the the"),
    (8, "ab " * 30_000 + A),
    (9, "w0 w1 w2 w3 w4 w5 gap w6 w7 w8 w9 w10"),
]


@pytest.mark.parametrize("blocks", [10**6, 30])
@pytest.mark.parametrize("segment", [decontam.SEGMENT_WORDS, 5])
def test_small_cases(spark, monkeypatch, blocks, segment):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", segment)
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, items string, row int")
    bench = spark.createDataFrame([(*r, 3) for r in ITEMS], "item_id long, text string, doc_id int")
    got = decontam.contamination(docs, bench, block_chars=blocks).collect()
    want = sorted((str(k), *brute(t, ITEMS)) for k, t in DOCS)
    assert sorted((str(r.doc_id), r.n_words, {p for s in r.spans for p in range(s.start, s.end)}, set(r["items"])) for r in got) == want
    assert [r.near for r in got if r.doc_id == 9] == [[1]]
    assert all(len(set(r["items"])) == len(r["items"]) for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.report(decontam.contamination(none, bench)).collect() == []
    got = decontam.report(decontam.contamination(docs, bench.limit(0))).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)


def test_words_by_bytes():
    every = "".join(f"a{chr(c)}B " for c in [*range(0x300), 0x2028, 0x212A, 0x3000, 0xFFFD, 0x1F600])
    words = decontam.words_of(every)
    vocabulary = decontam.Vocabulary(sorted(set(words[::2])))
    known = {w: k for k, w in enumerate(sorted(set(words[::2])))}
    assert vocabulary.numbers(every.encode()).tolist() == [known.get(w, -1) for w in words]
    assert len(vocabulary.numbers(b"")) == len(vocabulary.numbers(None)) == 0


def test_words_cost_less_than_by_the_pattern():
    draw = random.Random(3)
    text = " ".join(f"W{draw.randrange(3000)}é," for _ in range(100_000))
    vocabulary = decontam.Vocabulary([f"w{k}é" for k in range(2000)])

    def least(run) -> float:
        times = []
        for _ in range(5):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        return min(times)

    data = text.encode()
    assert least(lambda: vocabulary.numbers(data)) < least(lambda: decontam._WORD.findall(text))


def test_query(spark):
    assert oracle.compare(spark, connect(SF), "op9_decontamination", SF) == []
