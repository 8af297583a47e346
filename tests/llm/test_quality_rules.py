from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from spiketide.llm import quality_rules as q
from tests.llm import oracle
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p for i, w in enumerate(windows) if w in twice for p in range(i, i + 5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def vector(text: str) -> list[int]:
    n, chars, symbols, dups, repeats, _ = brute(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    capitals = sum("A" <= c <= "Z" for c in text)
    shares = (chars + 100) / (n + 20), symbols / (chars + 50), dups / (len(lines) + 5), repeats / (n + 20), capitals / (chars + 50)
    return [min(q.TOP, int(1024 * s**0.5)) for s in shares]


def distances(v: np.ndarray) -> np.ndarray:
    """Concentration steps with whole matrices and an explicit inverse."""
    floors = np.diag(np.array(q.FLOORS, float) ** 2)
    centre = np.sort(v, axis=0)[(len(v) + 1) // 2 - 1].astype(float)
    cov = 4 * floors

    def measure():
        return np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(cov), v - centre)

    def estimate(rows, factor):
        return rows.mean(axis=0), factor * np.cov(rows.T, bias=True).reshape(q.N, q.N) + floors

    for _ in range(q.STEPS):
        bins = np.minimum(q.LAST_BIN, np.floor(np.sqrt(measure()) * q.BINS_PER_UNIT))
        border = np.sort(bins)[min(len(v), (len(v) + q.N + 1) // 2) - 1]
        centre, cov = estimate(v[bins <= border], q.HALF_FACTOR)
    inner = v[measure() <= q.INNER]
    if len(inner):
        centre, cov = estimate(inner, q.INNER_FACTOR)
    return measure()


def texts(seed: int) -> list[str]:
    draw = random.Random(seed)
    words = ["an", "the", "Hill", "river", "stone", "cloud", "walking", "under", "some", "Light"]
    plain = [" ".join(draw.choice(words) + draw.choice(["", "x", "yz", ".", "\n"]) for _ in range(draw.randint(10, 80))) for _ in range(30)]
    junk = [" ".join(f"{draw.choice(words).upper()}!! ###{k}" for k in range(20)) for _ in range(4)]
    return plain + junk


ODD = [None, "", " \n\t", "a b c d e f g h i", "one two three four five six seven eight nine ten " * 3, "x" * 70_000 + " a b c d e f g h i j k",
       "l one\nl one\n\n \nl two\nl one a b c d e f g é", "a\x0bb\fc\rd e f g h i j k l é😀"]


def test_counts_and_distances(spark):
    rows = [(i, t, lang, src, 1) for i, (t, lang, src) in enumerate(
        [(t, "en", "s") for t in texts(1)] + [(t, None, "s") for t in texts(2)] + [(t, "de", None) for t in ODD] + [(texts(3)[0], "xx", "one")])]
    rows += [(None, "short", "en", "s", 1), (3, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = q.rules(docs).collect()
    assert len(got) == len(rows)
    found: dict[tuple, list] = {}
    for key, text, lang, src, _ in rows:
        if not brute(text)[-1]:
            found.setdefault((lang, src), []).append((key, text))
    want = {}
    for members in found.values():
        for (key, _), d in zip(members, distances(np.array([vector(t) for _, t in members]))):
            want[key] = d
    by_id = {k: t for k, t, *_ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(by_id[r.doc_id])
        assert r.kept == (r.d2 is not None and r.d2 <= q.CUT)
        if r.base_failed:
            assert r.d2 is None
        else:
            assert abs(r.d2 - want[r.doc_id]) < 1e-6 * (1 + want[r.doc_id])
    assert not any(r.kept for r in got if r.doc_id is not None and 30 <= r.doc_id < 34)
    assert q.rules(docs.limit(0)).collect() == []


def test_query(spark):
    assert oracle.compare(spark, connect(SF), "op2_quality_rules", SF) == []
