from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spiketide.llm import alignment
from spiketide.llm.token_counts import byte_letters

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


def brute(rows: list[tuple]) -> list[tuple]:
    """By the libraries on whole texts, with a walk over all ends."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = byte_letters()
    cut = []
    for key, text in rows:
        whole = (" " + (text or "")).encode()
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            cut.append((key, [], [], []))
            continue
        ends_a, ends_b = (dict(zip(np.cumsum([len(t) for t in ts]).tolist(), range(len(ts)))) for ts in (bytes_a, bytes_b))
        shared = sorted(ends_a.keys() & ends_b.keys())
        cut.append((key, a, b, [(ends_a[e], ends_b[e]) for e in shared]))
    counts = Counter((a[i], b[j]) for _, a, b, links in cut for i, j in links)
    best: dict = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for key, a, b, links in cut:
        groups, low = [], (0, 0)
        for i, j in links:
            groups.append(",".join(map(str, a[low[0] : i + 1])) + "|" + ",".join(map(str, b[low[1] : j + 1])))
            low = i + 1, j + 1
        found = [counts[a[i], b[j]] for i, j in links]
        n_best = sum(n == best[b[j]] for n, (_, j) in zip(found, links))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""
        out.append((key, len(a), len(b), len(links), len(links), n_best, sum(found), digest))
    return sorted(out, key=str)


def spark_rows(spark, rows: list[tuple], parts: int = 3) -> list[tuple]:
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for name in ("id", "chunk", "links", "groups", "pair", "count", "is_best", "n_a"):
        docs = docs.withColumn(name, F.lit("taken"))
    found = alignment.counted(alignment.align(docs, A, B))
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "tab\tand\nline\n"), (6, "a ▁b"), (7, "▁"), (8, "<|endoftext|> in <s> text</s>"),
    (9, "ﬁ ① é é 　 日本語のテキスト 😀"), (10, "it's we'll I'd 's"), (11, "\x00 \x1c x"), (None, "no id"), (None, "no id"), (12, "same"), (12, "same"),
    (13, "a" * 5000), (14, "1234567890 " * 300), (15, "<0x41> <unk>"), (16, "a b c​d"), (17, "\n\n lines \r\n"),
]


def test_odd_texts(spark):
    assert spark_rows(spark, ODD) == brute(ODD)


def test_empty_table(spark):
    assert spark_rows(spark, []) == []


def test_small_slices_pieces_and_chunks(spark, monkeypatch):
    text = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    aligner = alignment.Aligner(alignment.read_byte_level(A), alignment.read_pieces(B))
    want = brute(list(enumerate(text)))
    monkeypatch.setattr(alignment, "SLICE_CHARS", 300)
    monkeypatch.setattr(alignment, "MAX_WORDS", 50)
    got = []
    rows = [(k, t) for k, t in enumerate(text)]
    while rows:  # slices as the task makes them, with a tiny bound
        held, size = [rows.pop(0)], 0
        while rows and size + len(rows[0][1]) <= 300:
            size += len(rows[0][1])
            held.append(rows.pop(0))
        for key, parts, _ in alignment._parts(aligner, held):
            groups = b";".join(p.groups for p in parts)
            digest = hashlib.sha256(groups).hexdigest() if parts else ""
            got.append((key, sum(p.n_a for p in parts), sum(p.n_b for p in parts), sum(len(p.links) for p in parts), digest))
    assert sorted(got, key=str) == sorted(((w[0], w[1], w[2], w[3], w[7]) for w in want), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_given_documents(spark, parts):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert spark_rows(spark, rows, parts) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 200)), st.sets(st.integers(1, 200)), st.integers(1, 9))
def test_merge_path_pieces_find_all_common_ends(a, b, step):
    x, y = np.array(sorted(a), "i8"), np.array(sorted(b), "i8")
    i, j = alignment.common_ends(x, y, step)
    assert x[i].tolist() == y[j].tolist() == sorted(a & b)
    p, q = alignment.crossings(x, y, step)
    assert set(np.diff(p + q)[:-1].tolist()) <= {step}


@given(st.dictionaries(st.integers(0, 1 << 20), st.integers(1, 1 << 20)))
def test_packing(counts):
    idx = np.array(sorted(counts), "i8")
    n = np.array([counts[k] for k in idx.tolist()], "i8")
    again = alignment.unpack(alignment.pack(idx, n))
    assert [x.tolist() for x in again] == [idx.tolist(), n.tolist()]


def test_groups_are_kept_on_demand(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    rows = {r.id: r for r in alignment.align(docs, A, B, keep_groups=True).docs.collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256
    assert rows[2].groups == "" == rows[2].groups_sha256
