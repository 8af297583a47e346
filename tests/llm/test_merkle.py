from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spiketide.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, n_chars, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes: list[str], at: int) -> tuple[str, list[tuple[str, str]]]:
    """Top over the nodes, and what stands left and right of the place ``at`` on each level."""
    path = []
    while len(nodes) > 1:
        low = at // 16 * 16
        path.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 16])))
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], path


def brute(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    subroots = [climb([leaf_of(r) for r in groups[s]], 0)[0] for s in names]
    out = []
    for i, s in enumerate(names):
        root, over = climb(subroots, i)
        leaves = [leaf_of(r) for r in groups[s]]
        for k, r in enumerate(groups[s]):
            path = climb(leaves, k)[1] + over
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                changed = (r[0], r[1].replace("A", "a").replace("B", "b"), *r[2:])
            top = leaf_of(changed)
            for left, right in path:
                top = digest(left, top, right)
            out.append((r[0], leaves[k], subroots[i], root, digest(*(x + y for x, y in path)), top))
    return sorted(out, key=str)


def spark_rows(spark, rows: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame(rows, DDL)
    for name in ("g", "digest", "lo", "hi", "path", "id", "total", "kids", "row", "at", "part", "bucket", "name"):
        docs = docs.withColumn(name, F.lit("taken"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "AB", "ab")).otherwise(F.col("text"))
    found = merkle.manifest(docs, FIELDS, changed={"text": tampered})
    found = found.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.col("changed"), F.col("path")))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_hot_group_many_groups_and_odd_rows(spark):
    rows = [(k, f"Text A {k}", "en", "hot", k) for k in range(300)]
    rows += [(k, f"B {k}", None, f"s{k % 40}", None) for k in range(90)]
    rows += [(7, "same", "en", "twice", 4)] * 3 + [(7, "other", "en", "twice", 4)]
    rows += [(None, None, None, None, None), (None, "", "", "", 0), (5, "ÄA\n", "ß", None, -3), (9, "é" * 50_000, "fr", "é", 1)]
    assert spark_rows(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_sizes_around_full_levels(spark, n):
    rows = [(k, "A" * (k % 3), "en", "one", k) for k in range(n)]
    assert spark_rows(spark, rows) == (brute(rows) if n else [])


def test_intervals_nest_and_cover(spark):
    leaves = spark.range(300).select(F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("key"))
    tree = merkle.build(merkle.label(leaves, ["key"]))
    assert len(tree.levels) == 4
    for low, high in zip(tree.levels, tree.levels[1:]):
        below = sorted((r.lo, r.hi) for r in low.collect())
        for node in high.collect():
            kids = [(k.lo, k.hi) for k in node.kids]
            assert kids == [b for b in below if node.lo <= b[0] and b[1] <= node.hi]
            assert (kids[0][0], kids[-1][1]) == (node.lo, node.hi)
