"""Run queries beside their SQL in DuckDB.  CLI: python -m tests.oracle [-s SF] [names]"""

from __future__ import annotations

import sys
import time

import duckdb

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    return (v is None, str(type(v)), v if v is not None else 0)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [_key(v) for v in r])


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Differences between the plan and its SQL; empty when equal."""
    from spiketide import catalog

    df = catalog.PLANS[name](spark, sf_dir)
    cols = sorted(df.columns)
    types = dict(df.dtypes)
    got = _sorted(tuple(r[c] for c in cols) for r in df.collect())
    if name not in catalog.SQL:
        return [] if got else ["no rows"]
    rel = con.sql(catalog.SQL[name])
    problems = []
    if sorted(rel.columns) != cols:
        return [f"columns {cols} / {sorted(rel.columns)}"]
    otypes = dict(zip(rel.columns, map(str, rel.types)))
    for c in cols:
        if KINDS.get(types[c]) != otypes[c]:
            problems.append(f"type of {c}: {types[c]} / {otypes[c]}")
    at = [rel.columns.index(c) for c in cols]
    want = _sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    if not got:
        problems.append("no rows")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    return problems


def main(args: list[str]) -> int:
    from spiketide import catalog
    from spiketide.session import local_session

    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    sf_dir = f"{ROOT}/sf{sf}"
    spark, con, failed = local_session(8), connect(sf_dir), 0
    names = [n for n in catalog.PLANS if not args or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*") for a in args)]
    for n in names:
        t = time.time()
        try:
            problems = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(problems)
        tag = "ok  " if not problems else "FAIL"
        print(f"{tag} {n:28s} {time.time() - t:6.2f}s {'' if n in catalog.SQL else '(rows only)'} {problems or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)}")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
