"""Compare a text query with its SQL. CLI: python -m tests.llm.oracle SF name*"""

from __future__ import annotations

import sys
import time

from tests.oracle import ROOT, _sorted, connect


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    from spiketide.llm.queries import QUERIES, SQL

    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in cols) for r in df.collect())
    rel = con.sql(SQL[name])
    if sorted(rel.columns) != cols:
        return [f"columns {cols} / {sorted(rel.columns)}"]
    at = [rel.columns.index(c) for c in cols]
    want = _sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    problems = [f"rows {len(got)} / {len(want)}"] if len(got) != len(want) or not got else []
    if bad := [(g, w) for g, w in zip(got, want) if g != w]:
        problems.append(f"{len(bad)} rows differ, first {bad[:3]}")
    return problems


if __name__ == "__main__":
    from spiketide.session import local_session

    sf, *names = sys.argv[1:]
    session, db = local_session(8), connect(f"{ROOT}/sf{sf}")
    print(session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    for n in names:
        t = time.time()
        print(n, compare(session, db, n, f"{ROOT}/sf{sf}"), round(time.time() - t, 1), flush=True)
