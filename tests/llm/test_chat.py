from __future__ import annotations

from spiketide.llm import chat
from tests.llm import oracle
from tests.oracle import connect

SF = "/root/testdata/sf0.001"

A = [("user", "hi"), ("assistant", "hello"), ("user", "more")]
LOGS = {
    1: A[:1],
    2: A[:2],
    3: A,
    4: A,
    5: [("assistant", "hi"), ("user", "hello")],
    6: [*A[:2], ("user", "other")],
    7: [(None, "hi"), ("user", None)],
    8: [("hi", None)],
    9: [("user", "x" * 50_000), ("user", "")],
    10: [("user", "say <|im_end|> é")],
    11: [("user", "")],
    12: [("user", None)],
}


def brute(logs: dict) -> dict:
    out = {}
    for key, turns in logs.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in logs.values())
        same = [k for k, o in logs.items() if o == turns]
        if not longer and key == min(same):
            shown = "".join(f"<|im_start|>{r or ''}\n{(t or '').replace('<|im_', '<|_im_')}<|im_end|>\n" for r, t in turns)
            out[key] = len(turns), len(same), shown
    return out


def test_snapshots_collapse(spark):
    rows = [(k, i, r, t, 1) for k, turns in LOGS.items() for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "nobody", 1), (13, None, "user", "b", 1), (13, None, "user", "b", 1), (13, None, "user", "a", 1)]
    logs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n_turns int").repartition(5)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(logs).collect()}
    assert got == brute(LOGS | {13: [("user", "a"), ("user", "b"), ("user", "b")]})
    assert set(got) == {3, 5, 6, 7, 8, 9, 10, 11, 12, 13}
    assert chat.format_chats(logs.limit(0)).collect() == []


def test_query(spark):
    assert oracle.compare(spark, connect(SF), "op1_chat_format", SF) == []
