"""Routes over edges against brute force, with a hub of many edges and a unit that holds most rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spiketide.operators import routes
from spiketide.operators.ordered import CHUNK

EDGES = [0, 5, 10, 20]


def bins_of(times: list[int], t: int) -> list[int]:
    return [int(any(t + a <= x < t + b for x in times)) for a, b in zip(EDGES, EDGES[1:])]


def data(spark):
    draw = random.Random(9)
    # unit 4 answers most and is asked most; unit 9 never answers
    answers = [(4, draw.randrange(3000)) for _ in range(900)] + [(u, draw.randrange(3000)) for u in range(4) for _ in range(60)]
    triggers = [(k, draw.randrange(3000), 100 + k % 3, (4, 4, 9)[k % 3], k % 2) for k in range(150)]
    targets = [(100, 4, 1, 0), (100, 4, 2, 4), (101, 4, 1, 4), (102, 9, 1, 4), (102, 9, 2, 1)]
    return (
        triggers,
        targets,
        answers,
        spark.createDataFrame(triggers, "event long, t long, trigger long, receiver long, kind long"),
        spark.createDataFrame(targets, "trigger long, receiver long, slot int, unit long"),
        spark.createDataFrame(answers, "unit long, t long"),
    )


def test_joint_counts_with_a_hot_unit(spark):
    triggers, targets, answers, df_triggers, df_targets, df_answers = data(spark)
    times: dict = {}
    for u, t in answers:
        times.setdefault(u, []).append(t)
    want: dict = {}
    for _, t, trigger, receiver, kind in triggers:
        first = bins_of(times.get(receiver, []), t)
        for a, _, _, unit in targets:
            if a == trigger:
                second = bins_of(times.get(unit, []), t)
                for i, s1 in enumerate(first):
                    for j, s2 in enumerate(second):
                        want[kind, i, j, s1, s2] = want.get((kind, i, j, s1, s2), 0) + 1
    for width in (16, 100_000):
        got = routes.route_counts(df_triggers, df_targets, df_answers, EDGES, ["kind"], width)
        assert {tuple(r)[:5]: r.n for r in got.collect()} == want
    assert routes.route_counts(df_triggers.limit(0), df_targets, df_answers, EDGES, ["kind"], 16).collect() == []


def test_no_chunk_of_the_hot_unit_is_large(spark):
    _, _, _, triggers, targets, answers = data(spark)
    asks = triggers.join(targets, ["trigger", "receiver"]).select("unit", "t", "event")
    width = 64
    track = routes.answer_track(asks, answers, 3, width)
    axis = asks.select("unit", "t", F.explode(F.array(*map(F.lit, EDGES[:-1]))).alias("b")).select("unit", (F.col("t") + F.col("b")).alias("t"))
    sizes = track.cut(axis.unionByName(answers)).groupBy("unit", CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * width


def test_targets_of_a_hub(spark):
    pairs = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "trigger long, receiver long")
    hub = spark.range(100_000).select(F.lit(7).cast("long").alias("pre"), F.col("id").alias("post"))
    few = spark.createDataFrame([(8, 2), (8, 2), (8, 4), (8, 5), (9, 1)], "pre long, post long")
    same = F.col("post") % 2 == F.col("receiver") % 2
    got = routes.sampled_targets(pairs, hub.unionByName(few), 5, same, 3).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.trigger, []).append((r.slot, r.unit))
    assert {k: len(v) for k, v in by.items()} == {1: 5, 2: 5, 3: 2, 4: 1}
    assert all(u % 2 == 1 for _, u in by[1] + by[2]) and sorted(u for _, u in by[3]) == [2, 4]
    assert {u for _, u in by[1]} != {u for _, u in by[2]}
    again = routes.sampled_targets(pairs, hub.unionByName(few).repartition(9), 5, same, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_controls_are_members_and_drawn_afresh(spark):
    pool = spark.createDataFrame([(0, u) for u in range(0, 40) if u not in (3, 7, 8)] + [(1, 900)] + [(1, 900)], "side long, unit long")
    triggers = spark.createDataFrame([(k, k % 3) for k in range(900)], "event long, side long")
    rows = routes.drawn_controls(triggers, pool, "side", 5, width=8).collect()
    assert sorted(r.event for r in rows) == [k for k in range(900) if k % 3 < 2]  # side 2 has no members
    zero = [r.control for r in rows if r.side == 0]
    assert not {3, 7, 8} & set(zero) and len(set(zero)) == 37
    assert {r.control for r in rows if r.side == 1} == {900}
