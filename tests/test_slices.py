"""Scans in time slices against plain loops, and the windows of their plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratalens.functions import slices
from stratalens.operators import clients, latency, samples

S = 1_000_000_000


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(slices, "BLOCK", 4)


def history(spark, seed, n=400, span=5000):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.randrange(-span, span), i, rng.choice([None, rng.randrange(9)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at long, i long, v long")


def test_running_sum_over_blocks(spark, small_blocks):
    rows, frame = history(spark, 1)
    got = {r.i: r.total for r in slices.running_sum(frame, ["k"], "at", ["i"], "v", "total", 7).collect()}
    assert got == {i: sum(v or 0 for l, b, j, v in rows if l == k and (b, j) <= (a, i)) for k, a, i, _ in rows}
    got = {r.i: r.total for r in slices.running_sum(frame, [], "at", ["i"], "v", "total", 100_000).collect()}
    assert got == {i: sum(v or 0 for _, b, j, v in rows if (b, j) <= (a, i)) for _, a, i, _ in rows}


@pytest.mark.parametrize("current", [True, False])
def test_carry_last_over_blocks(spark, small_blocks, current):
    rows, frame = history(spark, 2)
    got = {r.i: r.last for r in slices.carry_last(frame, ["k"], "at", ["i"], "v", "last", 7, include_current=current).collect()}
    for k, a, i, _ in rows:
        seen = [(b, j, v) for l, b, j, v in rows if l == k and v is not None and ((b, j) < (a, i) or current and (b, j) == (a, i))]
        assert got[i] == (max(seen)[2] if seen else None)


def test_next_value(spark, small_blocks):
    rows, frame = history(spark, 3)
    first = frame.groupBy("k", "at").agg(F.min("i").alias("i"))
    times = {(k, a) for k, a, *_ in rows}
    got = {(r.k, r.at): r.following for r in slices.next_value(first, ["k"], "at", "at", "following", 7).collect()}
    assert got == {(k, a): min((b for l, b in times if l == k and b > a), default=None) for k, a in times}


def test_empty_and_repeated_rows(spark):
    frame = spark.createDataFrame([("a", 1, 0, 2)] * 3, "k string, at long, i long, v long")
    assert {r.total for r in slices.running_sum(frame, ["k"], "at", ["i"], "v", "total", 7).collect()} <= {2, 4, 6}
    assert slices.running_sum(frame.limit(0), ["k"], "at", ["i"], "v", "total", 7).collect() == []
    assert slices.carry_last(frame.limit(0), ["k"], "at", ["i"], "v", "last", 7).collect() == []


def test_active_clients_against_every_tick(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(0, 20_000) / 2, rng.choice("abcdef")) for _ in range(300)]
    packets = spark.createDataFrame([(int(t * S), "request", c) for t, c in rows], "ts_ns long, direction string, client_ip string")
    for window, every in ((60, 15), (5, 15), (100, 7)):
        got = {r.tick: r.active for r in clients.active_clients(packets, window, every).collect()}
        for tick in range(0, 10_200, every):
            assert got.get(tick, 0) == len({c for t, c in rows if math.ceil(t) <= tick <= int(t) + window})


def test_daily_union_against_every_hour(spark):
    rng = random.Random(5)
    starts = [rng.randrange(0, 900) * 3600 for _ in range(60)] + [2000 * 3600]
    rows = [(h + rng.randrange(3600), rng.randrange(200)) for h in starts for _ in range(rng.randrange(1, 40))]
    packets = spark.createDataFrame([(t * S, "request", f"c{c}") for t, c in rows], "ts_ns long, direction string, client_ip string")
    registers = clients.hourly_registers(packets, 6).cache()
    got = {r.hour: round(r.unique_clients, 6) for r in clients.daily_from_registers(registers).collect()}
    reach = F.explode(F.sequence(F.col("hour"), F.col("hour") + 23 * 3600, F.lit(3600).cast("bigint")))
    union = clients.hll_merge(registers.withColumn("hour", reach), ["hour"])
    assert got == {r.hour: round(r.estimate, 6) for r in clients.hll_estimate(union, ["hour"]).collect()}
    mixed = registers.unionByName(registers.withColumn("p", F.lit(7)).withColumn("hour", F.col("hour") + 3600))
    with pytest.raises(Exception, match="different precision"):
        clients.daily_from_registers(mixed).collect()
    assert clients.daily_from_registers(registers.limit(0)).collect() == []


def test_gauges_as_intervals(spark, small_blocks):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(0, 3000), rng.choice([None, float(i)])) for i in range(120)]
    gauges = spark.createDataFrame(rows, "k string, at long, value double").withColumn("ts", F.timestamp_seconds("at"))
    intervals = samples.retained_intervals(gauges, ["k"], 15, F.lit(3600).cast("bigint"), 60).cache()

    def held(key, tick):
        seen = [(a, v) for k, a, v in rows if k == key and v is not None and a <= tick]
        return max(seen)[1] if seen else None

    want = {(k, t): held(k, t) for k in "ab" for t in range(0, 3601, 15) if held(k, t) is not None}
    assert {(r.k, r.tick): r.value for r in samples.at_ticks(intervals, 15).collect()} == want
    assert {r.k: r.value for r in samples.value_at(intervals, F.lit(1500)).collect()} == {k: v for (k, t), v in want.items() if t == 1500}
    assert intervals.count() <= len({(k, -(-a // 15)) for k, a, v in rows if v is not None})


def _window_keys(frame):
    """The windows of the optimised plan, a line each."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line]


def test_no_window_holds_a_whole_history(spark):
    rows = spark.createDataFrame([(1, 1 * S, "request", "a", b"x")], "seq long, ts_ns long, direction string, client_ip string, xid binary")
    for frame in (latency.pending_depth(rows), clients.active_clients(rows), clients.unique_daily(rows)):
        lines = _window_keys(frame)
        assert lines
        for line in lines:
            assert "_slice" in line or "_block" in line, line
