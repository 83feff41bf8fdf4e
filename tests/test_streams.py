"""Streams over many small files: late and unordered rows, restarts and redone batches, against batch operators."""

import glob
import os
import random
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalens.operators import clients, latency, streams
from stratalens.operators.steps import stepped

SECOND = 1_000_000_000
PACKETS = "seq LONG, ts_ns LONG, direction STRING, client_ip STRING, xid BINARY, family STRING"


def land(spark, folder, files):
    """Each list of rows as one more file."""
    for rows in files:
        spark.createDataFrame(rows, PACKETS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, work, every, late):
    source = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(folder)
    return stepped(source, path, F.col("ts_ns"), work, every, late)


def row(seq, second, direction="request", client="a", xid=b"x", family="ipv4"):
    return (seq, int(second * SECOND), direction, client, xid, family)


def counts(frame):
    return sorted((r.flush, r.packets, r.late) for r in frame.collect())


LATE_FILES = [
    [row(1, 1), row(2, 16), row(3, 31)],  # frontier 15
    [row(4, 32), row(5, 2), row(6, 62)],  # row 5 belongs to flush 0, which is closed: it counts in flush 15; frontier 45
    [row(7, 29), row(8, 61), row(9, 30.5)],  # both late, counted in flush 45
    [row(10, 100)],
]


def count_work(step):
    return streams.late_counts(step, [], 15)


def test_late_rows_count_where_they_arrive(spark, tmp_path):
    land(spark, f"{tmp_path}/in", LATE_FILES)
    found = counts(run(spark, f"{tmp_path}/in", f"{tmp_path}/s", count_work, 15, 10))
    assert found == [(0, 1, 0), (15, 2, 1), (30, 2, 0), (45, 2, 2), (60, 2, 0)]
    waiting = spark.read.parquet(f"{tmp_path}/s/state/waiting/batch=3").count()
    assert sum(n for _, n, _ in found) + waiting == sum(map(len, LATE_FILES))


def test_restart_and_redone_batch_give_the_same(spark, tmp_path):
    land(spark, f"{tmp_path}/all", LATE_FILES)
    want = counts(run(spark, f"{tmp_path}/all", f"{tmp_path}/once", count_work, 15, 10))
    land(spark, f"{tmp_path}/in", LATE_FILES[:2])
    run(spark, f"{tmp_path}/in", f"{tmp_path}/s", count_work, 15, 10)
    land(spark, f"{tmp_path}/in", LATE_FILES[2:])
    assert counts(run(spark, f"{tmp_path}/in", f"{tmp_path}/s", count_work, 15, 10)) == want
    # A batch whose end was not noted before the driver stopped is done again.
    last = max(glob.glob(f"{tmp_path}/s/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.rename(last, f"{tmp_path}/noted")
    for crc in glob.glob(f"{tmp_path}/s/checkpoint/commits/.{os.path.basename(last)}.crc"):
        os.rename(crc, f"{tmp_path}/noted.crc")
    assert counts(run(spark, f"{tmp_path}/in", f"{tmp_path}/s", count_work, 15, 10)) == want


@pytest.fixture(scope="module")
def shuffled():
    """400 packets of few clients over 300 s in eight files, each row up to 20 s late."""
    rng = random.Random(6)
    rows = [row(i, rng.randrange(300_000) / 1000, rng.choice(["request", "response"]), rng.choice("abc"), rng.choice([b"x", b"y", None])) for i in range(400)]
    arrival = sorted((r[1] + rng.randrange(20 * SECOND), r) for r in rows)
    return [[r for _, r in arrival[i : i + 50]] for i in range(0, 400, 50)]


@pytest.mark.parametrize("kind", ["pair", "interval", "active"])
def test_unordered_rows_equal_batch(spark, tmp_path, shuffled, kind):
    """State across batches: open requests, last requests and last sight of clients, with expiry in between."""
    land(spark, f"{tmp_path}/in", shuffled)
    rows = [r for f in shuffled for r in f]
    packets = spark.createDataFrame(rows, PACKETS)
    work, batch, time = {
        "pair": (lambda s: streams.pair_step(s, s.rows, 2), latency.pair_latency(packets, 2), F.col("ts_ns") / SECOND),
        "interval": (lambda s: streams.interval_step(s, s.rows, 4, 2), clients.request_intervals(packets, 4, 2), F.col("ts_ns") / SECOND),
        "active": (lambda s: streams.active_step(s, s.rows, 3, 3), clients.active_clients(packets, 3, 3), F.col("tick")),
    }[kind]
    every = {"pair": 15, "interval": 2, "active": 3}[kind]
    late = 25
    until = (max(r[1] for r in rows) // SECOND - late) // every * every
    found = run(spark, f"{tmp_path}/in", f"{tmp_path}/s", work, every, late)
    names = sorted(found.columns)
    want = sorted(map(tuple, batch.where(time < until).select(names).collect()))
    assert len(want) > 10 and sorted(map(tuple, found.select(names).collect())) == want
    if kind != "pair":
        name = {"interval": "last", "active": "clients"}[kind]
        newest = max(int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{tmp_path}/s/state/{name}/batch=*"))
        assert spark.read.parquet(f"{tmp_path}/s/state/{name}/batch={newest}").count() <= 3  # one row per client
        assert len(glob.glob(f"{tmp_path}/s/state/{name}/batch=*")) == 2  # older ones are gone


@pytest.mark.parametrize("kind", ["pair", "interval", "active", "sketch"])
def test_closed_stream_gives_all(spark, tmp_path, shuffled, kind):
    """At the end of the source no flush stays open; a stream that goes on replaces what the early end gave."""
    rows = [r for f in shuffled for r in f]
    packets = spark.createDataFrame(rows, PACKETS)
    work, batch = {
        "pair": (lambda s: streams.pair_step(s, s.rows, 2), latency.pair_latency(packets, 2)),
        "interval": (lambda s: streams.interval_step(s, s.rows, 4, 2), clients.request_intervals(packets, 4, 2)),
        "active": (lambda s: streams.active_step(s, s.rows, 3, 3), clients.active_clients(packets, 3, 3)),
        "sketch": (lambda s: streams.hourly_step(s, s.rows), clients.unique_daily(packets)),
    }[kind]
    every = {"pair": 15, "interval": 2, "active": 3, "sketch": 3600}[kind]
    for part in (shuffled[:5], shuffled[5:]):
        land(spark, f"{tmp_path}/in", part)
        source = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
        found = stepped(source, f"{tmp_path}/s", F.col("ts_ns"), work, every, 25, close=True)
    names = sorted(found.columns)
    assert sorted(map(tuple, found.select(names).collect())) == sorted(map(tuple, batch.select(names).collect()))


def test_polls_whose_documents_come_apart(spark, tmp_path):
    schema = "poll_ts TIMESTAMP, ip STRING, kind STRING, body STRING"
    body = '{"monitors":[{"id":1,"name":"m"}],"history":[{"ts":1,"score":5.0,"offset":0.1,"rtt":2.0,"monitor_id":1}]}'

    def doc(minute, kind, text=body, ip="i"):
        return (f"2024-01-01T00:{minute:02}:00Z", ip, kind, text)

    files = [
        [doc(0, "monitors"), doc(1, "overall"), doc(2, "monitors")],
        [doc(0, "overall"), doc(1, "monitors", "{"), doc(0, "overall")],
        [doc(30, "monitors"), doc(30, "overall")],
        [doc(31, "overall"), doc(31, "monitors")],
    ]
    for rows in files:
        frame = spark.createDataFrame(rows, "poll_ts STRING, ip STRING, kind STRING, body STRING").withColumn("poll_ts", F.to_timestamp("poll_ts"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    polls = streams.drain(streams.poll_stream(source, "10 minutes"), f"{tmp_path}/s", each=streams.poll_outcomes)
    assert sorted((r.poll_ts.minute, r.success, r.score) for r in polls.collect()) == [
        (0, True, 5.0), (1, False, None), (2, False, None), (30, True, 5.0), (31, True, 5.0)]


def test_sample_sink_merges_and_redoes(spark, tmp_path):
    """Folders are merged between batches; a redone batch, and a merge that broke off, leave every sample once."""
    from stratalens.sources import readers, sinks

    source, sink, state = (str(tmp_path / n) for n in ("in", "sink", "state"))

    def arrive(first, last):
        rows = [(f"m{i % 3}", {"n": str(i)}, datetime(2024, 1, 1 + i % 5), float(i)) for i in range(first, last)]
        spark.createDataFrame(rows, readers.SAMPLES).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = readers.read_samples(spark, source, streaming=True, maxFilesPerTrigger=1)
        sinks.stream_samples(stream, sink, state, merge_every=2).awaitTermination()

    def values():
        return sorted(r.value for r in sinks.read_streamed(spark, sink).collect())

    assert sinks.read_streamed(spark, sink).collect() == []
    for k in range(3):
        arrive(10 * k, 10 * k + 10)
    go()
    assert values() == list(range(30)) and set(sinks._folders(spark, sink)) == {(0, 1), (2, 2)}
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    arrive(30, 40)
    go()
    assert values() == list(range(40))
    left = tmp_path / "sink" / "batches=2-3"
    (left / "metric=m0").mkdir(parents=True)  # without a success mark
    assert values() == list(range(40))
    arrive(40, 50)
    go()
    assert values() == list(range(50)) and set(sinks._folders(spark, sink)) == {(0, 1), (2, 3), (4, 4)}
    shutil.copytree(tmp_path / "sink" / "batches=4-4", tmp_path / "sink" / "batches=3-3")  # what a merge failed to delete
    assert values() == list(range(50))
    assert "PartitionFilters: [isnotnull(metric" in sinks.read_streamed(spark, sink).where("metric = 'm1'")._jdf.queryExecution().toString()


def test_no_task_has_a_part_to_itself(spark, tmp_path):
    """The parts of a table that several tasks read land in several files, and a step's rows lie in several partitions."""
    from stratalens.plans import stream_queries
    from stratalens.plans.inputs import Inputs

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    partitions = []

    def work(step):
        partitions.append(step.rows.rdd.getNumPartitions())
        return step.rows.select("event_id")

    found = stream_queries._run(Inputs(spark, str(tmp_path)), work, "parts", close=True)
    assert found.count() == spark.read.parquet(f"{tmp_path}/events.parquet").count()
    assert len(partitions) == 5 and min(partitions[:4]) > 1  # four parts and the end
