"""Event-time steps over a stream: rows in any order within a bound, late ones counted where they arrive, state in tables.

A micro-batch moves a frontier: the newest time seen so far less the lateness bound, on the flush grid, never falling. Rows before
the frontier are released to the operator, which so sees whole flushes, each once; newer rows wait. A row that
arrives behind the frontier of the batch before is late: its time becomes that frontier, the first flush still
open, and it stays marked. Nothing is dropped, and what a batch does depends on its own rows and on the tables of the batch before.

``closed`` releases at the end of a source what still waits, as a further step with no end. It writes no state, so if the source
goes on, the next batch takes that step's number and replaces its output.

Each batch writes its output, its waiting rows and its state below folders of its own number and replaces them if it is redone, so a
restart from the checkpoint gives the same tables. State is bounded by the operator; a batch's folders go when the
batch after the next is done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stratalens.functions.timegrid import SECOND_NS

AT, LATE = "_at_ns", "_late"


@dataclass
class Step:
    """What one micro-batch releases: rows of [since, until) epoch seconds, with their time in AT and the mark LATE.

    since is None until the first rows are released. last: the source is at its end; all rows that waited are there, results of any
    later time count as inside, and until is the flush edge after the newest row.
    """

    rows: DataFrame
    since: int | None
    until: int
    number: int
    path: str
    kept: dict[str, DataFrame] = field(default_factory=dict)
    cached: list[DataFrame] = field(default_factory=list)
    last: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def state(self, name: str, schema: str) -> DataFrame:
        """The table that the batch before kept under this name; empty at first."""
        if self.number == 0:
            return _empty(self.spark, schema)
        return _read(self.spark, f"{self.path}/state/{name}/batch={self.number - 1}", schema)

    def keep(self, name: str, table: DataFrame) -> None:
        """Hand a table to the next batch."""
        self.kept[name] = table

    def release(self, table: DataFrame) -> None:
        """Give up a persisted table when the batch is written."""
        self.cached.append(table)

    def hold(self, table: DataFrame) -> DataFrame:
        """The table, worked out once for the step."""
        self.cached.append(table.persist())
        return table

    def inside(self, time: Column, unit: int = 1) -> Column:
        """Whether a time since the epoch, `unit` to the second, lies in [since, until)."""
        before = F.lit(True) if self.last else time < self.until * unit
        return before if self.since is None else (time >= self.since * unit) & before


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the JVM makes by itself."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def _forget(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in files.listStatus(target)] if files.exists(target) else []


def run_steps(
    stream: DataFrame, path: str, time_ns: Column, work: Callable[[Step], DataFrame], every: int, late: int,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream that hands each micro-batch's released rows to `work` and writes the rows it returns.

    time_ns: a row's time. every: the flush grid, late: the lateness bound, in seconds. trigger: as for Spark's writer;
    by default the stream runs to the present end of its source. The output stands below path/out, by batch.
    """
    schema = f"{stream.withColumn(AT, time_ns).withColumn(LATE, F.lit(False)).schema.toDDL()}"
    marks: dict[int, tuple[int | None, int | None]] = {-1: (None, None)}

    def mark_of(spark: SparkSession, number: int) -> tuple[int | None, int | None]:
        if number not in marks:
            row = _read(spark, f"{path}/state/frontier/batch={number}", "newest LONG, frontier LONG").first()
            marks[number] = (row.newest, row.frontier)
        return marks[number]

    def put(table: DataFrame, name: str, number: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest, since = mark_of(spark, number - 1)
        behind = F.lit(False) if since is None else F.col(AT) < since * SECOND_NS
        rows = batch.withColumn(AT, time_ns).withColumn(LATE, behind)
        if since is not None:
            rows = rows.withColumn(AT, F.greatest(F.col(AT), F.lit(since * SECOND_NS)))
        rows = rows.persist()
        seen = rows.agg(F.max(AT)).first()[0]
        newest = max((x for x in (newest, seen) if x is not None), default=None)
        until = since
        if newest is not None:
            edge = (newest // SECOND_NS - late) // every * every
            until = edge if since is None else max(since, edge)
        if number:
            rows_all = rows.unionByName(_read(spark, f"{path}/state/waiting/batch={number - 1}", schema))
        else:
            rows_all = rows
        ready = F.lit(False) if until is None else F.col(AT) < until * SECOND_NS
        # Persisted, so that the operator's code holds no frontier and is compiled once.
        released = rows_all.where(ready).persist()
        step = Step(released, since, until if until is not None else 0, number, path)
        put(work(step), "out", number)
        for name, table in step.kept.items():
            put(table, f"state/{name}", number)
        put(rows_all.where(~ready), "state/waiting", number)
        mark = spark.range(0, 1, 1, 1).select(F.lit(newest).cast("long").alias("newest"), F.lit(until).cast("long").alias("frontier"))
        put(mark, "state/frontier", number)
        for table in (released, rows, *step.cached):
            table.unpersist()
        marks.clear()
        marks[number] = (newest, until)
        for name in ("waiting", "frontier", *step.kept):
            _forget(spark, f"{path}/state/{name}/batch={number - 2}")

    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(handle)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def closed(stream: DataFrame, path: str, time_ns: Column, work: Callable[[Step], DataFrame], every: int) -> None:
    """Write below path/out what the open flushes of a stopped stream of ``run_steps`` hold, by its state."""
    spark = stream.sparkSession
    done = [int(number) for number in _names(spark, f"{path}/checkpoint/commits") if number.isdigit()]
    if not done:
        return
    number = max(done)
    schema = f"{stream.withColumn(AT, time_ns).withColumn(LATE, F.lit(False)).schema.toDDL()}"
    mark = _read(spark, f"{path}/state/frontier/batch={number}", "newest LONG, frontier LONG").first()
    if mark.newest is None:
        return
    rows = _read(spark, f"{path}/state/waiting/batch={number}", schema).persist()
    until = (mark.newest // SECOND_NS // every + 1) * every
    step = Step(rows, mark.frontier, until, number + 1, path, last=True)
    work(step).write.mode("overwrite").parquet(f"{path}/out/batch={number + 1}")
    for table in (rows, *step.cached):
        table.unpersist()


def stepped(
    stream: DataFrame, path: str, time_ns: Column, work: Callable[[Step], DataFrame], every: int, late: int, close: bool = False,
) -> DataFrame:
    """All that ``run_steps`` writes up to the present end of the source; with close, that end is the last and no flush stays open."""
    run_steps(stream, path, time_ns, work, every, late).awaitTermination()
    if close:
        closed(stream, path, time_ns, work, every)
    return written_steps(stream.sparkSession, path)


def written_steps(spark: SparkSession, path: str) -> DataFrame:
    """What the steps below a path have written so far."""
    return spark.read.parquet(f"{path}/out").drop("batch")
