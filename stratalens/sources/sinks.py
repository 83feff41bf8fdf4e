"""Sample sink: parquet by metric and date; a stream's folders hold every row once and are merged as they grow in number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalens.sources.readers import SAMPLES

PARTITIONS = ["metric", "date"]


def _dated(samples: DataFrame) -> DataFrame:
    return samples.withColumn("date", F.to_date("ts"))


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write samples so that a reader prunes by metric and date.

    Rows are spread by metric, date and hour before writing: every task then
    writes few files, and a metric with most of the rows still has many tasks.
    """
    dated = _dated(samples)
    spread = dated.repartition("metric", "date", F.date_trunc("hour", "ts"))
    spread.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_written(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("metric", "labels", "ts", "value")


def _folders(spark: SparkSession, path: str) -> dict[tuple[int, int], str]:
    """The finished folders below a streaming sink, by their first and last batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in system.listStatus(root) if system.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith("batches=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            first, last = name.removeprefix("batches=").split("-")
            found[int(first), int(last)] = f"{path}/{name}"
    return found


def _live(folders: dict[tuple[int, int], str]) -> dict[tuple[int, int], str]:
    """The folders that hold every batch once: those that no wider one covers."""
    return {k: v for k, v in folders.items() if not any(o != k and o[0] <= k[0] and k[1] <= o[1] for o in folders)}


def _read_folders(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    columns = ["metric", "labels", "ts", "value"]
    rows = spark.read.schema(f"{SAMPLES}, date DATE, batches STRING").option("basePath", path).parquet(*folders) if folders else None
    return rows.select(*columns) if folders else spark.createDataFrame([], SAMPLES).select(*columns)


def read_streamed(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a streaming sink, each once; a reader's filters on metric prune folders."""
    return _read_folders(spark, path, sorted(_live(_folders(spark, path)).values()))


def merge_batches(spark: SparkSession, path: str, before: int) -> None:
    """Put the folders of all batches before the given one together, so that files follow the hours, not the batches.

    Only folders of one batch are rewritten, so each row is merged once. The merged folder counts as soon as it is whole
    (its success mark), and from then on the folders it covers don't; they are deleted last. A merge that
    broke off is done anew or, if only the deletion was left, finished.
    """
    folders = _folders(spark, path)
    singles = sorted(k for k in _live(folders) if k[0] == k[1] and k[1] < before)
    if len(singles) > 1:
        merged = (singles[0][0], singles[-1][1])
        write_samples(_read_folders(spark, path, [folders[k] for k in singles]), f"{path}/batches={merged[0]}-{merged[1]}", "overwrite")
        folders = _folders(spark, path)
    for key in folders.keys() - _live(folders).keys():
        target = spark._jvm.org.apache.hadoop.fs.Path(folders[key])
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stream_samples(
    samples: DataFrame, path: str, checkpoint: str, merge_every: int = 60, trigger: dict | None = None
) -> StreamingQuery:
    """Write each micro-batch to a folder of its own, replaced if the batch is redone.

    Every ``merge_every`` batches the folders of the batches before, which Spark has committed by then and never redoes,
    are merged. trigger: as for Spark's writer; by default the stream runs to the present end of its source.
    """

    def put(batch: DataFrame, number: int) -> None:
        if number and number % merge_every == 0:
            merge_batches(batch.sparkSession, path, number)
        write_samples(batch, f"{path}/batches={number}-{number}", "overwrite")

    writer = samples.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
