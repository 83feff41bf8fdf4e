"""Tables written to the shared folder, so that lost executors never cost more than one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stratalens-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its partitions and their order kept in the shared folder."""
    root, context = shared_root(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return df.checkpoint()


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sent(spark: SparkSession, thing: object) -> Broadcast:
    """A broadcast of an object of this package's classes: they go along by value, as executors have no copy of the package."""
    return spark.sparkContext.broadcast([cloudpickle.dumps(thing)])


def received(shared: Broadcast) -> object:
    """The object that ``sent`` broadcast, loaded once in each worker."""
    box = shared.value
    if isinstance(box[0], bytes):
        box[0] = cloudpickle.loads(box[0])
    return box[0]


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
