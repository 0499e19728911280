"""Chunk states from a stream: each batch is merged into the table of latest states, as often as it may come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.checkpoints import latest


def merge_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: tuple[str, ...] = ("doc_id", "chunk_idx")) -> None:
    """Take in all new files of source and merge them into versions under target, then stop.

    Every batch writes the whole merged table as version=<batch>; a batch that
    is run again overwrites its own version from the one before, so the effect
    is that of running once.
    """

    def put(batch: DataFrame, number: int) -> None:
        before = read_states(spark, target, batch.schema, number)
        latest(before.unionByName(batch), keys).write.mode("overwrite").parquet(f"{target}/version={number:012d}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def versions(spark: SparkSession, target: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(done(p, "_SUCCESS")))


def read_states(spark: SparkSession, target: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The latest whole version, or the latest before a batch; empty if there is none."""
    known = [v for v in versions(spark, target) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{target}/version={known[-1]:012d}") if known else spark.createDataFrame([], schema)
