"""The operation log as a stream: each micro-batch is merged into a versioned snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.state import OPLOG, VECTORS, replay
from tessera.sources.snapshot import current, load, prune, save, shared_folder

_SNAPSHOT = f"{VECTORS}, batch long"


def merge_batches(root: str, keep: int = 2):
    """For writeStream.foreachBatch: applies a batch once, also if it is delivered again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = load(spark, root, "vectors") if current(spark, root) else spark.createDataFrame([], _SNAPSHOT)
        if not before.where(F.col("batch") >= number).limit(1).isEmpty():
            return
        after = replay(batch, before.drop("batch")).withColumn("batch", F.lit(number).cast("long"))
        save(root, {"vectors": after})
        prune(spark, root, keep)

    return merge


def replay_stream(log: DataFrame, files: int = 4, root: str | None = None) -> DataFrame:
    """(id, vec, name, deleted) of a log that is written as `files` files in order and read as a stream."""
    spark = log.sparkSession
    root = root or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ranged = log.repartitionByRange(files, "seq").withColumn("file", F.spark_partition_id())
    ranged.write.parquet(staged := f"{root}/staged")
    staged_log = spark.read.parquet(staged)
    for number in sorted(r.file for r in staged_log.select("file").distinct().collect()):  # `files` rows at most
        staged_log.where(F.col("file") == number).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/log")
    stream = spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    merge = merge_batches(f"{root}/state")
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if not current(spark, f"{root}/state"):
        return spark.createDataFrame([], VECTORS)
    return load(spark, f"{root}/state", "vectors").drop("batch")
