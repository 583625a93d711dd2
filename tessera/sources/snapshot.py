"""Versioned snapshots of tables: each version is a folder, and a pointer file names the newest."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: that of checkpoints."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again, so that no later step works it out
    twice; deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the session is gone: the folder's owner cleans up
        pass


def numbered(df: DataFrame, name: str, first: int) -> DataFrame:
    """df with a number for each row in `name`, from first on, without gaps and in the order of the
    rows: what stands before each partition is counted, and added to the place inside it."""
    # stored, so that partitions and places stay what they are when a task is run again
    placed = scratch(df.select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "numbered").withColumn("place", F.expr("place & ((1L << 33) - 1)"))
    sizes = placed.groupBy("part").count()  # a row for each partition
    before = sizes.select("part", (F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first).alias("before"))
    return placed.join(before, "part").select((F.col("before") + F.col("place")).alias(name), "row.*")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def current(spark: SparkSession, root: str) -> int:
    """The newest complete version, 0 if there is none."""
    fs, _ = _fs(spark, root)
    pointer = _path(spark, root, "CURRENT")
    if not fs.exists(pointer):
        return 0
    stream = fs.open(pointer)
    try:
        return int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip())
    finally:
        stream.close()


def save(root: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> int:
    """Writes all tables as a new version, then moves the pointer in one rename. A crash before
    that leaves the old version as it was."""
    spark = next(iter(tables.values())).sparkSession
    version = current(spark, root) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{root}/v{version}/{name}")
    fs, _ = _fs(spark, root)
    new = _path(spark, root, f"CURRENT.{version}")
    out = fs.create(new, True)
    out.write(str(version).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(_path(spark, root, "CURRENT")), options)
    return version


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    version = current(spark, root) if version is None else version
    if not version:
        raise FileNotFoundError(f"no snapshot in {root}")
    return spark.read.parquet(f"{root}/v{version}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes versions older than the newest `keep`."""
    fs, _ = _fs(spark, root)
    for version in range(1, current(spark, root) - keep + 1):
        fs.delete(_path(spark, root, f"v{version}"), True)


def roundtrip(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df saved as a snapshot of its own and loaded again."""
    root = f"{shared_folder(df.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    save(root, {"table": df}, {"table": partition_by or []})
    return load(df.sparkSession, root, "table")
