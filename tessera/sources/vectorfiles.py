"""Vector files as Spark data sources: fvecs and ivecs, single vectors, text folders, data sets."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.errors import DimMismatch
from tessera.functions.vectors import normalize, parse_literal
from tessera.sources.snapshot import numbered

#: Bytes of records that are handed on together.
RUN_BYTES = 1 << 20
_KINDS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int")}


def read_records(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(id, vec) of records `i32 n, n numbers`, ids in the order of the file.

    The file is read through Spark, so that it may be on any file system Spark knows, in slices of
    whole records: all records have the length of the first, and a file that doesn't divide into
    such records is refused.
    """
    number, element = _KINDS[kind]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    schema = f"id long, vec array<{element}>"
    if size == 0:
        return spark.createDataFrame([], schema)
    stream = fs.open(p)
    try:
        n = int.from_bytes(bytes((stream.read() & 0xFF) for _ in range(4)), "little", signed=True)
    finally:
        stream.close()
    width = 4 + 4 * n
    if size < 4 or n <= 0 or size % width:
        raise ValueError(f"{path}: {size} bytes are not records of {n} numbers")
    # records of fixed length are a format of Hadoop's own: splits fall on their borders. What is
    # handed on are packed runs of records, so no row passes Python one by one
    raw = spark.sparkContext.binaryRecords(path, width)
    packed = raw.mapPartitionsWithIndex(lambda part, rows: ((part, k, b"".join(run)) for k, run in enumerate(_runs(rows, max(1, RUN_BYTES // width)))))
    runs = spark.createDataFrame(packed, "part int, run int, raw binary")
    counted = runs.select("part", "run", (F.length("raw") / width).cast("long").alias("n"))
    # a row for each RUN_BYTES of the file
    before = counted.select("part", "run", F.coalesce(F.sum("n").over(Window.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, first in zip(batch.column(0), batch.column(1).to_pylist()):
                words = np.frombuffer(raw.as_buffer(), "<i4").reshape(-1, n + 1)
                if (words[:, 0] != n).any():
                    raise DimMismatch(f"record {first + int((words[:, 0] != n).argmax())} has another length than the first, {n}")
                flat = np.ascontiguousarray(words[:, 1:]).view(number).ravel()
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(words))), vec], ["id", "vec"])

    return runs.join(before, ["part", "run"]).select("raw", "first").mapInArrow(parse, schema)


def _runs(rows: Iterator[bytes], size: int) -> Iterator[list[bytes]]:
    while run := list(islice(rows, size)):
        yield run


def write_records(rows: list, path: str, kind: str = "fvecs") -> None:
    """A local file of records, for small query sets."""
    with open(path, "wb") as file:
        for row in rows:
            file.write(np.array([len(row)], "<i4").tobytes() + np.array(row, _KINDS[kind][0]).tobytes())


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(base, queries, truth or None) of a folder with *base.fvecs, *query.fvecs, *groundtruth.ivecs.

    Vectors are brought to length 1. Their lengths must agree, and truth must have a row per query.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(p))
    find = lambda end: next((f"{folder}/{n}" for n in names if n.endswith(end)), None)
    base, query, truth = find("base.fvecs"), find("query.fvecs"), find("groundtruth.ivecs")
    if not base or not query:
        raise FileNotFoundError(f"{folder}: no *base.fvecs or no *query.fvecs")
    unit = lambda t: t.withColumn("vec", normalize("vec").cast("array<float>"))
    b, q = unit(read_records(spark, base)), unit(read_records(spark, query))
    sizes = [t.select(F.size("vec")).first() for t in (b, q)]
    if all(sizes) and sizes[0] != sizes[1]:
        raise DimMismatch(f"base has {sizes[0][0]} numbers a row, queries {sizes[1][0]}")
    t = read_records(spark, truth, "ivecs") if truth else None
    if t is not None and t.count() != q.count():
        raise ValueError("truth and queries have different numbers of rows")
    return b, q.withColumnRenamed("id", "qid"), t


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, text) of the files *.txt right in a folder; ids follow the byte order of names."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=False)
    named = files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    # files fall into partitions by ranges of their names, and are numbered by what stands before
    parts = spark.sparkContext.defaultParallelism
    return numbered(named.repartitionByRange(parts, "name").sortWithinPartitions("name"), "id", 0)


def vector_argument(spark: SparkSession, dim: int, literal: str | None = None, file: str | None = None) -> list[float]:
    """One vector: numbers with commas, or little-endian floats in a file (- for standard input).

    Exactly one source must be given; a file may be longer than dim numbers, which are its first.
    """
    if (literal is None) == (file is None):
        raise ValueError("give a literal or a file, and one of them only")
    if literal is not None:
        vec = spark.range(1).select(parse_literal(F.lit(literal)).alias("v")).first().v
        if vec is None:
            raise ValueError(f"not a list of numbers: {literal!r}")
        if len(vec) != dim:
            raise DimMismatch(f"{len(vec)} numbers, not {dim}")
        return vec
    if file == "-":
        raw = sys.stdin.buffer.read(4 * dim)
    else:
        with open(file, "rb") as handle:
            raw = handle.read(4 * dim)
    if len(raw) < 4 * dim:
        raise DimMismatch(f"{len(raw)} bytes, not {4 * dim}")
    return np.frombuffer(raw, "<f4").tolist()
