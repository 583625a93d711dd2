"""What several corpus operators share: shared scratch tables, word rules, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and tab to carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The same as a Java and RE2 class body.
SPACE_CLASS = r"\x20\x09-\x0D"


#: An odd number whose powers weigh places, and its inverse.
BASE = np.uint64(0xD6E8FEB86659FD93)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers_known: dict[int, np.ndarray] = {}
#: A number for each byte, A-Z as a-z, and which bytes part words.
_BYTE = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of text that are hashed at once; what is worked out for each byte stays in the processor's cache.
HASHED_BYTES = 1 << 17


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of base, modulo 2**64; those up to the size of a batch are remembered."""
    held = _powers_known.get(int(base))
    if held is None or len(held) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        held = np.multiply.accumulate(out)
        if n <= 1 << 22:
            _powers_known[int(base)] = held
    return held[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts, A-Z lower-cased, and how many words each text has."""
    cuts, held = [0], 0
    for k, text in enumerate(texts, 1):
        held += len(text)
        if held >= HASHED_BYTES or k == len(texts):
            cuts.append(k)
            held = 0
    found = [_word_hashes(texts[a:b]) for a, b in zip(cuts, cuts[1:])] or [_word_hashes(texts)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the words' bytes, weighted by their places, for all words at once."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[data]
    first = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    last = np.nonzero(~space[:-1] & space[1:])[0] + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(BASE, len(data)), dtype=np.uint64)])
    found = (total[last] - total[first]) * powers(BACK, len(data))[first]
    for shift, factor in ((31, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
        found ^= found >> np.uint64(shift)
        found *= np.uint64(factor)
    found ^= found >> np.uint64(32)
    cut = np.searchsorted(first, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    return found, np.diff(cut)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/tessera-{uuid.uuid4().hex}-{name}"
    atexit.register(_delete, spark, path)
    return path


def mounted(path: str) -> str:
    """The path as the operating system knows it, for files that workers read by themselves."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"workers read files there, so the folder must be mounted on every machine: {path}")
    return url.path if url.scheme else path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session or its JVM is gone: the folder's owner cleans up
        pass


#: Lets Spark delete the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a batch that Python workers get: texts are long, and a task holds several copies of a batch.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


@contextmanager
def own_settings(spark: SparkSession) -> Iterator[None]:
    """For the queries that are run here: shuffle files go as soon as each has ended, and Python
    workers get small batches."""
    before = spark.conf.get(_CLEANUP, "false"), spark.conf.get(_BATCH)
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, _BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before[0])
        spark.conf.set(_BATCH, before[1])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: survives lost executors.

    The shuffle files behind it are deleted as soon as the table is complete.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with own_settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() made and that nothing reads any more."""
    _delete(df.sparkSession, df.tessera_path)


class Tables:
    """The tables that an operator stores on its way, to be deleted together."""

    def __init__(self) -> None:
        self.kept: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.kept.append(stored(df, name))
        return self.kept[-1]

    def discard(self) -> None:
        for df in self.kept:
            discard(df)
        self.kept.clear()


def checkpointed(df: DataFrame) -> DataFrame:
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """wanted, with underscores in front until no column is called so."""
    taken = {x.lower() for x in taken}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def ids_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text) of df, whatever else it carries; a null text is empty."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def text_key() -> list[Column]:
    """A key for rows of (id, text) that holds for null and repeated ids; equal rows share it."""
    return [F.coalesce(F.col("id"), F.lit(-(2**63))).alias("k1"), F.xxhash64("id", "text").alias("k2")]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the links a[i]-b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (src, dst), component the smallest node reachable.

    Alternates large-star and small-star rounds. Each is an aggregation with map-side
    combining and a join back, so that a node with very many links is never gathered in one
    task, and each ends in a reliable checkpoint. Nulls and loops are ignored.
    """
    pairs = edges.select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).where("src IS NOT NULL AND dst IS NOT NULL AND u <> v")
    e = checkpointed(pairs.distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own: Spark can split the join of a node with very many links then
        seen = checkpointed(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        # A star forest: every node that has a smaller neighbour has that one only, and it is a root.
        if seen.where(F.expr("m < u AND n > 1")).isEmpty():
            break
        low = seen.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("inline(array(struct(v AS u, m AS v), struct(u, m AS v)))")
        e = checkpointed(small.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
