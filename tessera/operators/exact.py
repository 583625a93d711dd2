"""Exact nearest neighbours, recall, and names of results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.errors import DimMismatch
from tessera.functions.vectors import cosine_normalized

#: Bytes of query vectors that are sent to every task; more are joined in the cluster, in blocks of so many.
QUERY_BYTES = 64 << 20
#: Bytes of distances that a task works out at once.
STEP_BYTES = 64 << 20
#: Pairs of a query and a row that are measured at once.
PAIRS = 1 << 15


def live(vectors: DataFrame) -> DataFrame:
    """The rows that are not deleted; the filter reaches the Parquet scan."""
    return vectors.where(~F.col("deleted")) if "deleted" in vectors.columns else vectors


def exact_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, dist) of the k nearest live rows, ties by id; all of them if k is larger."""
    target = F.array(*(F.lit(float(x)) for x in query))
    found = live(vectors).select("id", cosine_normalized("vec", target).alias("dist"))
    return found.orderBy("dist", "id").limit(k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if len(column) else column
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) != len(column) * dim:
        raise DimMismatch(f"{len(values)} numbers in {len(column)} vectors of length {dim}")
    return values.reshape(len(column), dim)


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k least of dist, ties by id."""
    if dist.shape[1] > 4 * k:
        cut = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        most = int((dist <= cut).sum(axis=1).max())
        near = np.argpartition(dist, most - 1, axis=1)[:, :most] if most < dist.shape[1] else None
        if near is not None:
            dist, ids = np.take_along_axis(dist, near, axis=1), np.take_along_axis(ids, near, axis=1)
    order = np.lexsort((ids, dist), axis=1)[:, :k]
    return np.take_along_axis(dist, order, axis=1), np.take_along_axis(ids, order, axis=1)


def measured(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The distance of each pair of rows, added up in order as dot() does. A product of matrices
    rounds by shape and place, so equal vectors may come out at unequal distances there."""
    return 1 - np.add.accumulate(asked * rows, axis=1)[:, -1]


class _Nearest:
    """The k nearest so far of each of some queries, whatever base rows come.

    A product of matrices says which rows may be among them; these are measured one by one.
    """

    def __init__(self, qids: np.ndarray, matrix: np.ndarray, k: int):
        self.qids, self.matrix, self.k = qids, matrix, k
        self.step = min(4096, max(64, STEP_BYTES // (8 * 1024)))  # base rows at once
        self.rows = max(1, STEP_BYTES // (8 * (self.step + k)))  # queries at once
        self.parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for _ in range(0, len(qids), self.rows)]  # query, id, dist
        self.worst, self.worst_id = np.full(len(qids), np.inf), np.full(len(qids), np.iinfo(np.int64).max)
        self.length = np.linalg.norm(matrix, axis=1)

    def add(self, ids: np.ndarray, base: np.ndarray) -> None:
        if not len(ids):
            return
        # twice what a product of matrices may be off by
        slack = 4 * (base.shape[1] + 4) * np.finfo(np.float64).eps * (1 + self.length * np.linalg.norm(base, axis=1).max())
        for n in range(len(self.parts)):
            lo, hi = n * self.rows, (n + 1) * self.rows
            new, cut = 1 - self.matrix[lo:hi] @ base.T, self.worst[lo:hi]
            if new.shape[1] > self.k and not np.isfinite(cut).all():
                cut = np.fmin(cut, np.partition(new, self.k - 1, axis=1)[:, self.k - 1])
            row, at = np.nonzero(~(new > (cut + slack[lo:hi])[:, None]))
            for a in range(0, len(row), PAIRS):
                query, near = row[a : a + PAIRS] + lo, at[a : a + PAIRS]
                self._keep(n, query, ids[near], measured(self.matrix[query], base[near]))

    def _keep(self, n: int, query: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        worst = self.worst[query]
        nearer = ~((dist > worst) | ((dist == worst) & (ids > self.worst_id[query])))
        query, ids, dist = (np.concatenate([held, x[nearer]]) for held, x in zip(self.parts[n], (query, ids, dist)))
        order = np.lexsort((ids, dist, query))
        query, ids, dist = query[order], ids[order], dist[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.worst[query[last]], self.worst_id[query[last]] = dist[last], ids[last]
        self.parts[n] = tuple(x[rank < self.k] for x in (query, ids, dist))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for query, ids, dist in self.parts:
            for lo in range(0, len(query), 1_000_000):
                own = slice(lo, lo + 1_000_000)
                yield pa.RecordBatch.from_arrays([pa.array(self.qids[query[own]]), pa.array(ids[own]), pa.array(dist[own])], ["qid", "id", "dist"])


_FOUND = "qid long, id long, dist double"


def knn_join(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rk, id, dist): for each row (qid, vec) of queries the k nearest live rows of base.

    Ties go by id; distances are sums in DOUBLE, and those of equal rows are equal. Up to QUERY_BYTES of queries go to every task, which
    compares its part of base with them and keeps k rows a query, so what is shuffled is k rows for
    each query and task. More queries are cut into blocks, and so is base, and a task gets a block
    of each; nothing passes the driver then. A task works out STEP_BYTES of distances at once.
    """
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = shape["n"], shape["dim"] or 1
    base = live(base).select("id", "vec")
    found = (_sent if n * dim * 8 <= QUERY_BYTES else _joined)(base, queries.select("qid", "vec"), n, dim, k)
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("qid", "rk", "id", "dist")


def _sent(base: DataFrame, queries: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    own = queries.toArrow()
    sent = base.sparkSession.sparkContext.broadcast((own.column(0).to_numpy().astype(np.int64), _matrix(own.column(1).combine_chunks(), dim)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Nearest(*sent.value, k)
        for batch in batches:
            for lo in range(0, batch.num_rows, found.step):
                part = batch.slice(lo, found.step)
                found.add(part.column(0).to_numpy().astype(np.int64), _matrix(part.column(1), dim))
        yield from found.batches()

    return base.mapInArrow(nearest, _FOUND)


def _joined(base: DataFrame, queries: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    size = max(1, QUERY_BYTES // (8 * dim))  # rows in a block
    many, parts = -(-n // size), max(1, -(-base.count() // size))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = queries.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(many)).cast("int").alias("q"), every(parts).alias("b"))
    held = base.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("b"), every(many).alias("q"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _Nearest(left.column("qid").to_numpy().astype(np.int64), _matrix(left.column("vec").combine_chunks(), dim), k)
        for lo in range(0, right.num_rows, found.step):
            part = right.slice(lo, found.step)
            found.add(part.column("id").to_numpy().astype(np.int64), _matrix(part.column("vec").combine_chunks(), dim))
        return pa.Table.from_batches(list(found.batches()), pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())]))

    return asked.groupBy("q", "b").cogroup(held.groupBy("q", "b")).applyInArrow(nearest, _FOUND)


def with_names(results: DataFrame, vectors: DataFrame) -> DataFrame:
    """results with the name of each id; one that has none is ''."""
    names = vectors.select("id", "name")
    return results.join(names, "id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, hits, truth_n, recall): the share of a query's true neighbours that was found."""
    hit = found.select("qid", "id", F.lit(1).alias("hit")).distinct()
    return (
        truth.select("qid", "id")
        .join(hit, ["qid", "id"], "left")
        .groupBy("qid")
        .agg(F.count("hit").alias("hits"), F.count("*").alias("truth_n"))
        .withColumn("recall", F.col("hits") / F.col("truth_n"))
    )


def results_json(results: DataFrame) -> DataFrame:
    """One JSON object a row, the distance with six decimals."""
    return results.select(F.to_json(F.struct("id", F.format_string("%.6f", F.col("dist")).alias("dist"), "name")).alias("json"))


def results_tsv(results: DataFrame) -> DataFrame:
    return results.select(F.format_string("%d\t%.6f\t%s", F.col("id"), F.col("dist"), F.coalesce("name", F.lit(""))).alias("tsv"))
