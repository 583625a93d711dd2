"""Readers for the four binary files of a collection kept by another program: vectors, names, graph, log.

A file is one row of Spark's binary files, so it may be in any store that Spark knows and has 2 GB
at most; one task takes it apart, in batches, and what it gives are the tables of this library. A
file that is not what it says is refused; of a log, the records before the first broken one count.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import DimMismatch
from tessera.operators.state import OPLOG

# Fixed values of the formats: what a file begins with, its version, and the numbers of operations.
VECTORS, NAMES, GRAPH, LOG = b"HVSF", b"HMTF", b"HGRF", b"HWAL"
VERSIONS = {VECTORS: 2, NAMES: 2, GRAPH: 2, LOG: 1}
OPERATIONS = {1: "insert", 2: "delete", 3: "replace"}
LONGEST_RECORD = 1 << 20
NO_ENTRY = 0xFFFFFFFF

#: Rows of a batch.
ROWS = 4096


class BadFile(ValueError):
    pass


def _fields(raw: memoryview, kind: bytes, layout: str) -> tuple:
    """The numbers of a header that begins with kind and its version."""
    size = 8 + struct.calcsize("<" + layout)
    if len(raw) < size or raw[:4] != kind:
        raise BadFile(f"not a file of {kind.decode()}")
    version, *own = struct.unpack_from("<I" + layout, raw, 4)
    if version != VERSIONS[kind]:
        raise BadFile(f"version {version} of {kind.decode()}, not {VERSIONS[kind]}")
    return size, *own


def _read(spark: SparkSession, path: str, parse: Callable[[memoryview], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from parse(memoryview(content.as_buffer()))

    return files.mapInArrow(run, schema)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def read_vector_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec, deleted) of every slot, ids from 0."""

    def parse(raw: memoryview) -> Iterator[pa.RecordBatch]:
        at, dim, count, live = _fields(raw, VECTORS, "IQQ")
        marks = (count + 7) // 8
        if len(raw) != at + marks + 4 * dim * count:
            raise BadFile(f"{len(raw)} bytes for {count} vectors of {dim} numbers")
        dead = np.unpackbits(np.frombuffer(raw, np.uint8, marks, at), bitorder="little")[:count].astype(bool)
        if int(dead.sum()) + live != count:
            raise BadFile(f"{int(dead.sum())} dead and {live} live of {count}")
        for lo in range(0, count, ROWS):
            n = min(ROWS, count - lo)
            flat = np.frombuffer(raw, "<f4", n * dim, at + marks + 4 * dim * lo)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), _lists(flat, np.full(n, dim)), pa.array(dead[lo : lo + n])], ["id", "vec", "deleted"])

    return _read(spark, path, parse, "id long, vec array<float>, deleted boolean")


def read_name_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, deleted) of every slot; a name's bytes that are no UTF-8 are replaced."""

    def parse(raw: memoryview) -> Iterator[pa.RecordBatch]:
        at, count, live = _fields(raw, NAMES, "QQ")
        names: list[str | None] = []
        for _ in range(count):
            if at >= len(raw) or raw[at] > 1:
                raise BadFile("the names break off")
            if raw[at] == 0:
                names.append(None)
                at += 1
                continue
            size = int.from_bytes(raw[at + 1 : at + 3], "little")
            if at + 3 + size > len(raw):
                raise BadFile("the names break off")
            names.append(bytes(raw[at + 3 : at + 3 + size]).decode(errors="replace"))
            at += 3 + size
        if at != len(raw) or sum(n is not None for n in names) != live:
            raise BadFile(f"the file does not hold {live} names")
        for lo in range(0, count, ROWS):
            own = names[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(own))), pa.array(own, pa.string()), pa.array([n is None for n in own])], ["id", "name", "deleted"])

    return _read(spark, path, parse, "id long, name string, deleted boolean")


def read_graph_file(spark: SparkSession, path: str) -> DataFrame:
    """(layer, id, nbrs) of every node, nodes that hold nothing (of deleted slots) on layer 0 too.
    Links with slots beyond the last are refused."""

    def parse(raw: memoryview) -> Iterator[pa.RecordBatch]:
        at, _, entry, top, _, count = _fields(raw, GRAPH, "IIBII")
        layers, ids, lists = [], [], []
        for node in range(count):
            if at >= len(raw):
                raise BadFile("the graph breaks off")
            level, at = raw[at], at + 1
            for layer in range(level + 1):
                size = int.from_bytes(raw[at : at + 2], "little")
                if at + 2 + 4 * size > len(raw):
                    raise BadFile("the graph breaks off")
                nbrs = np.frombuffer(raw, "<u4", size, at + 2)
                if len(nbrs) and int(nbrs.max()) >= count:
                    raise BadFile(f"node {node} is linked with {int(nbrs.max())} of {count}")
                at += 2 + 4 * size
                layers.append(layer)
                ids.append(node)
                lists.append(nbrs)
        if at != len(raw) or max(layers, default=0) > top or entry != NO_ENTRY and entry >= count:
            raise BadFile("the graph is not what its header says")
        for lo in range(0, len(ids), ROWS):
            own = lists[lo : lo + ROWS]
            flat = np.concatenate(own).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(layers[lo : lo + ROWS], np.int32)), pa.array(np.array(ids[lo : lo + ROWS])), _lists(flat, np.array([len(x) for x in own]))], ["layer", "id", "nbrs"])

    return _read(spark, path, parse, "layer int, id long, nbrs array<long>")


def read_log_file(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(seq, op, id, vec, name) up to the first record that is broken off or fails its checksum."""

    def parse(raw: memoryview) -> Iterator[pa.RecordBatch]:
        _, own, _, check = _fields(raw, LOG, "III")
        if zlib.crc32(raw[:16]) != check:
            raise BadFile("the header of the log is broken")
        if own != dim:
            raise DimMismatch(f"the log has {own} numbers a vector, not {dim}")
        rows = list(_records(raw, dim))
        for lo in range(0, len(rows), ROWS):
            seq, op, row, vec, name = zip(*rows[lo : lo + ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(op), pa.array(row, pa.int64()), pa.array(vec, pa.list_(pa.float32())), pa.array(name, pa.string())], ["seq", "op", "id", "vec", "name"])

    return _read(spark, path, parse, OPLOG)


def _records(raw: memoryview, dim: int) -> Iterator[tuple]:
    at, head = 20, struct.Struct("<QBHIBHH")
    while at + 4 + head.size <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        end = at + 4 + size
        if size < head.size or size > LONGEST_RECORD or end + 4 > len(raw):
            return
        seq, op, _, row, _, numbers, letters = head.unpack_from(raw, at + 4)
        wanted = 0 if OPERATIONS.get(op) == "delete" else dim
        if op not in OPERATIONS or numbers != wanted or head.size + 4 * numbers + letters != size:
            return
        if zlib.crc32(raw[at:end]) != int.from_bytes(raw[end : end + 4], "little"):
            return
        body = at + 4 + head.size
        vec = np.frombuffer(raw, "<f4", numbers, body) if numbers else None
        yield seq, OPERATIONS[op], row, vec, bytes(raw[body + 4 * numbers : end]).decode(errors="replace")
        at = end + 4


def read_collection(spark: SparkSession, vectors: str, names: str | None = None, log: str | None = None) -> DataFrame:
    """(id, vec, name, deleted) of a collection's files, with its log replayed."""
    from tessera.operators.state import replay

    table = read_vector_file(spark, vectors)
    if names:
        known = read_name_file(spark, names).select("id", "name")
        table = table.join(known, "id", "left")
    else:
        table = table.withColumn("name", F.lit(""))
    table = table.select("id", F.when(~F.col("deleted"), F.col("vec")).alias("vec"), F.when(~F.col("deleted"), F.coalesce("name", F.lit(""))).alias("name"), "deleted")
    if log is None:
        return table
    first = table.where("NOT deleted").select(F.size("vec")).first()
    return replay(read_log_file(spark, log, first[0]), table) if first else table
