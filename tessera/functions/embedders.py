"""What turns texts into vectors: the built-in hash, or any Python model, batch by batch."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tessera.errors import EmbedFailed
from tessera.functions.vectors import hash_embedding

#: texts -> vectors
Model = Callable[[list[str]], list[list[float]]]


#: How far from 1 the length of a vector that a search takes as it is may be.
TOLERANCE = 1e-3


def _unit(vecs: list[list[float]], normalize_to: bool) -> np.ndarray:
    """The vectors at length 1: brought to it, or refused if they are not."""
    matrix = np.array(vecs, np.float64)
    length = np.linalg.norm(matrix, axis=1)
    if not np.isfinite(matrix).all() or (length == 0).any():
        raise EmbedFailed("the model gave a vector that is zero or not finite")
    if normalize_to:
        return (matrix / length[:, None]).astype(np.float32)
    if (abs(length - 1) > TOLERANCE).any():
        raise EmbedFailed(f"the model gave a vector of length {length[abs(length - 1).argmax()]:.6f}, not 1")
    return matrix.astype(np.float32)


def embed(rows: DataFrame, dim: int, model: Model | None = None, text_col: str = "text", batch: int = 64, normalize_to: bool = True) -> DataFrame:
    """rows with `vec`. Without a model the hash embedding, which stays in the JVM; with one, each
    task calls it for `batch` texts at once. A vector of another number of elements than dim is an
    error, and so is one of another length than 1, unless normalize_to brings all to it."""
    if model is None:
        return rows.withColumn("vec", hash_embedding(text_col, dim).cast("array<float>"))
    rows = rows.drop("vec")
    out = StructType([*rows.schema.fields, StructField("vec", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                vecs = model([t or "" for t in part.column(text_col).to_pylist()])
                if len(vecs) != part.num_rows or any(len(v) != dim for v in vecs):
                    raise EmbedFailed(f"the model gave {len(vecs)} vectors for {part.num_rows} texts, or not {dim} numbers each")
                unit = list(_unit(vecs, normalize_to)) if vecs else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(unit, pa.list_(pa.float32()))], [*part.schema.names, "vec"])

    return rows.mapInArrow(run, out)


class HttpModel:
    """A model server: POST <base_url>/api/embed with {"model", "input": [...]}, answered by
    {"embeddings": [[...], ...]}."""

    def __init__(self, base_url: str, model: str, timeout: float = 60):
        self.base_url, self.model, self.timeout = base_url.rstrip("/"), model, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.base_url}/api/embed", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.load(answer)
        except (OSError, ValueError) as e:
            raise EmbedFailed(str(e)) from e
        if not isinstance(found, dict) or not isinstance(found.get("embeddings"), list):
            raise EmbedFailed("the answer has no embeddings")
        return found["embeddings"]
