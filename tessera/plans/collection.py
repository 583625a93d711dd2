"""A collection of vectors in a folder: a versioned snapshot and the operations since.

Operations go to an append-only log in batches; the state is the snapshot with the log replayed
over it, so a crash loses nothing that was appended, and replaying a batch twice changes nothing.
snapshot() writes the state and the graph as a new version and moves a pointer; the log below it is
then deleted. Where few rows have changed the graph of the last snapshot is kept up, otherwise it
is built anew. Ids are given once; only insert_at brings a deleted one back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.errors import DimMismatch, InvalidId, OutOfCapacity, ReplayDivergent, SlotOccupied, TextTooLong
from tessera.functions.embedders import Model, embed
from tessera.operators import exact, graph, state
from tessera.sources import snapshot as store

_NEW = "id long, vec array<float>, name string"
#: Bytes of a name.
LONGEST_NAME = 65_535
#: Share of changed rows up to which the graph is kept up.
UPKEEP = 0.2


class Collection:
    def __init__(self, spark: SparkSession, root: str, dim: int, max_vectors: int | None = None, max_text_bytes: int = 65_535, model: Model | None = None, m: int = 16, ef_construction: int = 200, max_ef: int = 512, seed: int = 42, snapshot_every: int = 0, normalize: bool = True):
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim
        self.max_vectors, self.max_text_bytes, self.model = max_vectors, max_text_bytes, model
        self.m, self.ef_construction, self.max_ef, self.seed = m, ef_construction, max_ef, seed
        self.snapshot_every, self.normalize = snapshot_every, normalize
        held = self.vectors().agg(F.max(F.size("vec"))).first()[0]
        if held not in (None, dim):
            raise DimMismatch(f"the collection has {held} numbers a vector, not {dim}")

    # state

    def _log_path(self, version: int | None = None) -> str:
        return f"{self.root}/log/v{store.current(self.spark, self.root) if version is None else version}"

    def log(self) -> DataFrame:
        path = self._log_path()
        if not store.exists(self.spark, path):
            return self.spark.createDataFrame([], state.OPLOG)
        return self.spark.read.schema(state.OPLOG).parquet(path)

    def vectors(self) -> DataFrame:
        """(id, vec, name, deleted)"""
        old = store.load(self.spark, self.root, "vectors") if store.current(self.spark, self.root) else None
        return state.replay(self.log(), old)

    def verify(self) -> None:
        """Refuses a log that can't follow the snapshot."""
        old = store.load(self.spark, self.root, "vectors") if store.current(self.spark, self.root) else None
        if (bad := state.divergent(self.log(), old).first()) is not None:
            raise ReplayDivergent(f"the log and the snapshot disagree about id {bad.id}")

    def _append(self, ops: DataFrame) -> None:
        """ops: (op, id, vec, name), numbered on from the last operation, in the order of their ids.

        Every snapshot_every operations, a snapshot is taken (0: never by itself).
        """
        last = self.log().agg(F.max("seq")).first()[0]
        first = 0 if last is None else last + 1
        numbered = store.numbered(ops.select("op", "id", "vec", "name"), "seq", first)
        numbered.select("seq", "op", "id", F.col("vec").cast("array<float>").alias("vec"), "name").write.mode("append").parquet(self._log_path())
        if self.snapshot_every and self.log().count() >= self.snapshot_every:
            self.snapshot()

    def _one(self, op: str, row_id: int, vec: list[float] | None, name: str | None) -> None:
        if name and len(name.encode()) > LONGEST_NAME:
            raise TextTooLong(f"a name of {len(name.encode())} bytes, over {LONGEST_NAME}")
        row = self.spark.createDataFrame([(row_id, vec, name)], _NEW)
        self._append(row.select(F.lit(op).alias("op"), "id", "vec", "name"))

    def _check(self, vec: list[float]) -> list[float]:
        if len(vec) != self.dim:
            raise DimMismatch(f"{len(vec)} numbers, not {self.dim}")
        return [float(x) for x in vec]

    def _check_live(self, row_id: int) -> None:
        if exact.live(self.vectors()).where(F.col("id") == row_id).isEmpty():
            raise InvalidId(str(row_id))

    def _embedded(self, text: str) -> list[float]:
        if len(text.encode()) > self.max_text_bytes:
            raise TextTooLong(f"{len(text.encode())} bytes, over {self.max_text_bytes}")
        return embed(self.spark.createDataFrame([(text,)], "text string"), self.dim, self.model, normalize_to=self.normalize).first().vec

    # verbs

    def ping(self) -> bool:
        return True

    def stats(self) -> dict:
        vectors = self.vectors()
        row = state.stats(vectors).first().asDict()
        entry = graph.entry_point(vectors, self.seed, self.m).first()
        upper = graph.levels(vectors, self.seed, self.m).agg(F.sum("level")).first()[0] or 0
        return row | {"dim": self.dim, "m": self.m, "upper_used": upper, "max_level": entry.level if entry else 0, "has_entry_point": entry is not None}

    def next_id(self) -> int:
        return state.stats(self.vectors()).first().high_water

    def insert(self, vec: list[float], name: str = "") -> int:
        vec = self._check(vec)
        row = state.stats(self.vectors()).first()
        if self.max_vectors is not None and row.live_count >= self.max_vectors:
            raise OutOfCapacity(f"{row.live_count} vectors")
        self._one("insert", row.high_water, vec, name)
        return row.high_water

    def insert_text(self, text: str) -> int:
        vec = self._embedded(text)
        return self.insert(vec, text.encode()[:256].decode(errors="ignore"))

    def insert_many(self, rows: DataFrame) -> int:
        """rows: (vec, name), in a batch of any size; returns how many."""
        bad = rows.where(F.col("vec").isNull() | (F.size("vec") != self.dim)).limit(1).count()
        if bad:
            raise DimMismatch(f"not all vectors have {self.dim} numbers")
        if not rows.where(F.octet_length("name") > LONGEST_NAME).isEmpty():
            raise TextTooLong(f"a name of over {LONGEST_NAME} bytes")
        row, n = state.stats(self.vectors()).first(), rows.count()
        if self.max_vectors is not None and row.live_count + n > self.max_vectors:
            raise OutOfCapacity(f"{row.live_count} vectors and {n} more")
        first = row.high_water
        self._append(store.numbered(rows.select("vec", "name"), "id", first).withColumn("op", F.lit("insert")))
        return n

    def insert_texts(self, rows: DataFrame) -> int:
        """rows: (text), embedded by the tasks."""
        if not rows.where(F.octet_length("text") > self.max_text_bytes).isEmpty():
            raise TextTooLong(f"over {self.max_text_bytes} bytes")
        named = embed(rows.select("text"), self.dim, self.model, normalize_to=self.normalize)
        return self.insert_many(named.select("vec", F.expr("make_valid_utf8(CAST(substring(CAST(text AS BINARY), 1, 256) AS STRING))").alias("name")))

    def insert_at(self, row_id: int, vec: list[float], name: str = "") -> None:
        """Brings a deleted id back with a new vector."""
        vec = self._check(vec)
        row = self.vectors().where(F.col("id") == row_id).select("deleted").first()
        if row is None:
            raise InvalidId(str(row_id))
        if not row.deleted:
            raise SlotOccupied(str(row_id))
        self._one("insert", row_id, vec, name)

    def set_name(self, row_id: int, name: str) -> None:
        self._check_live(row_id)
        self._one("rename", row_id, None, name)

    def delete_name(self, row_id: int) -> None:
        self.set_name(row_id, "")

    def get_name(self, row_id: int) -> str:
        return self.get(row_id)[0]

    def build(self, rows: DataFrame) -> int:
        """A collection of rows (vec, name) alone, whatever was there: returns how many."""
        if not rows.where(F.col("vec").isNull() | (F.size("vec") != self.dim)).isEmpty():
            raise DimMismatch(f"not all vectors have {self.dim} numbers")
        n = rows.count()
        if self.max_vectors is not None and n > self.max_vectors:
            raise OutOfCapacity(f"{n} vectors")
        fresh = store.numbered(rows.select("vec", "name"), "id", 0).select("id", F.col("vec").cast("array<float>").alias("vec"), "name", F.lit(False).alias("deleted"))
        self._save(fresh, lambda kept: graph.build_graph(kept, self.m, self.ef_construction, self.seed))
        return n

    def take_over(self, vectors: DataFrame) -> int:
        """The rows (id, vec, name, deleted) with their ids, in place of whatever was there."""
        if not vectors.where(~F.col("deleted") & (F.size("vec") != self.dim)).isEmpty():
            raise DimMismatch(f"not all vectors have {self.dim} numbers")
        return self._save(vectors, lambda kept: graph.build_graph(kept, self.m, self.ef_construction, self.seed))

    def delete(self, row_id: int) -> None:
        self._check_live(row_id)
        self._one("delete", row_id, None, None)

    def replace(self, row_id: int, vec: list[float], name: str | None = None) -> None:
        """Without a name the row keeps its own."""
        vec = self._check(vec)
        self._check_live(row_id)
        self._one("replace", row_id, vec, name)

    def replace_text(self, row_id: int, text: str) -> None:
        self.replace(row_id, self._embedded(text), text.encode()[:256].decode(errors="ignore"))

    def get(self, row_id: int) -> tuple[str, list[float]]:
        row = exact.live(self.vectors()).where(F.col("id") == row_id).first()
        if row is None:
            raise InvalidId(str(row_id))
        return row.name or "", row.vec

    def search(self, vec: list[float], top_k: int = 5, ef: int | None = None, method: str = "exact") -> list[tuple[int, float, str]]:
        queries = self.spark.createDataFrame([(0, self._check(vec))], "qid long, vec array<float>")
        found = self.search_many(queries, top_k, ef, method).orderBy("rk").collect()
        return [(r.id, r.dist, r.name) for r in found]

    def search_text(self, text: str, top_k: int = 5, ef: int | None = None, method: str = "exact") -> list[tuple[int, float, str]]:
        graph.check_search(top_k, max(top_k, 10) if ef is None else ef, self.max_ef)
        return self.search(self._embedded(text), top_k, ef, method)

    def search_many(self, queries: DataFrame, top_k: int = 5, ef: int | None = None, method: str = "exact") -> DataFrame:
        """(qid, rk, id, dist, name) for each row (qid, vec). method: exact, or graph for the graph
        of the last snapshot with what changed since compared exactly."""
        ef = max(top_k, 10) if ef is None else ef
        graph.check_search(top_k, ef, self.max_ef)
        vectors = self.vectors()
        if method == "exact" or not store.current(self.spark, self.root):
            return exact.with_names(exact.knn_join(vectors, queries, top_k), vectors)
        old = store.load(self.spark, self.root, "vectors")
        changed = self.log().select("id").distinct()
        still = old.join(changed.withColumn("changed", F.lit(True)), "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("changed", F.lit(False)))
        edges = store.load(self.spark, self.root, "graph")
        a = graph.graph_search(edges, still.where("vec IS NOT NULL"), queries, top_k, ef)
        b = exact.knn_join(vectors.join(changed, "id"), queries, top_k)
        both = a.select("qid", "id", "dist").union(b.select("qid", "id", "dist"))
        ranked = both.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))).where(F.col("rk") <= top_k)
        return exact.with_names(ranked.select("qid", "rk", "id", "dist"), vectors)

    def snapshot(self, with_graph: bool = True) -> int:
        return self._save(self.vectors(), self._graph if with_graph else None)

    def _save(self, vectors: DataFrame, edges) -> int:
        """A new version of the table and of the graph that edges(table) gives; the log goes."""
        before = store.current(self.spark, self.root)
        path = f"{self.root}/pending/{uuid.uuid4().hex}"  # read by both tables, and replayed once
        vectors.write.parquet(path)
        kept = self.spark.read.schema(vectors.schema).parquet(path)
        tables = {"vectors": kept}
        if edges is not None:
            tables["graph"] = edges(kept)
        version = store.save(self.root, tables, {"graph": ["layer"]})
        store.prune(self.spark, self.root)
        for old in (self._log_path(before), f"{self.root}/pending"):
            fs, p = store._fs(self.spark, old)
            fs.delete(p, True)
        return version

    def _graph(self, vectors: DataFrame) -> DataFrame:
        """The graph of the last snapshot without what went and with what came, or a new one."""
        args = self.m, self.ef_construction
        version = store.current(self.spark, self.root)
        alive, changed = exact.live(vectors), self.log().select("id").distinct()
        if not version or not store.exists(self.spark, f"{self.root}/v{version}/graph") or changed.count() > UPKEEP * alive.count():
            return graph.build_graph(vectors, *args, self.seed)
        old = store.load(self.spark, self.root, "graph").select(F.col("layer").cast("int").alias("layer"), "id", "nbrs")
        stay = alive.join(changed, "id", "left_anti")
        return graph.add_nodes(store.scratch(graph.remove_nodes(old, stay, changed, *args), "kept"), alive, alive.join(changed, "id", "left_semi"), *args, self.seed)
