"""The rows of a collection from its operation log, and figures of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPLOG = "seq long, op string, id long, vec array<float>, name string"
VECTORS = "id long, vec array<float>, name string, deleted boolean"


def replay(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(id, vec, name, deleted) after all operations, whatever order the rows of log are in.

    log: (seq, op, id, vec, name), op one of insert, delete, replace, rename. An insert of a live id
    is skipped, so that replaying a part twice changes nothing; one of a deleted id brings it back;
    a delete of a dead id, a replace and a rename of one do nothing; a replace without a name, or
    with an empty one, keeps the name, a rename keeps the vector and takes any name, the empty one
    too. A snapshot counts as what was there before the first operation.

    The log is reduced by aggregations with map-side combining only: the last delete of each id,
    the first insert after it, and the last vector and name from there on.
    """
    log = log.select("seq", "op", "id", "vec", F.when((F.col("op") == "replace") & (F.col("name") == ""), F.lit(None)).otherwise(F.col("name")).alias("name"))
    if snapshot is not None:
        first = snapshot.select(F.lit(-1).cast("long").alias("seq"), F.when(F.col("deleted"), "delete").otherwise("insert").alias("op"), "id", "vec", "name")
        log = first.union(log)
    is_op = lambda op: F.col("op") == op
    dead = log.groupBy("id").agg(F.max(F.when(is_op("delete"), F.col("seq"))).alias("dead"))
    since = log.join(dead, "id").where(is_op("insert") & (F.col("dead").isNull() | (F.col("seq") > F.col("dead"))))
    born = since.groupBy("id").agg(F.min("seq").alias("born"))
    alive = log.join(born, "id").where((F.col("seq") == F.col("born")) | (F.col("op").isin("replace", "rename") & (F.col("seq") > F.col("born"))))
    state = alive.groupBy("id").agg(
        F.max_by("vec", F.when(F.col("vec").isNotNull(), F.col("seq"))).alias("vec"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name")
    )
    gone = dead.where("dead IS NOT NULL").join(born, "id", "left_anti").select("id", F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("deleted"))
    return state.select("id", "vec", "name", F.lit(False).alias("deleted")).union(gone)


def divergent(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(id) of the log that a history without gaps can't have: new ids are given one after the
    other, so every id up to the highest of the log was inserted there or is in the snapshot."""
    high = log.where("op = 'insert'").agg(F.max("id").alias("high"))
    known = log.where("op = 'insert'").select("id")
    if snapshot is not None:
        known = known.union(snapshot.select("id"))
    known = known.distinct()
    # what follows a gap: an id whose predecessor is not there
    after = known.join(known.select((F.col("id") + 1).alias("id")), "id", "left_anti").where("id > 0")
    strange = log.where("op <> 'insert'").select("id").distinct().join(known, "id", "left_anti")
    return after.join(high, F.col("id") <= F.col("high")).select("id").union(strange)


def stats(vectors: DataFrame) -> DataFrame:
    """One row: dim, live_count, deleted_count, high_water (highest id ever, plus one)."""
    alive = ~F.col("deleted")
    return vectors.agg(
        F.max(F.when(alive, F.size("vec"))).alias("dim"),
        F.count_if(alive).alias("live_count"),
        F.count_if(F.col("deleted")).alias("deleted_count"),
        F.coalesce(F.max("id") + 1, F.lit(0)).alias("high_water"),
    )
