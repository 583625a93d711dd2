"""A corpus made ready for training: quality rules, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the docs of the next; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, stored
from tessera.llm.near_copies import drop_near_copies
from tessera.llm.packing import pack, with_tokens
from tessera.llm.quality import quality_rules
from tessera.llm.repeats import remove_repeats


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    judged = quality_rules(docs)
    verdict = free_name("quality", docs.columns)
    return judged.where(F.col(verdict)["kept"]).drop(verdict)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return drop_near_copies(docs, words=5, similarity=0.8)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without passages of 50 words or more, of 200 bytes or more, that occur anywhere else too.

    A cut inside a character of several bytes takes the rest of that character as well. n_chars is
    that of the new text. All documents stay, those with an empty text too.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, length=200, words=50, extra=rest)
    text = F.expr("try_validate_utf8(CAST(kept AS STRING))")
    text = F.coalesce(text, F.replace(F.expr("make_valid_utf8(CAST(kept AS STRING))"), F.lit("�"), F.lit("")))
    own = {c: F.col("carried")[c] for c in rest} | {"doc_id": F.col("id"), "text": text}
    if "n_chars" in rest:
        own["n_chars"] = F.length(text)
    return cut.select(*(own[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: length buckets with the least padding, batches of 65,536 tokens."""
    lengths = stored(with_tokens(docs).select("doc_id", "n_tokens"), "lengths")
    return pack(lengths, "n_tokens", ["doc_id"], buckets=16, budget=65_536)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_quality),
    ("SimHash near-dedup", no_near_copies),
    ("suffix-array dedup", no_repeated_passages),
    ("packing", packed),
]

#: Near copies and cut texts can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
