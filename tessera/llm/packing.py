"""Length buckets with the least padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import SPACE_CLASS, free_name, stored

#: Rows a task numbers; the slices follow the number of rows.
SLICE = 20_000


def optimal_buckets(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> tuple[list[int], int]:
    """(upper bounds of the buckets, ascending; padding) for a histogram of lengths, ascending.

    Every length goes to the least bound not under it, and is padded to that; no choice of at most
    `buckets` bounds has less padding in all. Among equal choices, each bucket from the last one
    on begins as early as it can. Dynamic programming over (bounds, lengths); the best split moves
    right with the length, so each layer is solved by divide and conquer.
    """
    size, n = np.asarray(lengths, np.int64), len(lengths)
    if not n:
        return [], 0
    rows = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    total = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64) * size)])
    best = size * rows[1:] - total[1:]  # one bucket for lengths 0..i
    splits = []
    for _ in range(min(buckets, n) - 1):
        new, split = best.copy(), np.zeros(n, np.int64)  # split 0: the bucket begins with the first length
        todo = [(1, n - 1, 1, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            i = (lo + hi) // 2
            j = np.arange(a, min(b, i) + 1)  # the last bucket holds lengths j..i
            cost = best[j - 1] + size[i] * (rows[i + 1] - rows[j]) - (total[i + 1] - total[j])
            k = int(np.argmin(cost))
            if cost[k] < new[i]:
                new[i], split[i] = cost[k], j[k]
            todo += [(lo, i - 1, a, j[k]), (i + 1, hi, j[k], b)]
        best = new
        splits.append(split)
    bounds, i = [int(size[-1])], n - 1
    for split in reversed(splits):
        if split[i]:
            i = split[i] - 1
            bounds.append(int(size[i]))
    return bounds[::-1], int(best[-1])


def with_tokens(docs: DataFrame, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of words of the whole text (null: 0), plus one for its end."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), f"[{SPACE_CLASS}]+"), ""))
    return docs.withColumn(name, (words + 1).cast("long"))


def pack(rows: DataFrame, tokens_col: str, order_cols: list[str], buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """rows with bucket (from 0), bucket_tokens, batch and slot.

    bucket_tokens is the bucket's bound, to which every sequence in it is padded. The rows of a
    bucket, by order_cols (nulls first, repeated rows one after the other), go to batches
    0, 1, ... of budget // bucket_tokens sequences, one at least; the last batch of a bucket may
    be short. A null length counts as 0, and a length of 0 is a sequence without tokens. Columns of
    rows with these names are replaced. An empty table gives an empty result.

    The driver gets the histogram: one row for each different length, the square of whose number
    is at most twice the tokens of all rows. Rows are numbered in slices of a range partitioning,
    ties dealt out by their number in the input, so no bucket is ever gathered in one task.
    """
    names = ["bucket", "bucket_tokens", "batch", "slot"]
    kept = [c for c in rows.columns if c.lower() not in names]
    length = free_name("_tokens", kept)
    rows = rows.select(*(f"`{c}`" for c in kept), F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(0)).alias(length))
    histogram = sorted((r[0], r[1]) for r in rows.groupBy(length).count().collect())
    bounds, _ = optimal_buckets([x for x, _ in histogram], [c for _, c in histogram], buckets)
    slices = max(1, -(-sum(c for _, c in histogram) // SLICE))
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + F.when(F.col(length) > b, 1).otherwise(0)
    part, row, before, tie = (free_name(f"_{x}", kept) for x in ("part", "row", "before", "tie"))
    order = [*(F.col(f"`{c}`").asc_nulls_first() for c in order_cols), F.col(tie)]
    sliced = rows.withColumn(tie, F.monotonically_increasing_id()).withColumn("bucket", bucket)
    sliced = stored(sliced.repartitionByRange(slices, "bucket", *order).withColumn(part, F.spark_partition_id()), "packing")
    sizes = sliced.groupBy("bucket", part).count()  # a row for each slice and bucket
    earlier = Window.partitionBy("bucket").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("bucket", part, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before)), "packing-starts")
    numbered = sliced.withColumn(row, F.row_number().over(Window.partitionBy("bucket", part).orderBy(*order)))
    numbered = numbered.join(starts, ["bucket", part])
    bound = F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds or [0])), F.col("bucket") + 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1)))).cast("long")
    place = F.col(before) + F.col(row) - 1
    return numbered.select(
        *(f"`{c}`" for c in kept),
        "bucket",
        bound.alias("bucket_tokens"),
        F.floor(place / each).cast("long").alias("batch"),
        (place % each).cast("long").alias("slot"),
    )
