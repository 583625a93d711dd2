import itertools
import random

import duckdb
import pytest

from tessera.llm.packing import optimal_buckets, pack, with_tokens
from tessera.llm.queries import op4_packing, oracle_sql


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(8))
def test_buckets_equal_brute_force(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 11)))
    counts = [rng.randint(1, 50) for _ in lengths]
    for k in range(1, 6):
        bounds, pad = optimal_buckets(lengths, counts, k)
        assert len(bounds) <= k and bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1]
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
        assert pad == best == padding(lengths, counts, bounds)


def test_no_lengths():
    assert optimal_buckets([], [], 4) == ([], 0)


def test_batches_keep_the_budget_and_every_row(spark):
    rng = random.Random(0)
    rows = [(rng.randint(0, 300) if i % 7 else None, None if i % 50 == 3 else int(rng.paretovariate(1) * 5) + 1, "b") for i in range(3000)]
    rows += [(5, 110_649, "b"), (5, 110_650, "b"), (6, 0, "b")]
    df = spark.createDataFrame(rows, "doc_id long, n long, batch string").selectExpr("*", "1 AS _tokens", "2 AS _row")
    got = pack(df, "n", ["doc_id"], buckets=5, budget=256).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.n or -1) for r in got) == sorted((r[0] or -1, r[1] or -1) for r in rows)
    slots = {}
    for r in got:
        assert (r.n or 0) <= r.bucket_tokens
        slots.setdefault((r.bucket, r.batch), []).append(r)
    for (b, k), own in slots.items():
        each = max(1, 256 // max(1, own[0].bucket_tokens))
        last = max(x for y, x in slots if y == b)
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) == each or k == last and len(own) <= each
    order = {b: [r.doc_id for r in sorted((r for r in got if r.bucket == b), key=lambda r: (r.batch, r.slot))] for b in {r.bucket for r in got}}
    for ids in order.values():
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_empty_table_and_tokens(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(with_tokens(empty), "n_tokens", ["doc_id"]).count() == 0
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " a\tb\n"), (4, "x " * 300_000)], "doc_id long, text string")
    assert [r.n_tokens for r in with_tokens(rows).orderBy("doc_id").collect()] == [1, 1, 3, 300_001]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracle_sql()["op4_packing"])
    assert sorted(map(tuple, op4_packing(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())


def test_long_lengths_are_told_apart(spark):
    lengths = [40_000 + 7 * k for k in range(40)] + [900_001, 900_002]
    got = pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long"), "n", ["doc_id"], buckets=6, budget=10**6).collect()
    bounds, least = optimal_buckets(lengths, [1] * len(lengths), 6)
    assert {r.bucket_tokens for r in got} == set(bounds) <= set(lengths) and sum(r.bucket_tokens - r.n for r in got) == least


def test_equal_keys_fill_many_slices(spark, monkeypatch):
    import tessera.llm.packing as packing

    monkeypatch.setattr(packing, "SLICE", 50)
    got = pack(spark.range(1000).selectExpr("CAST(NULL AS LONG) AS doc_id", "5L AS n"), "n", ["doc_id"], budget=35).collect()
    assert sorted((r.batch, r.slot) for r in got) == [(k // 7, k % 7) for k in range(1000)]
