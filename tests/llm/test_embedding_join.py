import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.embedding_join import link_vectors, near_vectors, rotation, _binary
from tessera.llm.queries import op3_embedding_join


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good]) if good else np.zeros((0, 1))
    near = (unit @ unit.T >= cosine) & ~np.eye(len(good), dtype=bool)
    comp = np.arange(len(good))
    for _ in range(len(good)):
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(good))])
        if (new == comp).all():
            break
        comp = new
    ids = [i for i, _ in good]
    least = {c: min(ids[k] for k in range(len(ids)) if comp[k] == c) for c in set(comp.tolist())}
    out = {i: (0, i, True) for i, _ in rows if i is not None}
    out |= {i: (int(near[k].sum()), least[comp[k]], least[comp[k]] == i) for k, i in enumerate(ids)}
    return out


def check(spark, rows, kind="float", tile=2048):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS id", "2 AS n_links", "'x' AS vec")
    got = near_vectors(df, tile=tile).collect()
    assert len(got) == len(rows)
    assert {r.id: tuple(r)[1:] for r in got if r.id is not None} == brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert all(tuple(r)[1:] == (0, None, False) for r in got if r.id is None)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    rows = [centres[rng.integers(len(centres))] + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.32, 0.6]) for _ in range(n)]
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(n), rows)]


@pytest.mark.parametrize("dim,tile", [(64, 2048), (16, 20), (3, 15), (1, 10)])
def test_clusters_equal_brute_force(spark, dim, tile):
    check(spark, clustered(300, dim, dim), "double" if dim == 16 else "float", tile)


def test_a_large_group_over_many_tiles(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + rng.standard_normal(32) * (0.25 if i % 3 else 1)).tolist()) for i in range(250)]
    check(spark, rows + [(1000 + i, centre.tolist()) for i in range(40)], "double", 25)


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    odd = [(1, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, math.nan, 3.0]), (8, [math.inf, 2.0, 3.0]), (9, [2.0, 4.0, 6.0]), (None, v), (10, [-1.0, -2.0, -3.0])]
    check(spark, odd)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.01])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors(df).collect())) == [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)]
    assert near_vectors(df.limit(0)).count() == 0
    unlike = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.1, 0.0]), (1, [0.0, 0.0, 1.0]), (0, [0.0, 0.1, 1.0]), (2, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, near_vectors(unlike).collect())) == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_a_pair_is_counted_once_whatever_blocks_find_it(spark):
    rows = clustered(200, 24, 3)
    packed, kind = _binary(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = link_vectors(packed.where("vec IS NOT NULL").withColumn("weight", F.lit(1).cast("long")), kind, 24, tile=30)
    want = brute(rows)
    assert {r.id: r.n for r in got.groupBy("id").agg(F.sum("links").alias("n")).where("n > 0").collect()} == {i: n for i, (n, _, _) in want.items() if n}


def test_vectors_are_not_dealt_out_to_the_cells_they_visit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)] + clustered(300, 16, 6)
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    packed, kind = _binary(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = link_vectors(packed.withColumn("weight", F.lit(1).cast("long")), kind, 16, tile=40)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = brute(spark.createDataFrame(rows, "vec_id long, embedding array<float>").collect())
    assert {r.id: r.n for r in got.groupBy("id").agg(F.sum("links").alias("n")).where("n > 0").collect()} == {i: n for i, (n, _, _) in want.items() if n}


def test_rotation_is_orthogonal():
    r = rotation(20)
    assert np.allclose(r @ r.T, np.eye(20))


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r.vec_id: tuple(r)[1:] for r in op3_embedding_join(spark, sf).collect()} == brute(rows)
