from collections import Counter

import duckdb

import corpus_pipeline as P
from tessera.llm.queries import OP4_SQL, OP2_SQL


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "packing"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")

    good = P.good_quality(spark, docs, sf)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.select("doc_id").collect()} == {r[0] for r in con.sql(f"SELECT doc_id FROM ({OP2_SQL}) WHERE kept").fetchall()}

    unlike = P.no_near_copies(spark, good, sf)
    assert unlike.columns == docs.columns
    texts = {r.doc_id: r.text for r in good.collect()}
    kept = {r.doc_id: r.text for r in unlike.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert all(texts[i] == t for i, t in kept.items())
    assert set(kept) <= set(first.values())  # exact copies go, the smallest id stays

    cut = P.no_repeated_passages(spark, unlike, sf)
    assert cut.schema == docs.schema or cut.columns == docs.columns
    own = {r.doc_id: r for r in cut.collect()}
    data = {i: (t or "").encode() for i, t in kept.items()}
    seen = Counter(d[k : k + 200] for d in data.values() for k in range(len(d) - 199))
    for i, d in data.items():
        at = [k for k in range(len(d) - 199) if seen[d[k : k + 200]] > 1]
        runs = []
        for k in at:
            if runs and k <= runs[-1][1]:
                runs[-1][1] = k + 200
            else:
                runs.append([k, k + 200])
        keep = bytearray([1]) * len(d)
        for x, y in runs:
            if len(d[x:y].split()) >= 50:
                keep[x:y] = bytes(y - x)
        assert own[i].text == bytes(c for c, k in zip(d, keep) if k).decode("utf-8", "ignore")
        assert own[i].n_chars == len(own[i].text)
    windows = Counter(w for r in own.values() for w in {tuple(own_words[k : k + 50]) for own_words in [r.text.split()] for k in range(len(own_words) - 49)})
    assert max(windows.values()) == 1  # no 50 words in a row are left in two documents

    cut.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/cut")
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path.removeprefix('file:')}/*.parquet'")
    want = con.sql(OP4_SQL)
    got = P.packed(spark, spark.read.parquet(path), sf)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_run_and_defined_cases(spark, sf, tmp_path):
    assert P.run(spark, sf).count() > 0
    prose = lambda x: "The cat sat on the mat and it was warm in the sun for a day and {} was there to see that. ".replace("{}", x) * 4
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, prose("Ann"), "en", "s", 5), (3, prose("Ann"), "en", "s", 5), (None, prose("Bob") * 3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS quality", "2 AS id", "3 AS node", "'k' AS kept")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        for _, stage in P.STAGES:
            table = stage(spark, table, sf)
            table.write.parquet(f"{tmp_path}/{name}-{stage.__name__}")
            table = spark.read.parquet(f"{tmp_path}/{name}-{stage.__name__}")
        assert table.count() == 0 or name == "some"
