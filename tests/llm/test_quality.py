import math

import duckdb
import pytest

from tessera.llm.quality import RULES, fit, quality_rules
from tessera.llm.queries import op2_quality, oracle_sql

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    flat = text
    for c in "\t\n\x0b\x0c\r":
        flat = flat.replace(c, " ")
    w = [x for x in flat.split(" ") if x]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= {i, i + 1, i + 2}
    repeat = len(covered)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w))


@pytest.fixture(scope="module")
def odd_rows():
    prose = "The cat sat on the mat and it was warm in the sun for a day. " * 2
    many = " ".join(f"w{i % 97} x{i % 89}" for i in range(900))  # over 64 different repeated windows
    return [
        (1, None, "q"), (2, "", "q"), (3, " \n\t\r", "q"), (4, "a", "q"), (5, "a b a b a b", "q"), (6, prose, "q"), (6, prose, "q"), (None, prose, None),
        (7, "\n".join(["same line here"] * 40), "q"), (8, many + "\n" + many, "q"), (9, "É ÈÊ 😀 x\x1fy " * 30, "q"), (10, "A!! B|| C%% " * 60, "q"), (11, "x y z\n\nx y z\n \nq", "q"),
    ]


def test_measures_equal_brute_force(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, quality string").selectExpr("*", "1 AS n_words", "2 AS _quality_t")
    got = quality_rules(docs)
    assert got.columns == [*docs.columns, "_quality"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert tuple(r["_quality"][f] for f in FIELDS) == brute(r.text), r.text and r.text[:50]
        assert r["_quality"].kept == (not r["_quality"].base_failed and r["_quality"].posterior >= 0.5)


def test_a_very_long_text_is_judged_whole(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + " tail tail tail tail"
    row = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().quality
    assert (row.n_words, row.n_repeat_words) == (200_004, 4)


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_separates_kinds_of_junk_that_share_no_rule():
    n = len(RULES)
    good = tuple([1] * n)
    kinds = [(good, 900), ((1, -1, 1, -1, -1, 1, 1), 40), ((1, 1, -1, -1, 1, 1, -1), 40), ((-1, -1, 1, 0, 1, 1, 1), 20)]
    prior, g, b = fit(kinds)
    assert abs(prior - 0.9) < 0.05
    weigh = lambda v: math.log(prior / (1 - prior)) + sum(math.log(x / (1 - y)) if s > 0 else math.log((1 - x) / y) if s < 0 else 0 for s, x, y in zip(v, g, b))
    assert weigh(good) > 0 and all(weigh(v) < 0 for v, _ in kinds[1:])
    assert all(x + y >= 1 - 1e-12 for x, y in zip(g, b))


def test_query_equals_sql_and_labels(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracle_sql()["op2_quality"])
    got = op2_quality(spark, sf)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in got.collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in rows) >= 0.97 * len(rows)
    assert all(r.kept for r in rows if labels[r.doc_id])
