import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import common
from tessera.llm.kneser_ney import Scorer, _read_counts, _write_counts, discounts, score, train
from tessera.llm.queries import op1_kneser_ney, oracle_sql


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


class Brute:
    """The same model by the book, with dictionaries."""

    def __init__(self, texts, order=3):
        self.words, raw, self.trios, self.order = Counter(), Counter(), Counter(), order
        for t in texts:
            far, before = None, "<begin>"
            for w in words(t):
                self.words[w] += 1
                raw[before, w] += 1
                if far is not None:
                    self.trios[far, before, w] += 1
                far, before = before, w
        self.pairs = raw
        if order == 3:
            self.pairs = Counter((b, c) for _, b, c in self.trios) + Counter({k: n for k, n in raw.items() if k[0] == "<begin>"})
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.follows = Counter(w for _, w in self.pairs)
        some = lambda x: discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)])
        self.d3, self.d2, self.d1 = some(self.trios), some(self.pairs), some(self.follows)

        def contexts(counts, d):
            held = defaultdict(list)
            for k, c in counts.items():
                held[k[:-1]].append(c)
            return {a: (sum(x), sum(self.less(d, c) for c in x) / sum(x)) for a, x in held.items()}

        self.contexts, self.longer = contexts(self.pairs, self.d2), contexts(self.trios, self.d3)
        self.rest = sum(self.less(self.d1, c) for c in self.follows.values()) / max(1, len(self.pairs))

    @staticmethod
    def less(d, c):
        return 0 if not c else d[min(c, 3) - 1]

    def p1(self, w):
        total = len(self.pairs)
        if not total:
            return 1 / (self.v + 1)
        return (self.follows[w] - self.less(self.d1, self.follows[w])) / total + self.rest / (self.v + 1)

    def p2(self, before, w):
        if (before,) not in self.contexts:
            return self.p1(w)
        total, weight = self.contexts[before,]
        c = self.pairs[before, w]
        return (c - self.less(self.d2, c)) / total + weight * self.p1(w)

    def p3(self, far, before, w):
        if self.order == 2 or (far, before) not in self.longer:
            return self.p2(before, w)
        total, weight = self.longer[far, before]
        c = self.trios[far, before, w]
        return (c - self.less(self.d3, c)) / total + weight * self.p2(before, w)

    def score(self, text):
        far, before, base, own, known = None, "<begin>", 0.0, 0.0, 0
        for w in words(text):
            base += math.log10((self.words[w] + 1) / (self.n + self.v + 1))
            own += math.log10(self.p3(far, before, w))
            known += self.words[w] > 0
            far, before = before, w
        return len(words(text)), known, base, own


def close(got, want):
    assert got[:2] == want[:2]
    assert got[2:] == pytest.approx(want[2:], rel=1e-9, abs=1e-6)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracle_sql()["op1_kneser_ney"])
    got = op1_kneser_ney(spark, sf).select(*want.columns)
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(want.fetchall()), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)


def test_query_equals_brute_force_and_beats_the_base(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    brute = Brute([t for i, t in rows if not out(i)])
    got = {r.doc_id: r for r in op1_kneser_ney(spark, sf).collect()}
    assert len(got) == len(rows)
    better = 0.0
    for i, t in rows:
        r = got[i]
        assert r.held_out == out(i) and r.train_tokens == brute.n
        close((r.n_tokens, r.n_known, r.base_score, r.score), brute.score(t))
        better += (r.score - r.base_score) * r.held_out
    assert better > 0


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a", "a a a b d", None, "", "c c b a e f g h a b"]
    for order in (2, 3):
        model = train(spark.createDataFrame([(t,) for t in texts], "text string"), order=order)
        scorer = Scorer(model)
        every = np.arange(-1, model.size)
        for before in [*every.tolist(), scorer.words.begin]:
            for far in [None, *every.tolist(), scorer.words.begin] if order == 3 else [None]:
                own = None if far is None else np.full(len(every), far)
                assert scorer.probability(np.full(len(every), before), every, own).sum() == pytest.approx(1)


def test_order_two_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    brute = Brute([t for _, t in rows[:100]], order=2)
    model = train(spark.createDataFrame(rows[:100], "doc_id long, text string"), order=2)
    got = {r.id: r for r in score(docs, model).collect()}
    for i, t in rows:
        close((got[i].n_tokens, got[i].n_known, got[i].base_score, got[i].score), brute.score(t))
    with pytest.raises(ValueError):
        train(docs, order=4)


def test_the_longer_order_tells_more_of_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["text"])
    held, rest = docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0")
    two, three = (score(held, train(rest, order=k)).groupBy().sum("score", "base_score").first() for k in (2, 3))
    assert three[0] > three[1] and two[0] > two[1]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "x  Y\nz"), (3, "x  Y\nz"), (None, "É é x\x1fy"), (5, "long word " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS score")
    model = train(docs)
    got = sorted(((r.id or 0), r.n_tokens, r.n_known, r.base_score, r.score) for r in score(docs, model).collect())
    brute = Brute([t for _, t in rows])
    for g, (_, t) in zip(got, sorted(rows, key=lambda r: r[0] or 0)):
        close(g[1:3] + (g[3] / g[1], g[4] / g[1]), (lambda s: s[:2] + (s[2] / s[0], s[3] / s[0]))(brute.score(t)))
    assert score(docs.limit(0), model).count() == 0


def test_model_of_an_empty_table(spark):
    model = train(spark.createDataFrame([], "text string"))
    assert (model.size, model.train_tokens) == (0, 0)
    row = score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)


def test_discounts():
    assert discounts([0, 0, 0, 0]) == [0.5, 1.0, 1.5]
    y = 100 / (100 + 2 * 40)
    assert discounts([100, 40, 20, 10]) == pytest.approx([1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5])


def test_counts_of_any_size_are_kept(tmp_path):
    for k, most in enumerate((0, 255, 256, 2**16, 2**32 - 1, 2**32, 2**40)):
        counts = np.array([1, most], np.uint64)
        _write_counts(f"{tmp_path}/{k}", counts)
        assert _read_counts(f"{tmp_path}/{k}").tolist() == [1, most]
    assert len(_read_counts(f"{tmp_path}/none")) == 0


def test_words_are_hashed_in_pieces(monkeypatch):
    texts = [b"", b"One two  three", b" ", "vier fünf".encode(), b"x" * 100, b"six\n\n", b""]
    whole = common.word_hashes(texts)
    assert whole[1].tolist() == [0, 3, 0, 2, 1, 1, 0]
    monkeypatch.setattr(common, "HASHED_BYTES", 8)
    assert all((a == b).all() for a, b in zip(common.word_hashes(texts), whole))
    assert [len(x) for x in common.word_hashes([])] == [0, 0]


def test_scoring_sorts_the_tokens_twice(spark, monkeypatch):
    """For their different words and bigrams, that is; trigrams that may be known are put in order beside it."""
    scorer = Scorer(train(spark.createDataFrame([("a b c a b d",), ("b c a",)], "text string")))
    sorted_, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **more: sorted_.append(len(x)) or unique(x, **more))
    tokens = scorer.score([b"a b c new a b", b"c new new b"])[0]
    assert tokens.tolist() == [7, 5] and sorted_ == [12, 12]
