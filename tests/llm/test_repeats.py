import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm.queries import op6_suffix_array
from tessera.llm.repeats import merged_spans, neighbours, remove_repeats, triggers


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((kept, [tuple(x) for x in runs.reshape(-1, 2).tolist()]))
    return out


def check(spark, texts, length, stretch, ids=None, least=None, crowd=None):
    ids = ids or list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "'a' AS k1", "2 AS spans")
    found = remove_repeats(docs, length=length, passages=(least, 3) if least else None, stretch=stretch, extra=["k1"], crowd=crowd)
    plain = lambda spans: [(s.begin, s.end) for s in spans]
    got = sorted((bytes(r.text).decode(), bytes(r.kept), plain(r.spans), r.carried.k1, plain(r.passages)) for r in found.collect())
    shorter = brute(texts, least) if least else [(b"", [])] * len(texts)
    told = [[(a, b) for a, b in runs if len((t or "").encode()[a:b].split()) >= 3] for t, (_, runs) in zip(texts, shorter)]
    want = sorted((t or "", *x, "a", y) for t, x, y in zip(texts, brute(texts, length), told))
    assert got == want


def test_random_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 8)):
            if texts and rng.random() < 0.5:
                t = rng.choice(texts)
                a = rng.randrange(max(1, len(t)))
                parts.append(t[a : a + rng.choice([30, 39, 40, 41, 60, 200])])
            else:
                parts.append("".join(rng.choices("abé ", k=rng.randint(1, 120))))
        texts.append("".join(parts))
    texts += ["a" * 500, "ab" * 200, "b" * 39, "c" * 40, "c" * 40, "", None, "x" * 40, texts[0], "é" * 100]
    check(spark, texts, 40, 16)
    check(spark, texts, 60, 45, least=40 + 14)
    check(spark, texts, 60, 20, least=30, crowd=2)  # every stretch of the parse is crowded


def test_repeated_rows_and_ids(spark):
    a, b = "".join(random.Random(1).choices("abcdefgh ", k=300)), "".join(random.Random(2).choices("abcdefgh ", k=300))
    check(spark, [a, a, b, b[:150] + a[100:200]], 50, 40, ids=[7, 7, 7, None])


def test_a_common_passage_between_unique_texts(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = word(150)
    texts = [word(rng.randint(0, 90)) + passage[rng.randint(0, 5) :] + word(rng.randint(0, 90)) for _ in range(80)]
    check(spark, texts, 100, 80)
    check(spark, texts, 150, 48, least=60, crowd=30)


def test_neighbours_in_corpus_order_reach_the_longest_common_string():
    rng = random.Random(12)
    texts = [bytes(rng.choices(b"ab", k=40)) for _ in range(300)]
    group = np.sort(np.array([rng.randrange(40) for _ in texts]))
    lead = np.array([rng.randrange(12) for _ in texts])
    found = {(int(m), d): int(c) for d, members, common in neighbours(group, [memoryview(t) for t in texts], lead, 12, 20) for m, c in zip(members, common)}
    for m, t in enumerate(texts):
        for d in range(lead[m] + 1):
            best = -1
            for k, u in enumerate(texts):
                if k != m and group[k] == group[m] and lead[k] >= d and u[lead[k] - d : lead[k]] == t[lead[m] - d : lead[m]]:
                    n = 0
                    while n < 20 and lead[m] + n < 40 and lead[k] + n < 40 and t[lead[m] + n] == u[lead[k] + n]:
                        n += 1
                    best = max(best, n + d)
            if best > d:
                assert found[m, d] == best


def test_runs_of_few_words_stay(spark):
    prose = " ".join(random.Random(3).choices(["river", "stone", "of", "the", "morning"], k=40))
    one = "x" + "".join(random.Random(4).choices("abcdefgh", k=300))
    rows = [(1, f"{prose} one"), (2, f"two {prose}"), (3, f"{one} three"), (4, f"four {one}")]
    got = {r.id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=100, words=30).collect()}
    assert len(got[1]) < 10 and len(got[2]) < 10 and got[3].decode() == rows[2][1] and got[4].decode() == rows[3][1]


def test_empty_table_and_long_text(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(random.Random(4).choices("abcdefghijklmnop ", k=1_500_000))
    row = remove_repeats(spark.createDataFrame([(1, text + "#" + text[700:1200]), (2, "y")], "doc_id long, text string")).where("id = 1").first()
    assert [(s.begin, s.end) for s in row.spans] == [(700, 1200), (1_500_001, 1_500_501)]


def test_triggers_depend_on_their_string_only():
    data = np.frombuffer(bytes(random.Random(6).choices(b"abcd", k=3000)), np.uint8)
    at, first, last = triggers(data, 50, 20)
    assert first[0] == 0 and last[-1] == len(data) - 50 and (first[1:] == last[:-1] + 1).all()
    for s in range(0, 2900, 37):
        k = np.searchsorted(first, s, side="right") - 1
        own, _, _ = triggers(np.ascontiguousarray(data[s : s + 50]), 50, 20)
        assert at[k] - s == own[0]


def test_merged_spans_touching_runs_are_one():
    a, b = merged_spans(np.array([5, 0, 8, 20]), np.array([8, 3, 9, 22]))
    assert list(zip(a, b)) == [(0, 3), (5, 9), (20, 22)]


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, (kept, runs) in zip(rows, brute([r.text for r in rows], 400)):
        n = len((r.text or "").encode())
        want[r.doc_id] = (n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_suffix_array(spark, sf).collect()}
    assert got == want
    assert any(x[1] for x in want.values())
