import random
import tracemalloc

import numpy as np

from tessera.llm import near_copies
from tessera.llm.near_copies import block_pairs, drop_near_copies, held_shingles


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or ({b" ".join(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows, family = [], []
    for k in range(40):
        own = [word() for _ in range(rng.choice([60, 150, 400]))]
        family.append([len(rows)])
        rows.append(" ".join(own))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 90))):
                copy[rng.randrange(len(copy))] = word()
            family[-1].append(len(rows))
            rows.append(" ".join(copy))
    passage = " ".join(word() for _ in range(40))
    rows = [t + " " + passage if i % 5 == 0 and len(t) > 1500 else t for i, t in enumerate(rows)]
    return rows, family


def test_every_kept_pair_is_unlike_and_every_dropped_row_is_like_one_kept(spark):
    rows, family = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, node string").selectExpr("*", "1 AS id")
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    groups = {}
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i], rows[j]) >= 0.8:
                groups.setdefault(i, set()).add(j)
    for i in range(len(rows)):  # dropped rows are linked with a smaller one; rows like none stay
        assert i in kept or groups.get(i)
    missed = [i for i in kept if any(j in kept for j in groups.get(i, ()))]
    assert len(missed) <= 0.03 * len(groups), missed
    assert {f[0] for f in family} <= kept


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, " "), (3, long), (3, long), (None, long), (None, "only here in a row"), (None, "only here in a row"), (7, long + " end"), (8, "Short text"), (9, "short  TEXT"), (10, "short text two")]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text) == [(0, "only here in a row"), (3, long), (8, "Short text"), (10, "short text two")]
    assert [r.doc_id for r in got if not r.text] == [1]
    assert drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_texts_with_few_words_changed(spark):
    """Of pairs at 0.80 to 0.9, by length: nine in ten of each are found, nearly all in all."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows, pairs = [], {}
    for n, changed in ((50, 1), (60, 1), (80, 1), (100, 2), (150, 3), (400, 8), (1500, 30)):
        for _ in range(40 if n < 1000 else 10):
            own = [word() for _ in range(n)]
            copy = list(own)
            for k in rng.sample(range(n), changed):
                copy[k] = word()
            if jaccard(" ".join(own), " ".join(copy)) >= 0.8:
                pairs.setdefault(n, []).append(len(rows))
                rows += [" ".join(own), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert {i for own in pairs.values() for i in own} <= kept
    for n, own in pairs.items():
        assert sum(i + 1 not in kept for i in own) >= 0.9 * len(own), n
    assert sum(i + 1 not in kept for own in pairs.values() for i in own) >= 0.98 * sum(map(len, pairs.values()))


def test_no_two_near_copies_are_left_of_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in rows.collect()}
    kept = sorted(r.doc_id for r in drop_near_copies(rows).collect())
    holders, links = {}, {}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    for i, own in sets.items():
        near = {j for s in own for j in holders[s] if j < i}
        links[i] = [j for j in near if len(own & sets[j]) >= 0.8 * len(own | sets[j])]
    missed = [i for i in kept if any(j in set(kept) for j in links[i])]
    assert len(missed) <= 0.02 * sum(bool(x) for x in links.values())


def test_pairs_in_a_crowd_of_documents_are_found(spark, monkeypatch):
    """Near copies whose only part in common is one that very many documents have."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    line = [word() for _ in range(110)]
    rows = [" ".join(line + [word() for _ in range(150)]) for _ in range(30)]
    for k in range(12):  # unlike others; two of a kind are like each other by the passage and the start of what follows
        own = [word() for _ in range(24)]
        rows += [" ".join(line + own + [word() for _ in range(6)]) for _ in range(2)]
    order = rng.sample(range(len(rows)), len(rows))
    docs = spark.createDataFrame([(i, rows[k]) for i, k in enumerate(order)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    label = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            label[i] = min(label[j] for j in texts if i == j or jaccard(texts[i], texts[j]) >= 0.8)
    want = {i for i in texts if label[i] == i}
    assert len(want) < len(texts)
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    known = near_copies.part_fingerprints

    def one_part(hashes):  # all documents have the same part, and no other
        return known(hashes)[0], [7]

    monkeypatch.setattr(near_copies, "part_fingerprints", one_part)
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == want


def test_bound_on_shingles_in_common_loses_none():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**64, n, np.uint64) for n in (20, 90, 400, 3000)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.92], rng.integers(0, 2**64, len(b) // 20, np.uint64)])) for b in base for _ in range(12)]
    n, held = np.array([len(x) for x in sets]), np.stack([held_shingles(x) for x in sets])
    like = {(i, j) for j in range(len(sets)) for i in range(j) if (b := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (n[i] + n[j] - b)}
    zero, group = np.zeros(len(sets), np.int64), np.arange(len(sets))
    got = set(zip(*(x.tolist() for x in block_pairs(zero, n, group, held, None, 0.8, None))))
    assert like and like <= got and len(got) < len(sets) ** 2 // 4
    side = np.arange(len(sets)) % 2
    assert {p for p in like if side[p[0]] != side[p[1]]} <= {tuple(sorted(p)) for p in zip(*(x.tolist() for x in block_pairs(zero, n, group, held, side, 0.8, None)))}
    i, j = block_pairs(zero, n, group // 12, held, None, 0.8, 1)
    assert len(i) == 0 and len(block_pairs(zero, n, group % 12, held, None, 0.8, 1)[0]) <= 66


def test_pairs_of_two_full_blocks_are_never_held_at_once(spark, monkeypatch):
    """Documents that can all be near copies of each other: parts hold what the whole holds."""
    rng = np.random.default_rng(1)
    m = 3000
    common = np.bincount(rng.integers(0, 256, 840), minlength=256)
    held = np.stack([common + np.bincount(rng.integers(0, 256, 160), minlength=256) for _ in range(m)]).astype("<u2")
    n, fp, group, side = np.full(m, 1000), np.zeros(m, np.int64), np.arange(m), np.arange(m) % 2
    want = {}
    for best in (None, 2):  # each a group of its own: no pair of groups has more than one
        tracemalloc.start()
        count = total = 0
        for i, j, _ in near_copies.pair_parts(fp, n, group, held, side, 0.8, best):
            assert len(i) <= near_copies.PAIRS + (1 << 14)
            count, total = count + len(i), total + int((i * m + j).sum())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want[best] = count, total
        assert peak < 64e6, (best, peak)
    assert want[None] == want[2] and want[None][0] > 0.9 * (m // 2) ** 2
    i, j = block_pairs(fp, n, group, held, side, 0.8, None)
    assert (len(i), int((i * m + j).sum())) == want[None] and len(np.unique(i * m + j)) == len(i)
    # few groups: at most so many of any two of them
    i, j = block_pairs(fp, n, group % 5, held, side, 0.8, 2)
    assert len(i) == 20 and (i % 5 != j % 5).all()
    # the stage gives the same rows whatever the size of a part
    texts, _ = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "part_fingerprints", lambda hashes, known=near_copies.part_fingerprints: (known(hashes)[0], [7]))
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    monkeypatch.setattr(near_copies, "pair_parts", lambda *args, known=near_copies.pair_parts: known(*args, most=3))
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == kept
