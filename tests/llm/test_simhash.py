import random
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash

from tessera.llm.common import connected_components
from tessera.llm.simhash import LONG, extended, fingerprint, flipped, paths, simhash_dedup, simhash_fingerprints, simhash_links, tallied


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    comp = brute_components(fps, links)
    return {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()}
    assert got == want


def test_links_of_chosen_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 4))))
    dense = base[0] & ~0xFFFF  # lists that stay long with six shared bytes
    fps |= {dense | rng.getrandbits(16) for _ in range(1500)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = {k: v for k, v in brute_components(signed, links).items() if any(k in x for x in links)}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    for long in (LONG, 8, 2):
        edges = simhash_links(spark.createDataFrame([(f,) for f in signed], "fp long"), long=long)
        assert groups({r.node: r.component for r in connected_components(edges).collect()}) == groups(want)


def test_lists_split_by_further_bytes_hold_every_pair():
    assert paths(1, 2) == [(0,), (1,), (2,)] and len(paths(6, 2)) == 28 and extended((1, 3), 2) == [(1, 3, 4)]
    for depth in range(1, 7):
        for shared in combinations(range(8), 6):
            assert any(set(p) <= set(shared) for p in paths(depth, 2))


def test_tally_and_flips_agree():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 2**16, 600, dtype=np.uint64) | np.uint64(0xABCDEF << 40))
    want = {(i, j) for i, j in combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert set(zip(*(x.tolist() for x in tallied(fps, np.array([0]), np.array([len(fps)]), 2)))) == want
    assert set(zip(*(x.tolist() for x in flipped(fps, [0, 1], 2)))) == want


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "one two", "x"), (4, "one two", "x"), (None, "ONE  two", None), (7, "é É", "x"), (8, "long " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "1 AS id", "2 AS component_id")
    got = [(r.id, r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()]
    assert len(got) == len(rows)
    assert {c for i, f, c in got if i in (1, 2, 3)} == {1} and {f for i, f, _ in got if i in (1, 2, 3)} == {"0" * 16}
    assert [c for i, _, c in got if i in (4, None)] == [4, 4, 4]
    assert {i: f for i, f, _ in got}[7] == f"{fingerprint('é É'.encode()):016x}"
    assert simhash_dedup(docs.limit(0)).count() == 0
    assert simhash_fingerprints(docs).columns == ["id", "fp"]


def test_ids_that_are_all_null(spark):
    got = simhash_dedup(spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [None, None]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 400)] + [(500, 500), (None, 3)]
    got = connected_components(spark.createDataFrame(pd.DataFrame(chain + star, columns=["src", "dst"]).astype("Int64").astype(object).where(lambda d: d.notna(), None).values.tolist(), "src long, dst long"))
    got = {r.node: r.component for r in got.collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}}
