"""SimHash near-duplicates through an inverted index over the bytes of the fingerprints.

Two fingerprints of eight bytes that differ in two bits share six bytes at the same positions at
least. The index lists, for a position and a byte, the fingerprints that have it there; of a pair
that shares six, the first such position is one of the first three, so the lists of these will do.
In a list the shared positional bytes of each pair are tallied, and pairs that reach the six are
verified by their bits.

A list of more than LONG fingerprints is split by the byte at the next position, at the next but
one, and so on, as far as the pairs that reach the six need it (all in all two positions may be
left out); this goes on until lists are short or the bytes they share are six, when every pair has
reached the count. Lists of so many shared bytes are verified by looking up each flip of two bits
in the bytes that are left. How deep the lists begin is chosen by the number of fingerprints; it
changes the cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, ids_and_text, local_components, stored

SEED = 42
BYTES = 8
#: Fingerprints in a list whose pairs are tallied; longer lists are split by further bytes.
LONG = 256


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, in order; fewer words: of all of them together."""
    tokens = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts words
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(length) + np.arange(len(tokens))
    begins, ends = (end - length).tolist(), end[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends)], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text, as unsigned 64-bit number; 0 without words."""
    return _majority(shingle_hashes(text, words))


def _majority(hashes: np.ndarray) -> int:
    votes, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, len(hashes), step):
        part = hashes[k : k + step].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id long, fp long) for every row. Null texts and texts without words have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = ids_and_text(docs, id_col, text_col).select("id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def extended(path: tuple[int, ...], bits: int) -> list[tuple[int, ...]]:
    """The positions of a list with one more: pairs that share all but `bits` leave out no more."""
    return [(*path, q) for q in range(path[-1] + 1 if path else 0, len(path) + bits + 1)]


def paths(depth: int, bits: int) -> list[tuple[int, ...]]:
    """The positions of all lists of so many shared bytes."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(depth):
        out = [q for p in out for q in extended(p, bits)]
    return out


def tallied(fps: np.ndarray, first: np.ndarray, size: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (as places in fps) of lists that begin at first: those that share BYTES - bits
    positional bytes or more, and then differ in `bits` bits at most."""
    last = np.repeat(first + size, size)
    found_a, found_b = [], []
    for back in range(1, int(size.max(initial=1))):
        at = np.nonzero(np.arange(len(fps)) + back < last)[0]
        other = fps[at] ^ fps[at + back]
        tally = (other.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        at, other = at[tally >= BYTES - bits], other[tally >= BYTES - bits]
        at = at[np.bitwise_count(other) <= bits]
        found_a.append(at)
        found_b.append(at + back)
    none = [np.empty(0, np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


def flipped(fps: np.ndarray, free: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (as places) of sorted different fingerprints that share all bytes but `free`."""
    place = [8 * byte + bit for byte in free for bit in range(8)]
    found_a, found_b = [], []
    for k in range(1, bits + 1):
        for flip in combinations(place, k):
            other = fps ^ np.uint64(sum(1 << p for p in flip))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = np.nonzero((fps[at] == other) & (fps < other))[0]
            found_a.append(hit)
            found_b.append(at[hit])
    return np.concatenate(found_a), np.concatenate(found_b)


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _entry(path: tuple[int, ...]) -> Column:
    """(path, mask): the positions as bits, and the bits of a fingerprint that stand there."""
    return F.struct(F.lit(sum(1 << q for q in path)).alias("path"), F.lit(_signed(sum(0xFF << 8 * q for q in path))).alias("mask"))


def simhash_links(fps: DataFrame, bits: int = 2, long: int = LONG) -> DataFrame:
    """Edges (src, dst) between different fingerprints of fps (fp long) that join all that differ
    in at most `bits` bits: within a list, each is tied to the least it is linked with there,
    directly or not, so that a group of many copies gives rows in proportion to its size.
    """
    spark = fps.sparkSession
    fps = stored(fps.distinct(), "index-fingerprints")
    full, total = BYTES - bits, fps.count()
    depth = next((d for d in range(1, full) if total <= 256**d * long // 4), full)
    entries = fps.select("fp", F.explode(F.array(*map(_entry, paths(depth, bits)))).alias("e"))
    out = [spark.createDataFrame([], "src long, dst long")]
    while True:
        entries = entries.select("e.path", F.col("fp").bitwiseAND(F.col("e.mask")).alias("key"), "fp")
        if depth == full:
            out.append(_solved(entries, bits, long))
            break
        much = stored(entries.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > long).select("path", "key"), "long-lists")
        if much.isEmpty():
            out.append(_solved(entries, bits, long))
            break
        out.append(_solved(entries.join(much, ["path", "key"], "left_anti"), bits, long))
        after = F.create_map(*(x for p in paths(depth, bits) for x in (F.lit(sum(1 << q for q in p)), F.array(*map(_entry, extended(p, bits))))))
        entries = stored(entries.join(much, ["path", "key"]).select("fp", F.explode(F.element_at(after, F.col("path"))).alias("e")), "split-lists")
        depth += 1
    return reduce(DataFrame.union, out).distinct()


def _solved(entries: DataFrame, bits: int, long: int) -> DataFrame:
    lists = entries.repartition("path", "key").sortWithinPartitions("path", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.table([batch.column(c) for c in range(3)], ["path", "key", "fp"])
            part = pa.concat_tables([rest, part]) if rest is not None else part
            path, key, fp = (part.column(c).to_numpy() for c in range(3))
            new = np.nonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1]))[0] + 1
            last = int(new[-1]) if len(new) else 0  # the last list may go on in the next batch
            rest = part.slice(last)
            if last:
                yield solve(path[:last], fp[:last], np.concatenate([[0], new]))
        if rest is not None and len(rest) > 1:
            path, _, fp = (rest.column(c).to_numpy() for c in range(3))
            yield solve(path, fp, np.array([0, len(rest)]))

    def solve(path: np.ndarray, fp: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        fp = np.ascontiguousarray(fp).view(np.uint64)
        first, size = bounds[:-1], np.diff(bounds)
        short = (size > 1) & (size <= long)
        own = np.nonzero(np.repeat(short, size))[0]
        a, b = tallied(fp[own], np.cumsum(size[short]) - size[short], size[short], bits)
        pairs = [(own[a], own[b])]
        for k in np.nonzero(size > long)[0]:  # of six shared bytes
            order = first[k] + np.argsort(fp[first[k] : first[k] + size[k]])
            a, b = flipped(fp[order], [p for p in range(BYTES) if not int(path[first[k]]) >> p & 1], bits)
            pairs.append((order[a], order[b]))
        root = local_components(len(fp), *(np.concatenate(x) for x in zip(*pairs)))
        tied = np.nonzero(root != np.arange(len(fp)))[0]
        return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (tied, root[tied])], ["src", "dst"])

    return lists.mapInArrow(run, "src long, dst long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row of docs.

    component_id is the smallest id reachable over links between fingerprints that differ in at
    most `bits` bits, the row itself included. Rows with equal fingerprints are linked, among
    them all texts without words. Null texts count as empty. Repeated rows each come back with
    the same component. A row whose id is null belongs to its component but cannot name it, so
    component_id is null only where no member has an id. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = stored(simhash_fingerprints(docs, id_col, text_col, words), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(simhash_links(own.select("fp"), bits))
    own = stored(own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "rooted")
    named = stored(own.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    # tables of their own, so that Spark can split the joins of a very large class
    classes = stored(own.join(named, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
