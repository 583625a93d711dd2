"""Near copies of documents: SimHash of whole texts and of their parts, then exact Jaccard.

Fingerprints that differ in a bit or two tell copies with hardly a change; at a Jaccard similarity
of 0.8 of five-word shingles some ten of 64 bits differ, in nearly every byte. So a text is also
cut where its own shingles say so, into parts of some PART shingles, and each part has a fingerprint
of its own (the votes of the parts add up to those of the text). A near copy shares the parts that
no change has touched. Of long texts a share of the parts is looked at, chosen by the parts' own
fingerprints, MARKS to twice as many, so that texts of about one length choose alike.

Up to FEW documents with a part are all compared; of more, each with the smallest and the largest
id first: rows in proportion to the parts, however large a group of copies is. The fingerprints of the
two texts must be within FAR bits, which Jaccard 0.8 keeps to but for one pair in many thousands;
then the shingle sets are compared exactly.

What is linked already needs no further link. So of parts with more documents all pairs follow that
lie in different groups still: by blocks of documents of about one size, in memory, those that can be
near copies by their fingerprints and by a bound on the shingles in common (the sum over HELD bins of
the lesser number of shingles there, which is never too low). First a few pairs of any two
groups are compared, then, of the groups that remain, all. Pairs leave a task in parts, never all at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables, connected_components, discard, free_name, stored
from tessera.llm.simhash import BYTES, shingle_hashes, simhash_links

#: One shingle in so many ends a part; parts of a text that are looked at, at least.
PART, MARKS = 8, 8
#: Documents with a part that are all compared; differing bits of whole texts; comparisons in a task's slice.
FEW, FAR, SLICE = 8, 24, 256
#: Bins of a document's shingles, documents in a block, pairs of any two groups that are compared first.
HELD, BLOCK, BEST = 256, 4096, 2
#: Pairs between groups that a task holds before it hands them on.
PAIRS = 1 << 16
#: Tasks of comparing pairs between groups that go to where the texts are.
SENT = 1 << 16
_NODE = "struct<a: long, b: long>"
_LAST = 2**63 - 1
_FULL = 2**16 - 1


def part_fingerprints(hashes: np.ndarray) -> tuple[int, list[int]]:
    """(fingerprint of the text, those of its chosen parts) from its shingle hashes."""
    whole, parts, step = np.zeros(64, np.int64), [], 1 << 16
    share = 1 << max(0, (len(hashes) // (PART * MARKS)).bit_length() - 1)
    for lo in range(0, len(hashes), step):
        own = hashes[lo : lo + step]
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        first = np.nonzero((own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(PART) == 0)[0]
        first = np.unique(np.concatenate([[0], first]))
        votes = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        size = np.diff(np.concatenate([first, [len(own)]]))
        own = np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
        parts += own[(own * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(share) == 0].tolist()
        whole += votes.sum(axis=0)
    return int(np.packbits(2 * whole > len(hashes), bitorder="little").view("<u8")[0]), parts


def _fingerprints(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, parts, n, held = [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), words)
                a, b = part_fingerprints(hashes) if len(hashes) else (0, [])
                fp.append(a)
                parts.append(np.unique(np.array(b, np.uint64)).view(np.int64))
                own = np.unique(hashes)
                n.append(len(own))
                held.append(held_shingles(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(held, pa.binary())],
                ["id", "node", "fp", "n", "parts", "held"],
            )

    return rows.select("id", "node", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"id long, node {_NODE}, fp long, n long, parts array<long>, held binary")


def held_shingles(different: np.ndarray) -> np.ndarray:
    """How many of a text's different shingle hashes are in each of HELD bins."""
    return np.minimum(np.bincount((different >> np.uint64(56)).astype(np.int64), minlength=HELD), _FULL).astype("<u2")


def block_pairs(fp: np.ndarray, n: np.ndarray, group: np.ndarray, held: np.ndarray, side: np.ndarray | None, least: float, best: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of pair_parts together."""
    none = (np.empty(0, np.int64),) * 3
    i, j, both = (np.concatenate(x) for x in zip(none, *pair_parts(fp, n, group, held, side, least, best)))
    if best is not None:
        i, j, _ = _likeliest(i, j, both, n, group, best)
    return i, j


def pair_parts(fp: np.ndarray, n: np.ndarray, group: np.ndarray, held: np.ndarray, side: np.ndarray | None, least: float, best: int | None, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of documents in different groups that can have Jaccard similarity `least`, with the
    bound on their shingles in common; side: pairs are between 0 and 1, otherwise of all. best: so many
    of any two groups, the likeliest, in each part. A part is handed on at some `most` pairs, since all
    pairs of two blocks are millions."""
    fp = fp.view(np.uint64)  # bitwise_count takes absolute values
    one, two = (np.arange(len(n)),) * 2 if side is None else (np.nonzero(side == k)[0] for k in (0, 1))
    out, size = [], 0
    for lo in range(0, len(one), 256):
        own = one[lo : lo + 256]
        ok = (group[own][:, None] != group[two]) & (np.bitwise_count(fp[own][:, None] ^ fp[two]) <= FAR)
        ok &= np.minimum(n[own][:, None], n[two]) >= least * np.maximum(n[own][:, None], n[two])
        if side is None:
            ok &= own[:, None] < two
        i, j = np.nonzero(ok)
        i, j = own[i], two[j]
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            both = np.minimum(held[x], held[y]).sum(axis=1, dtype=np.int64)
            stay = (both * (1 + least) >= least * (n[x] + n[y]) - 1e-6) | (np.maximum(n[x], n[y]) >= _FULL)
            out.append((x[stay], y[stay], both[stay]))
            size += len(out[-1][0])
            if size >= most:
                part = tuple(np.concatenate(x) for x in zip(*out))
                if best is not None:
                    part = _likeliest(*part, n, group, best)
                out, size = [part], len(part[0])
                if best is None or size > most // 2:  # hardly fewer: more of the same would be no better
                    yield part
                    out, size = [], 0
    if size:
        part = tuple(np.concatenate(x) for x in zip(*out))
        yield part if best is None else _likeliest(*part, n, group, best)


def _likeliest(i: np.ndarray, j: np.ndarray, both: np.ndarray, n: np.ndarray, group: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    groups = np.minimum(group[i], group[j]) * (len(group) + 1) + np.maximum(group[i], group[j])
    order = np.lexsort((-both / (n[i] + n[j]), groups))
    groups = groups[order]
    order = order[np.arange(len(order)) - np.searchsorted(groups, groups) < best]
    return i[order], j[order], both[order]


def _between_groups(many: DataFrame, seen: DataFrame, links: DataFrame, least: float, best: int | None) -> DataFrame:
    """Pairs (src, dst) of documents that share a large part and that links leave in different groups."""
    tables = Tables()
    groups = connected_components(links).withColumnRenamed("node", "member")
    crowd = many.select("part", "me.node", "me.fp", "me.n").dropDuplicates(["part", "node"])
    crowd = crowd.join(groups, F.col("node") == F.col("member"), "left").select("part", "node", "fp", "n", F.coalesce("component", "node").alias("component"))
    # sizes that may go together lie in one range or in the next
    crowd = tables.stored(crowd.withColumn("bin", F.floor(F.log("n") / (-1.0001 * math.log(least))).cast("int")), "near-crowd")
    mixed = crowd.groupBy("part").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("part")
    blocks = crowd.join(mixed, "part").groupBy("part", "bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = tables.stored(blocks, "near-blocks")
    beside = lambda step, name: blocks.select("part", (F.col("bin") + step).alias("bin"), F.col("blocks").alias(name))
    counts = blocks.join(beside(-1, "above"), ["part", "bin"], "left").join(beside(1, "below"), ["part", "bin"], "left").na.fill(0, ["above", "below"])
    counts = tables.stored(counts, "near-counts")
    placed = crowd.join(counts, ["part", "bin"]).withColumn("t", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    up_to = lambda c, f: F.transform(F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>")), f)
    task = lambda kind, bin, x, y, side: F.struct(F.lit(kind).alias("kind"), bin.cast("int").alias("bin"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    t, own = F.col("t"), F.col("bin")
    tasks = F.concat(
        up_to("blocks", lambda v: task(0, own, F.least(t, v), F.greatest(t, v), t > v)),
        up_to("above", lambda v: task(1, own, t, v, F.lit(0))),
        up_to("below", lambda v: task(1, own - 1, v, t, F.lit(1))),
    )
    held = seen.select("node", "held").dropDuplicates(["node"])
    wanted = tables.stored(placed.select("part", "node", "fp", "n", "component", F.explode(tasks).alias("task")), "near-wanted")
    dealt = wanted.join(held, "node").select("part", "task.*", "node", "fp", "n", "component", "held")

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        kind, x, y = (key[k].as_py() for k in (1, 3, 4))
        node = table.column("node").combine_chunks()
        component = table.column("component").combine_chunks()
        group = np.stack([component.field(k).to_numpy() for k in range(2)], axis=1)
        group = np.unique(group, axis=0, return_inverse=True)[1].reshape(-1)
        column = lambda c: table.column(c).to_numpy()
        bins = np.frombuffer(b"".join(table.column("held").to_pylist()), "<u2").reshape(-1, HELD)
        for i, j, _ in pair_parts(column("fp"), column("n"), group, bins, None if kind == 0 and x == y else column("side"), least, best):
            yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], ["src", "dst"])

    found = dealt.groupBy("part", "kind", "bin", "x", "y").applyInArrow(pairs, f"src {_NODE}, dst {_NODE}")
    found = stored(found.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "near-between")
    tables.discard()
    return found


def _similar(rows: DataFrame, pairs: DataFrame, words: int, least: float, sent: int = 0) -> DataFrame:
    """Those of pairs (src, dst) whose shingle sets have Jaccard similarity `least` or more; up to
    `sent` tasks of comparing go to where the texts are."""
    tables = Tables()
    sizes = tables.stored(pairs.groupBy("dst").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), "near-sizes")
    member = pairs.join(sizes, "dst").select(F.col("src").alias("node"), F.struct("dst", F.pmod(F.xxhash64("src"), "slices").cast("int").alias("slice"), F.lit(1).alias("kind")).alias("task"))
    leader = sizes.select(F.col("dst").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.col("dst"), s.cast("int").alias("slice"), F.lit(0).alias("kind")))).alias("task"))
    tasks = tables.stored(member.union(leader), "near-tasks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, b""
        for batch in batches:
            found = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node != now:  # the tasks of a text come one after the other
                    now, held = node, np.unique(shingle_hashes(text.as_py(), words)).tobytes()
                found.append(held)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(found, pa.binary())], ["task", "node", "shingles"])

    # otherwise a plain join of two tables, so that Spark can split a text with very many tasks
    how = "broadcast" if sent and tasks.count() <= sent else "merge"
    joined = rows.select("node", F.col("text").cast("binary").alias("text")).join(tasks.hint(how), "node")
    dealt = joined.mapInArrow(sets, f"task struct<dst: {_NODE}, slice: int, kind: int>, node {_NODE}, shingles binary")
    dealt = dealt.select("task.dst", "task.slice", "task.kind", "node", "shingles")
    dealt = dealt.repartition("dst", "slice").sortWithinPartitions("dst", "slice", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            src, dst = [], []
            for d, s, kind, node, shingles in zip(*(batch.column(c) for c in range(5))):
                own = np.frombuffer(shingles.as_py(), np.uint64)
                if kind.as_py() == 0:
                    now, held = (d.as_py(), s.as_py()), own
                elif now == (d.as_py(), s.as_py()):
                    both = len(np.intersect1d(own, held, assume_unique=True))
                    if both >= least * (len(own) + len(held) - both):
                        src.append(node.as_py())
                        dst.append(d.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(src, batch.column("node").type), pa.array(dst, batch.column("node").type)], ["src", "dst"])

    links = stored(dealt.mapInArrow(compare, f"src {_NODE}, dst {_NODE}").distinct(), "near-links")
    tables.discard()
    return links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest id.

    Texts are near copies if their sets of `words`-word shingles (lower-cased words; fewer words:
    all of them) have a Jaccard similarity of `similarity` or more; groups are what is reachable
    over the links found. Texts without words, null ones too, are all alike. A row with a null id
    stays only where no row with an id is like it. Of rows that repeat id and text one stays. All
    columns come back as they are; an empty table gives an empty result.
    """
    node = free_name("_near_node", docs.columns)
    key = [F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))]
    docs = docs.withColumn(node, F.struct(F.xxhash64(*key).alias("a"), F.xxhash64(F.lit(1), *key).alias("b")))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"), F.col(node).alias("node"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    tables = Tables()
    seen = tables.stored(_fingerprints(rows, words), "near-fingerprints")
    me = F.struct("id", "node", "fp", "n")
    parts = seen.select(me.alias("me"), F.explode("parts").alias("part"))
    shared = parts.groupBy("part").agg(F.min("me").alias("first"), F.max("me").alias("last"), F.count("*").alias("times")).where("times > 1")
    shared = tables.stored(shared, "near-parts")
    large = F.col("times") > FEW
    met = parts.join(shared.hint("merge"), "part").select("part", "me", large.alias("large"), F.when(large, F.col("first")).alias("first"), F.when(large, F.col("last")).alias("last"))
    met = tables.stored(met, "near-met")
    few, many = met.where("NOT large").select("part", "me"), met.where("large")
    by_part = few.join(few.select("part", F.col("me").alias("first")), "part").where("me > first").select("me", "first")
    by_part = by_part.union(many.select("me", "first")).union(many.select("me", F.col("last").alias("first")))
    whole = tables.stored(seen.groupBy("fp").agg(F.min(me).alias("first")), "near-whole")
    by_whole = seen.select(me.alias("me"), "fp").join(whole, "fp").select("me", "first")
    roots = connected_components(simhash_links(whole.select("fp"), bits)).withColumnRenamed("node", "root_of")
    tied = tables.stored(whole.join(roots, F.col("fp") == F.col("root_of")).select("component", "first"), "near-tied")
    leads = tables.stored(tied.groupBy("component").agg(F.min("first").alias("lead")), "near-leads")
    by_bits = tied.join(leads, "component").select(F.col("first").alias("me"), F.col("lead").alias("first"))
    pairs = by_part.union(by_whole).union(by_bits).where("me.node <> first.node")
    near = "bit_count(me.fp ^ first.fp) <= {far} AND least(me.n, first.n) >= {s} * greatest(me.n, first.n)".format(far=FAR, s=similarity)
    pairs = tables.stored(pairs.where(near).select(F.col("me.node").alias("src"), F.col("first.node").alias("dst")).distinct(), "near-pairs")
    links = _similar(rows, pairs, words, similarity)
    found = [links]
    for best in (BEST, None):
        more = _between_groups(many.select("part", "me"), seen, links, similarity, best)
        if not more.isEmpty():
            found.append(_similar(rows, more, words, similarity, SENT))
            links = links.union(found[-1])
        discard(more)
    groups = connected_components(links)
    ids = seen.select("node", "id").distinct()
    named = tables.stored(groups.join(ids, "node").select("node", "component", F.struct("id", "node").alias("me")), "near-named")
    stay = tables.stored(named.groupBy("component").agg(F.min("me").alias("stays")), "near-stay")
    gone = named.join(stay, "component").where("me <> stays").select(F.col("node").alias("gone"))
    again = seen.groupBy("node").agg(F.count("*").alias("times")).where("times > 1").select("node")
    gone, again = stored(gone, "near-gone"), stored(again, "near-again")
    tables.discard()
    for df in found:
        discard(df)
    kept = docs.join(gone.hint("merge"), docs[node] == gone["gone"], "left_anti")
    if not again.isEmpty():
        again = again.withColumnRenamed("node", "again")
        once = kept.join(again, kept[node] == again["again"], "left_semi").dropDuplicates([node])
        kept = kept.join(again, kept[node] == again["again"], "left_anti").union(once)
    return kept.drop(node)
