"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. They are rotated (which keeps distances
and spreads them evenly over the coordinates) and split into blocks; of two vectors within the
distance, at least one block is within its share of the squared distance, in proportion to its
size. So each block is joined by range on its own, what any of these joins finds is checked
exactly, and the union of what remains is every pair.

The range join of a block: some vectors serve as pivots, each vector is at home in the cell of
the nearest one, and a guest in every cell whose border is within the range. Which vectors are
pivots changes the cost alone. A pair is found in the home cells of both its vectors, so the home
cell of a vector finds all its links; a pair that an earlier block finds too is left to that one.
A cell that holds much goes to several tasks, each with some of the vectors at home there; the
guests stream through. Nothing is dealt out for this, since spread vectors are guests nearly
everywhere: each vector lies once in flat files of the shared folder, with its homes, and tasks
read there what they need. Tasks give sums for each vector and a tie to the least vector of what it
is linked with there, never pairs, so groups of copies give rows in proportion to their size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, discard, local_components, mounted, scratch_path, stored

BLOCKS, SEED = 4, 7
#: Vectors at home in a task, others compared with them at once, and the most pivots.
TILE, STEP, MOST_PIVOTS = 8192, 128, 256
#: Pairs whose vectors are compared at once: a task holds several copies of both.
CHECKED = 1 << 15
#: Vectors that a task reads at once.
READ = 1 << 14
#: Added to squared distances against rounding, before the exact check.
SLACK = 1e-5


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _units(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1)[:, None]


def _binary(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(id, vec) of all rows, vec as packed floats; null where a vector links with nothing."""
    double = "double" in vectors.schema[vec_col].dataType.simpleString()
    kind = "<f8" if double else "<f4"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    finite = "NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)"
    rows = rows.select("id", F.expr(f"IF(id IS NOT NULL AND size(v) > 0 AND {finite}, v, NULL)").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary"), kind


def _homes(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of x its nearest of the pivots p, and how far that is."""
    near = ((x[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
    home = near.argmin(axis=1)
    return home, np.sqrt(near[np.arange(len(x)), home])


def link_vectors(classes: DataFrame, kind: str, dim: int, cosine: float = 0.9, tile: int = TILE) -> DataFrame:
    """For classes (id, weight, vec) of different vectors: rows (id, links, tied). The sum of links
    over the rows of an id is the weight of all classes linked with it; tied joins what is linked."""
    spark = classes.sparkSession
    budget = 2 - 2 * cosine
    turn = rotation(dim)
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).round().astype(int).tolist()
    cuts = list(zip(edges, edges[1:]))
    share = [budget * (b - a) / dim + 1e-12 for a, b in cuts]
    total = classes.count()
    few = max(1, min(MOST_PIVOTS, -(-total // (2 * tile))))
    chosen = classes.orderBy(F.xxhash64("id"), "id").limit(few).select("vec").collect()
    if not chosen:
        return spark.createDataFrame([], "id long, links long, tied long")
    pivots = _units(pa.array([bytes(r.vec) for r in chosen]), dim, kind)
    reach = [float(np.sqrt(s + SLACK)) for s in share]
    corners = [(pivots @ turn)[:, a:b] for a, b in cuts]
    apart = [np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)) for p in corners]
    path = scratch_path(spark, "vector-files")
    folder = mounted(path)
    wide = dim * np.dtype(kind).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        name, rows = os.urandom(12).hex(), 0  # a task that is run again writes files of its own
        count = np.zeros((len(cuts), len(pivots)), np.int64)
        with ExitStack() as stack:
            part = lambda x: stack.enter_context(open(f"{folder}/{name}.{x}", "wb"))
            ids, weights, vecs = part("id"), part("weight"), part("vec")
            homes = [(part(f"home{k}"), part(f"far{k}")) for k in range(len(cuts))]
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    batch = whole.slice(lo, 500)
                    turned = _units(batch.column("vec"), dim, kind) @ turn
                    ids.write(batch.column("id").to_numpy().astype("<i8").tobytes())
                    weights.write(batch.column("weight").to_numpy().astype("<i8").tobytes())
                    vecs.write(b"".join(batch.column("vec").to_pylist()))
                    rows += batch.num_rows
                    for k, (a, b) in enumerate(cuts):
                        home, far = _homes(turned[:, a:b], corners[k])
                        count[k] += np.bincount(home, minlength=len(pivots))
                        homes[k][0].write(home.astype("<i2").tobytes())
                        homes[k][1].write(far.astype("<f4").tobytes())
        k, cell = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(np.full(len(k), rows)), pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(count[k, cell])], ["name", "rows", "block", "cell", "n"])

    homes = stored(classes.select("id", "weight", "vec").mapInArrow(write, "name string, rows long, block int, cell int, n long"), "vector-homes")
    files = [tuple(r) for r in homes.select("name", "rows").distinct().orderBy("name").collect()]  # one a task
    held = homes.groupBy("block", "cell").agg(F.sum("n").alias("n")).orderBy("block", "cell").collect()  # BLOCKS * MOST_PIVOTS rows at most
    discard(homes)
    tiles = [(r.block, r.cell, t, -(-r.n // tile)) for r in held for t in range(-(-r.n // tile))]

    def chunks(block: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """(file, first row, homes, how far from them) of some rows after the other."""
        for name, rows in files:
            for lo in range(0, rows, READ):
                n = min(READ, rows - lo)
                yield name, lo, _read(name, f"home{block}", "<i2", lo, n), _read(name, f"far{block}", "<f4", lo, n)

    def _read(name: str, part: str, kind: str, lo: int, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.fromfile(f"{folder}/{name}.{part}", kind, n, offset=lo * size)

    def rows_of(name: str, lo: int, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, weights, unit vectors) of the rows at, of n from lo on."""
        vec = np.fromfile(f"{folder}/{name}.vec", kind, n * dim, offset=lo * wide).reshape(n, dim)[at].astype(np.float64)
        return _read(name, "id", "<i8", lo, n)[at], _read(name, "weight", "<i8", lo, n)[at], vec / np.linalg.norm(vec, axis=1)[:, None]

    def own_of(cell: int, t: int, n: int, name: str, lo: int, home: np.ndarray) -> np.ndarray:
        """Which rows are at home in a tile."""
        own = home == cell
        if n > 1 and own.any():
            spread = _read(name, "id", "<i8", lo, len(home)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            own &= spread % np.uint64(n) == t
        return own

    class Tile:
        def __init__(self, key: tuple[int, int, int]):
            self.key, self.ids, self.weights, self.units = key, [], [], []

        def home(self, ids: np.ndarray, weights: np.ndarray, unit: np.ndarray) -> None:
            self.ids.append(ids)
            self.weights.append(weights)
            self.units.append(unit)

        def begin(self) -> None:
            self.ids, self.unit = np.concatenate(self.ids), np.concatenate(self.units)
            self.weights = np.concatenate(self.weights)
            self.turned = self.unit @ turn
            a, b = cuts[self.key[0]]
            x = self.turned[:, a:b]
            # one product with (y, 1, |y|^2) gives the squared distance
            self.left = np.hstack([-2 * x, (x * x).sum(axis=1)[:, None], np.ones((len(x), 1))]).astype(np.float32)
            self.links = np.zeros(len(self.ids), np.int64)
            self.tied = self.ids.copy()  # the least id tied with each vector at home
            for lo in range(0, len(self.ids), STEP):
                self.against(self.ids[lo : lo + STEP], self.weights[lo : lo + STEP], self.unit[lo : lo + STEP])

        def against(self, ids: np.ndarray, weights: np.ndarray, unit: np.ndarray) -> None:
            block = self.key[0]
            a, b = cuts[block]
            turned = unit @ turn
            y = turned[:, a:b]
            right = np.hstack([y, np.ones((len(y), 1)), (y * y).sum(axis=1)[:, None]]).astype(np.float32)
            near = self.left @ right.T <= np.float32(share[block] + SLACK)
            i, j = np.divmod(np.flatnonzero(near), len(y))
            out = []
            for lo in range(0, len(i), CHECKED):
                p, q = i[lo : lo + CHECKED], j[lo : lo + CHECKED]
                ok = (self.ids[p] != ids[q]) & ((self.unit[p] * unit[q]).sum(axis=1) >= cosine)
                p, q = p[ok], q[ok]
                for k in range(block + 1):
                    c, d = cuts[k]
                    inside = ((self.turned[p, c:d] - turned[q, c:d]) ** 2).sum(axis=1) <= share[k]
                    p, q = (p[inside], q[inside]) if k == block else (p[~inside], q[~inside])
                np.add.at(self.links, p, weights[q])
                out.append((p, q))
            if out:
                p, q = (np.concatenate(x) for x in zip(*out))
                self.tie(p, ids[q])

        def tie(self, p: np.ndarray, others: np.ndarray) -> None:
            if not len(p):
                return
            names = np.unique(np.concatenate([self.tied, self.ids, others]))
            at = lambda v: np.searchsorted(names, v)
            one, two = np.divmod(np.unique(at(self.tied[p]) * len(names) + at(others)), len(names))
            first = np.concatenate([one, at(self.tied)])
            second = np.concatenate([two, at(self.ids)])
            root = names[local_components(len(names), first, second)]
            self.tied = root[at(self.ids)]
            self.guests = getattr(self, "guests", [])
            there = np.unique(others)
            self.guests.append((there, root[at(there)]))

        def rows(self) -> Iterator[pa.RecordBatch]:
            some = (self.links > 0) | (self.tied != self.ids)
            yield batch(self.ids[some], self.links[some], self.tied[some])
            for ids, tied in getattr(self, "guests", []):
                other = ids != tied
                yield batch(ids[other], np.zeros(other.sum(), np.int64), tied[other])

    def batch(ids: np.ndarray, links: np.ndarray, tied: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(tied)], ["id", "links", "tied"])

    def joined(block: int, cell: int, t: int, n: int) -> Iterator[pa.RecordBatch]:
        now = Tile((block, cell, t))
        for name, lo, home, _ in chunks(block):
            own = own_of(cell, t, n, name, lo, home)
            if own.any():
                now.home(*rows_of(name, lo, len(home), own))
        if not now.ids:
            return
        now.begin()
        a, b = cuts[block]
        for name, lo, home, far in chunks(block):
            # half the way between the pivots is the border: who is well before it needs no look
            there = (apart[block][home, cell] / 2 - far <= reach[block] + 1e-4) & ~own_of(cell, t, n, name, lo, home)
            if not there.any():
                continue
            ids, weights, unit = rows_of(name, lo, len(home), there)
            home = home[there]
            x = (unit @ turn)[:, a:b]
            border = ((x - corners[block][cell]) ** 2).sum(axis=1) - ((x - corners[block][home]) ** 2).sum(axis=1)
            guest = (border / np.maximum(2 * apart[block][home, cell], 1e-300) <= reach[block]) | (home == cell)
            ids, weights, unit = ids[guest], weights[guest], unit[guest]
            for k in range(0, len(ids), STEP):
                now.against(ids[k : k + STEP], weights[k : k + STEP], unit[k : k + STEP])
        yield from now.rows()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers in batches:
            for number in numbers.column(0).to_pylist():
                yield from joined(*tiles[number])

    out = spark.range(0, len(tiles), 1, len(tiles)).mapInArrow(join, "id long, links long, tied long")
    out.tessera_path = path
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors.

    n_links: other rows whose cosine with it is at least `cosine`, in double precision;
    component_id: the smallest id reachable over links, itself included; kept: id = component_id.
    Equal vectors are linked, and worked out once. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, nor do rows with a null id, whose component_id is
    null and which are not kept. Rows that repeat an id each have their own vector's links, and
    link with each other if their vectors do. All vectors that can link must have the same length.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows, kind = _binary(vectors, id_col, vec_col)
    rows = stored(rows, "vectors")
    # one row for each vector, told apart by a number, since ids may repeat
    classes = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    members = stored(rows.join(classes.select("vec", F.col("id").alias("class")), "vec", "left").select("id", "class"), "vector-members")
    discard(rows)
    sizes = [r[0] for r in classes.select(F.length("vec")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths can't be compared")
    dim = sizes[0] // np.dtype(kind).itemsize if sizes else 1
    linked = link_vectors(classes.select("id", "weight", "vec"), kind, dim, cosine, tile)
    found = stored(linked, "vector-links")
    if sizes:
        discard(linked)
    own = stored(classes.select(F.col("id").alias("class"), "least", "weight"), "vector-sizes")
    discard(classes)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    ties = connected_components(found.select(F.col("id").alias("src"), F.col("tied").alias("dst")))
    known = own.join(links, F.col("class") == F.col("id"), "left").join(ties, F.col("class") == F.col("node"), "left").select(
        "class", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class").alias("component")
    )
    known = stored(known, "vector-known")
    names = stored(known.groupBy("component").agg(F.min("least").alias("component_id")), "vector-names")
    known = stored(known.join(names, "component").select("class", "n_links", "component_id"), "vector-named")
    by_row = members.join(known, "class", "left")
    component = F.coalesce("component_id", "id")
    return by_row.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
