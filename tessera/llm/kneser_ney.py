"""Interpolated modified Kneser-Ney, of bigrams or trigrams: counted in Spark, kept as sorted hash arrays.

A model is a folder that driver and executors share. Words are numbered by the order of their
64-bit hashes; a bigram's key is its two numbers in 64 bits, multiplied by an odd constant, which
spreads it and can be undone. Keys lie sorted in files by their upper bits, counts beside them. A
trigram lies in the file of the bigram that it begins with: its key is the place of that bigram in
its file, and the number of the last word. What is known of each word as a context, and in how many
contexts it follows, lies in files by its number; what is known of a bigram as a context, by its
place. Workers map the files into memory and search them there, so pages are shared between workers
and the model may be larger than their memory.

The longest n-grams have their counts; of shorter ones counts the number of words they follow (or
how often, where nothing can stand before them: at the beginning of a text).

Counts travel in blocks: arrays of keys and counts for one bucket, added up in each task before
they are shuffled. So a frequent word makes one entry a block however often it occurs, buckets are
even, and the number of buckets follows the size of the corpus. Counts are kept in the least
number of bytes that holds the largest of their block or file. Trigrams go in ROUNDS, a part of the
buckets at a time, so that disk holds the blocks of one.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ids_and_text, own_settings, scratch_path, word_hashes

#: Spreads bigrams over the key space; odd, so it has an inverse modulo 2**64.
SPREAD = 0x9E3779B97F4A7C15
UNSPREAD = pow(SPREAD, -1, 2**64)
#: Bytes of text for each bucket; tokens that a task adds up at once.
BUCKET_BYTES, HELD_TOKENS = 1 << 24, 2_000_000
#: Stands for the end of a text: the number that an empty word would have, and no word is empty.
END = np.uint64(0)
#: Parts of the buckets whose trigrams are shuffled one after the other.
ROUNDS = 2
_LOW = np.uint64(0xFFFFFFFF)
_BLOCK = "bucket int, part string, keys binary, counts binary"


def _local(path: str) -> str:
    """The path as the operating system knows it."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model is mapped into memory, so its folder must be mounted on every machine: {path}")
    return url.path if url.scheme else path


def _write(path: str, data: np.ndarray) -> None:
    """Whole or not at all, and the same again if a task is run twice."""
    temporary = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(temporary, "wb") as file:
        data.tofile(file)
    os.replace(temporary, path)


def _read(path: str, kind: str) -> np.ndarray:
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.empty(0, kind)
    return np.memmap(path, kind, "r")


def _narrow(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max(initial=0))
    return counts.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w))


def _write_counts(path: str, counts: np.ndarray) -> None:
    """As <path>-<bytes of a count>."""
    counts = _narrow(counts)
    _write(f"{path}-{counts.itemsize}", counts)


def _read_counts(path: str) -> np.ndarray:
    return next((_read(f"{path}-{w}", f"<u{w}") for w in (1, 2, 4, 8) if os.path.exists(f"{path}-{w}")), np.empty(0, "<u1"))


class _Arrays:
    """Keys that are sorted over files bucket 0, 1, ... by their upper bits, and where each one is."""

    def __init__(self, folder: str, name: str, bits: int):
        self.bits = bits
        self.keys = [_read(f"{folder}/{name}-{b}.key", "<u8") for b in range(1 << bits)]
        self.offset = np.concatenate([[0], np.cumsum([len(k) for k in self.keys])]).astype(np.int64)

    def cuts(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys (ascending) of each file begin and end."""
        upper = np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits) if self.bits else np.empty(0, np.uint64)
        return np.concatenate([[0], np.searchsorted(keys, upper), [len(keys)]])

    def find(self, keys: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
        """The place of each of these keys (ascending) over all files, or -1."""
        out = np.full(len(keys), -1, np.int64)
        cut = self.cuts(keys) if cut is None else cut
        for b in np.nonzero(np.diff(cut))[0].tolist():
            own, held = keys[cut[b] : cut[b + 1]], self.keys[b]
            if len(held):
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                out[cut[b] : cut[b + 1]] = np.where(held[at] == own, at + self.offset[b], -1)
        return out

    def told(self, parts: list[np.ndarray], place: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """What files beside those of the keys say at the places that find() gave; 0 where it gave
        none, and of files that nothing was written to."""
        out = np.zeros(len(place))
        for b in np.nonzero(np.diff(cut))[0].tolist():
            if len(parts[b]):
                own = place[cut[b] : cut[b + 1]]
                out[cut[b] : cut[b + 1]] = np.where(own >= 0, parts[b][np.maximum(own - self.offset[b], 0)], 0)
        return out


class Vocabulary:
    def __init__(self, folder: str, bits: int):
        self.arrays = _Arrays(folder, "word", bits)
        self.size = int(self.arrays.offset[-1])
        self.begin = self.size  # stands before the first word of a text

    def before(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The number of what stands before each token."""
        out = np.concatenate([[self.begin], ids[:-1]])
        out[first] = self.begin
        return out

    def looked_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the different tokens of the texts (ascending but for -1: not known), which of them
        each token is, each text with its end, and where it begins."""
        hashes, first = token_hashes(texts)
        words, at = np.unique(hashes, return_inverse=True)
        return self.arrays.find(words), at, first

    def sequences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens of the texts (-1: not known), and where each text begins."""
        words, at, first = self.looked_up(texts)
        return words[at], first


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, with the end after each text, and where each text begins."""
    found, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return np.insert(found, ends, END), np.concatenate([[0], ends[:-1] + np.arange(1, len(texts))]) if len(texts) else ends


def _chunks(batch: pa.RecordBatch, column: int, size: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a batch, some `size` bytes at once."""
    begin, held, texts = 0, 0, []
    for k in range(batch.num_rows):
        texts.append(batch.column(column)[k].as_py())
        held += len(texts[-1])
        if held >= size or k == batch.num_rows - 1:
            yield begin, texts
            begin, held, texts = k + 1, 0, []


def _rows(bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray, part: str = "") -> pa.RecordBatch:
    """A row for each bucket of ascending buckets."""
    first = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1]) if len(keys) else np.empty(0, np.int64)
    spans = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[first].astype(np.int32)),
            pa.array([part] * len(spans), pa.string()),
            pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([_narrow(counts[a:b]).tobytes() for a, b in spans], pa.binary()),
        ],
        ["bucket", "part", "keys", "counts"],
    )


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _blocks(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending keys and their counts, a row for each bucket."""
    return _rows(_bucket(keys, bits), keys, counts)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    at = np.nonzero(first)[0]
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.uint64) if n else np.empty(0, np.uint64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(bucket, part, keys, counts added up) of rows in order of (bucket, part)."""
    now, keys, counts = None, [], []
    for batch in batches:
        for row in zip(*(batch.column(c) for c in range(4))):
            at = (row[0].as_py(), row[1].as_py())
            if at != now and now is not None:
                yield *now, *_added(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [], []
            now = at
            keys.append(np.frombuffer(row[2].as_py(), "<u8"))
            counts.append(_wide(row[3].as_py(), len(keys[-1])))
    if now is not None:
        yield *now, *_added(np.concatenate(keys), np.concatenate(counts))


def _gathered(blocks: DataFrame, bits: int) -> DataFrame:
    """A task for each bucket; the first also has what is for none."""
    return blocks.repartitionById(1 << bits, F.greatest("bucket", F.lit(0))).sortWithinPartitions("bucket", "part")


def _count_words(texts: DataFrame, folder: str, bits: int) -> int:
    """Writes the words and their counts; returns the number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, part in _chunks(batch, 0):
                held.append(_added(*np.unique(token_hashes(part)[0], return_counts=True)))
                n += len(held[-1][0])
                if n >= HELD_TOKENS:
                    yield blocks(held)
                    held, n = [], 0
        if n:
            yield blocks(held)

    def blocks(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return _blocks(*_added(*(np.concatenate(x) for x in zip(*held))), bits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, keys, counts in _buckets(batches):
            _write(f"{folder}/word-{bucket}.key", keys)
            _write_counts(f"{folder}/word-{bucket}.count", counts)
            yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())])], ["n"])

    done = _gathered(texts.mapInArrow(count, _BLOCK), bits).mapInArrow(write, "n long")
    with own_settings(texts.sparkSession):
        return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)) * np.uint64(SPREAD)


def _parted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = keys * np.uint64(UNSPREAD)
    return pairs >> np.uint64(32), pairs & _LOW


def _run(done: DataFrame) -> dict[tuple[str, int], int]:
    """Sums of n by (what, k); the shuffle files go with the query."""
    with own_settings(done.sparkSession):
        return {(r.what, r.k): r.n for r in done.groupBy("what", "k").agg(F.sum("n").alias("n")).collect()}


_TOLD = "what string, k long, n long"


def _several(what: str, counts: np.ndarray) -> pa.RecordBatch:
    """How many counts are 1, 2, 3, 4, and how many there are (k = 0)."""
    return pa.RecordBatch.from_arrays([pa.array([what] * 5), pa.array([0, 1, 2, 3, 4]), pa.array([len(counts), *(int((counts == k).sum()) for k in (1, 2, 3, 4))])], ["what", "k", "n"])


def _count_bigrams(texts: DataFrame, folder: str, bits: int) -> dict[tuple[str, int], int]:
    """Writes the bigrams and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Vocabulary(folder, bits), [], 0
        for batch in batches:
            for _, part in _chunks(batch, 0):
                ids, first = words.sequences(part)
                held.append(_pair(words.before(ids, first), ids))
                n += len(ids)
                if n >= HELD_TOKENS:
                    yield _blocks(*np.unique(np.concatenate(held), return_counts=True), bits)
                    held, n = [], 0
        if n:
            yield _blocks(*np.unique(np.concatenate(held), return_counts=True), bits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, keys, counts in _buckets(batches):
            _write(f"{folder}/bigram-{bucket}.key", keys)
            _write_counts(f"{folder}/bigram-{bucket}.count", counts)
            yield _several("bigrams", counts)

    return _run(_gathered(texts.mapInArrow(count, _BLOCK), bits).mapInArrow(write, _TOLD))


def _count_trigrams(texts: DataFrame, folder: str, bits: int, part: int) -> dict[tuple[str, int], int]:
    """Writes the trigrams of a part of the buckets, their counts, and how many of 1, 2, 3 or more
    each bigram begins."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, held, n = Vocabulary(folder, bits), _Arrays(folder, "bigram", bits), [], 0
        for batch in batches:
            for _, texts_here in _chunks(batch, 0):
                ids, first = words.sequences(texts_here)
                keys = _pair(words.before(ids, first), ids)
                inside = np.ones(len(ids), bool)  # what a bigram stands before: all but the first of a text
                inside[first] = False
                here = np.nonzero(inside[1:] & (_bucket(keys[:-1], bits) % ROUNDS == part))[0]
                keys, at = np.unique(keys[here], return_inverse=True)
                bucket = _bucket(keys, bits)
                place = (pairs.find(keys) - pairs.offset[bucket]).astype(np.uint64) << np.uint64(32)
                held.append((bucket[at], place[at] | ids[here + 1].astype(np.uint64)))
                n += len(here)
                if n >= HELD_TOKENS:
                    yield added(held)
                    held, n = [], 0
        if n:
            yield added(held)

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, keys = (np.concatenate(x) for x in zip(*held))
        low = int(keys.max(initial=0)).bit_length()
        if int(bucket.max(initial=0)).bit_length() + low > 64:
            order = np.lexsort((keys, bucket))
            bucket, keys = bucket[order], keys[order]
        else:
            both = np.sort(bucket.astype(np.uint64) << np.uint64(low) | keys)
            bucket, keys = (both >> np.uint64(low)).astype(np.int64), both & np.uint64((1 << low) - 1)
        first = np.nonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])]))[0]
        return _rows(bucket[first], keys[first], np.diff(np.append(first, len(keys))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, keys, counts in _buckets(batches):
            _write(f"{folder}/trigram-{bucket}.key", keys)
            _write_counts(f"{folder}/trigram-{bucket}.count", counts)
            size = os.path.getsize(f"{folder}/bigram-{bucket}.key") // 8
            place = (keys >> np.uint64(32)).astype(np.int64)
            for k in (1, 2, 3):
                _write_counts(f"{folder}/begins{k}-{bucket}", np.bincount(place[counts == k if k < 3 else counts >= 3], minlength=size))
            yield _several("trigrams", counts)

    return _run(_gathered(texts.mapInArrow(count, _BLOCK), bits).mapInArrow(write, _TOLD))


def _count_before(spark: SparkSession, folder: str, bits: int, size: int, part: int) -> dict[tuple[str, int], int]:
    """Writes how many words each bigram of a part of the buckets follows, from the trigrams."""
    buckets = spark.range(1 << bits).repartitionById(1 << bits, F.col("id").cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                if b % ROUNDS == part:  # a bucket may have no trigram that ends on a bigram of its own
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([""]), pa.array([b""]), pa.array([b""])], ["bucket", "part", "keys", "counts"])
                keys = _read(f"{folder}/trigram-{b}.key", "<u8")
                middle = _parted(np.asarray(_read(f"{folder}/bigram-{b}.key", "<u8")))[1]
                for lo in range(0, len(keys), HELD_TOKENS):
                    own = np.asarray(keys[lo : lo + HELD_TOKENS])
                    own = _pair(middle[(own >> np.uint64(32)).astype(np.int64)], own & _LOW)
                    own = own[_bucket(own, bits) % ROUNDS == part]
                    yield _blocks(*np.unique(own, return_counts=True), bits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, keys, counts in _buckets(batches):
            held = np.asarray(_read(f"{folder}/bigram-{bucket}.key", "<u8"))
            found = np.where(_parted(held)[0] == size, np.asarray(_read_counts(f"{folder}/bigram-{bucket}.count")).astype(np.uint64), np.uint64(0))
            found[np.searchsorted(held, keys)] = counts
            _write_counts(f"{folder}/bigram-{bucket}.before", found)
            yield _several("before", found)

    return _run(_gathered(buckets.mapInArrow(count, _BLOCK), bits).mapInArrow(write, _TOLD))


def _count_contexts(spark: SparkSession, folder: str, bits: int, size: int, name: str) -> dict[tuple[str, int], int]:
    """Writes, by the numbers of words, what bigrams say of them: as context the sum of the counts
    `name` and how many are 1, 2, 3 or more, and in how many different contexts each follows."""
    width = max(1, -(-(size + 1) // (1 << bits)))  # word numbers for each bucket
    buckets = spark.range(1 << bits).repartitionById(1 << bits, F.col("id").cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                before, after = _parted(np.asarray(_read(f"{folder}/bigram-{b}.key", "<u8")))
                counts = np.asarray(_read_counts(f"{folder}/bigram-{b}.{name}")).astype(np.uint64)
                one = np.ones(len(counts), np.uint64)
                yield numbered("total", before, counts)
                for k in (1, 2, 3):
                    own = counts == k if k < 3 else counts >= 3
                    yield numbered(f"n{k}", before[own], one[own])
                yield numbered("follows", after, one)

    def numbered(part: str, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ids, counts = _added(ids, counts)
        return _rows((ids // np.uint64(width)).astype(np.int64), ids, counts, part)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part, ids, counts in _buckets(batches):
            dense = np.zeros(width, "<u8")
            dense[(ids - np.uint64(bucket * width)).astype(np.int64)] = counts
            _write_counts(f"{folder}/{part}-{bucket}", dense)
            if part == "follows":
                yield _several("words", counts)

    return _run(_gathered(buckets.mapInArrow(count, _BLOCK), bits).mapInArrow(write, _TOLD))


def discounts(several: list[int]) -> list[float]:
    """What modified Kneser-Ney takes from counts of 1, 2 and 3 or more, in (0, 1], (0, 2], (0, 3];
    half of a count where the corpus is too small to tell."""
    n1, n2, n3, n4 = several
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [d if 0 < d <= k else k / 2 for k, d in zip((1, 2, 3), raw)]


@dataclass(frozen=True)
class Model:
    """A trained model, as its folder has it in model.json."""

    folder: str
    order: int
    bits: int
    train_tokens: int
    size: int  # different tokens, the end among them
    trigram_discounts: tuple[float, ...]
    bigram_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    bigrams: int


def train(docs: DataFrame, text_col: str = "text", order: int = 3) -> Model:
    """A model of all rows of docs, whole texts, each followed by an end; a null text is empty.

    order: 2 or 3, the words of the longest n-grams. An empty table gives a model in which every
    token is unknown.
    """
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(4, (total // BUCKET_BYTES).bit_length())
    folder = _local(scratch_path(spark, "kneser-ney"))
    os.makedirs(folder)
    n = _count_words(texts, folder, bits)
    size = sum(os.path.getsize(f"{folder}/{x}") for x in os.listdir(folder) if x.startswith("word-") and x.endswith(".key")) // 8
    if size >= 2**32 - 1:
        raise ValueError(f"a bigram holds two word numbers of 32 bits, and the corpus has {size} different words")
    told = Counter(_count_bigrams(texts, folder, bits))
    if order == 3:
        for part in range(ROUNDS):
            told.update(_count_trigrams(texts, folder, bits, part))
        for part in range(ROUNDS):
            told.update(_count_before(spark, folder, bits, size, part))
    told.update(_count_contexts(spark, folder, bits, size, "before" if order == 3 else "count"))
    taken = lambda what: tuple(discounts([told[what, k] for k in (1, 2, 3, 4)]))
    model = Model(folder, order, bits, n, size, taken("trigrams"), taken("before" if order == 3 else "bigrams"), taken("words"), told["bigrams", 0])
    with open(f"{folder}/model.json", "w", encoding="utf-8") as file:
        json.dump(model.__dict__, file)
    return model


class Scorer:
    """The files of a model, mapped into this worker's memory."""

    def __init__(self, model: Model):
        self.model, f, b = model, model.folder, model.bits
        self.words = Vocabulary(f, b)
        self.bigrams = _Arrays(f, "bigram", b)
        self.width = max(1, -(-(model.size + 1) // (1 << b)))
        self.of = {x: [_read_counts(f"{f}/{x}-{k}") for k in range(1 << b)] for x in ("total", "n1", "n2", "n3", "follows")}
        self.word_counts = [_read_counts(f"{f}/word-{k}.count") for k in range(1 << b)]
        counts = lambda name: [_read_counts(f"{f}/{name}".format(k)) for k in range(1 << b)]
        self.bigram_counts = counts("bigram-{}.count")
        if model.order == 3:
            self.before = counts("bigram-{}.before")
            self.trigrams, self.trigram_counts = [_read(f"{f}/trigram-{k}.key", "<u8") for k in range(1 << b)], counts("trigram-{}.count")
            self.begins = [counts(f"begins{k}-{{}}") for k in (1, 2, 3)]
        d = np.array([0.0, *model.word_discounts])
        several = np.zeros(4)
        for part in self.of["follows"]:
            several += np.bincount(np.minimum(part, 3).astype(np.int64), minlength=4)
        #: what the discounts on words leave for all tokens alike, the unknown one among them
        self.rest = float((d * several).sum()) / model.bigrams / (model.size + 1) if model.bigrams else 1.0

    def _numbered(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Of word numbers, ascending but for -1; 0 there and where nothing is known."""
        out, there = np.zeros(len(ids)), np.nonzero(ids >= 0)[0]
        own = ids[there]
        cut = np.searchsorted(own, np.arange(len(self.of[name]) + 1) * self.width)
        for b in np.nonzero(np.diff(cut))[0].tolist():
            if len(part := self.of[name][b]):
                out[there[cut[b] : cut[b + 1]]] = part[own[cut[b] : cut[b + 1]] - b * self.width]
        return out

    @staticmethod
    def _placed(parts: list[np.ndarray], offset: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of places over all files, in any order; 0 for place -1, and in files that nothing was written to."""
        order = np.argsort(at, kind="stable")
        sorted_at, out = at[order], np.zeros(len(at))
        cut = np.searchsorted(sorted_at, offset)
        for b in np.nonzero(np.diff(cut))[0].tolist():
            if len(parts[b]):
                out[order[cut[b] : cut[b + 1]]] = parts[b][sorted_at[cut[b] : cut[b + 1]] - offset[b]]
        return out

    def word_probability(self, ids: np.ndarray) -> np.ndarray:
        """Of tokens, numbers ascending but for -1 (unknown), whatever stands before."""
        follows = self._numbered("follows", ids)
        less = np.array([0.0, *self.model.word_discounts])[np.minimum(follows, 3).astype(np.int64)]
        return (follows - less) / max(1, self.model.bigrams) + self.rest

    def _bigram(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """What is known of bigrams (keys ascending): where they are, their counts as the end of an
        n-gram, and of those that are contexts how often, and what their discounts leave."""
        cut = self.bigrams.cuts(keys)
        place = self.bigrams.find(keys, cut)
        told = lambda parts: self.bigrams.told(parts, place, cut)
        if self.model.order == 2:
            return {"place": place, "cut": cut, "count": told(self.bigram_counts)}
        kept = sum(d * told(x) for d, x in zip(self.model.trigram_discounts, self.begins))
        # a bigram begins a trigram each time but at the end of a text
        return {"place": place, "cut": cut, "count": told(self.before), "total": told(self.bigram_counts) * (kept > 0), "kept": kept}

    def _trigram_counts(self, known: dict[str, np.ndarray], context: np.ndarray, after: np.ndarray) -> np.ndarray:
        """context: which of the known bigrams stands before; all of them and after are there."""
        keys = context.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        order = np.argsort(keys)
        out, own, last = np.zeros(len(keys)), known["place"][context[order]], after[order].astype(np.uint64)
        cut = np.searchsorted(context[order], known["cut"])
        for b in np.nonzero(np.diff(cut))[0].tolist():
            held, here = self.trigrams[b], slice(cut[b], cut[b + 1])
            if len(held):
                wanted = (own[here] - self.bigrams.offset[b]).astype(np.uint64) << np.uint64(32) | last[here]
                at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                out[order[here]] = np.where(held[at] == wanted, self.trigram_counts[b][at], 0)
        return out

    def probability(self, before: np.ndarray, after: np.ndarray, far: np.ndarray | None = None) -> np.ndarray:
        """Of the tokens after, each behind a token before, and one far before that (None: of none)."""
        pair = lambda a, b: _pair(np.maximum(a, 0), np.maximum(b, 0))
        there = (before >= 0) & (after >= 0)
        each = (*np.unique(before, return_inverse=True), *np.unique(after, return_inverse=True))
        if far is None:
            keys, at = np.unique(pair(before, after), return_inverse=True)
            return self._given(*each, self._bigram(keys), at, there, np.zeros(len(at), np.int64), np.zeros(len(at), bool))
        keys, at = np.unique(np.concatenate([pair(before, after), pair(far, before)]), return_inverse=True)
        at, context = np.split(at, 2)
        return self._given(*each, self._bigram(keys), at, there, context, (far >= 0) & (before >= 0))

    def _given(
        self, contexts: np.ndarray, at_context: np.ndarray, words: np.ndarray, at_word: np.ndarray,
        known: dict[str, np.ndarray], at: np.ndarray, there: np.ndarray, context: np.ndarray, behind: np.ndarray,
    ) -> np.ndarray:
        """Of the tokens words[at_word] behind contexts[at_context], both ascending but for -1. at: which
        of the known bigrams each pair is, where both are there; context: which one stands before the
        token, where there is one (behind)."""
        low = self.word_probability(words)[at_word]
        total, *some = (self._numbered(x, contexts) for x in ("total", "n1", "n2", "n3"))
        weight = np.where(total > 0, sum(d * n for d, n in zip(self.model.bigram_discounts, some)) / np.maximum(total, 1), 1.0)
        middle = self._less(self.model.bigram_discounts, known["count"][at] * there) / np.maximum(total, 1)[at_context] + weight[at_context] * low
        if self.model.order == 2:
            return middle
        total = known["total"][context] * behind
        long = np.nonzero((total > 0) & (words >= 0)[at_word])[0]
        counts = np.zeros(len(at_word))
        counts[long] = self._trigram_counts(known, context[long], words[at_word[long]])
        weight = np.where(total > 0, known["kept"][context] / np.maximum(total, 1), 1.0)
        return self._less(self.model.trigram_discounts, counts) / np.maximum(total, 1) + weight * middle

    @staticmethod
    def _less(d: tuple[float, ...], counts: np.ndarray) -> np.ndarray:
        return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: tokens, known ones, log10 probability with add-one words, and of the model."""
        words, at, first = self.words.looked_up(texts)
        ids = words[at]
        before = self.words.before(ids, first)
        at_before = np.concatenate([[len(words)], at[:-1]])  # the same words behind each other, and the begin
        at_before[first] = len(words)
        counts = self._placed(self.word_counts, self.words.arrays.offset, words)
        base = np.log10((counts + 1) / (self.model.train_tokens + self.model.size + 1))[at]
        keys, at_pair = np.unique(_pair(np.maximum(before, 0), np.maximum(ids, 0)), return_inverse=True)
        there = (before >= 0) & (ids >= 0)
        behind = np.concatenate([[False], there[:-1]])  # the bigram of the token before, inside a text
        behind[first] = False
        context = np.concatenate([[0], at_pair[:-1]])
        score = np.log10(self._given(np.append(words, self.words.begin), at_before, words, at, self._bigram(keys), at_pair, there, context, behind))
        sums = lambda x: np.add.reduceat(x, first)
        return sums(np.ones(len(ids), np.int64)), sums((ids >= 0).astype(np.int64)), sums(base), sums(score)


_open: dict[str, Scorer] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) for every row of docs.

    A null or empty text has one token, its end. Other columns are ignored; repeated rows each come
    back; an empty table gives an empty result. Texts are scored whole, some of them at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _open:
            _open.clear()
            _open[model.folder] = Scorer(model)
        scorer = _open[model.folder]
        for batch in batches:
            for begin, texts in _chunks(batch, 1):
                n, known, base, own = scorer.score(texts)
                arrays = [batch.column(0).slice(begin, len(texts)), *map(pa.array, (n, known, base, own, 10 ** (-own / n)))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = ids_and_text(docs, id_col, text_col).select("id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
