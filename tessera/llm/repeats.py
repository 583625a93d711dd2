"""Removal of long byte strings that occur more than once, by prefix-free parsing.

Every text is parsed at triggers, the places where a rolling hash of a few bytes is the least of a
stretch (so that a trigger depends on the bytes around it alone, and every stretch has one). A
phrase runs from one trigger to the next. Strings of the corpus are in the order of the pair (rest
of the phrase, what follows the next trigger): the suffix of a dictionary word, then the suffix of
the parse. A string that is repeated stands beside its like in that order, as far as the longest
common prefix of the two reaches.

1. Parse suffixes are named by the bytes after a trigger that every string of the phrase holds.
   Most occur once; no string of their phrase can occur again, and the phrase is let go.
2. Whole phrases: all bytes that any string of the phrase holds. Where two are equal, each of
   their strings occurs again. This settles the inside of repeats, and copies: one of a kind
   goes on, as a partner for others.
3. The parse suffixes that share a name are a stretch of the suffix array of the parse. A task
   takes such stretches and sorts them, with the longest common prefixes of neighbours; the
   suffixes of the dictionary words before them are told apart byte by byte, in an order that
   keeps that of the parse inside each. So every start of a string meets its neighbours in the
   order of the corpus, and the longer of the two common prefixes says how long it repeats.
4. A stretch of more than CROWD different members, as a very common string makes, is dealt out
   by longer names: that of what all strings of a part of the phrase hold, for parts of PARTS[0]
   starts, then of PARTS[1], with steps 2 and 3 again. The last parts are single strings, which
   counting settles. Nothing depends on CROWD but the way.

Names are found by aggregation with map-side combining and joins on a hash, so very common strings
and large groups of copies make rows in proportion to their number, never to its square, and a
task holds CROWD members of a stretch at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.llm.common import discard, ids_and_text, stored, text_key

#: Bytes that a trigger looks at.
GRAM = 8
#: Members of a stretch of the parse that a task sorts, starts in a part of a phrase beyond that.
CROWD, PARTS = 1 << 11, (18, 1)
#: Members that a task sorts together.
BATCH = 1 << 13
#: Fills what a text has no byte for: no byte of UTF-8.
NONE = 0xFF
_SPAN = ArrayType(StructType().add("begin", "integer").add("end", "integer"))


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, as high half of a number, the place as the low."""
    n = len(data) - GRAM + 1
    gram = np.ndarray((n,), "<u8", data, strides=(1,)).copy()
    gram *= np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram &= np.uint64(0xFFFFFFFF00000000)
    gram |= np.arange(n, dtype=np.uint64)
    return gram


def triggers(data: np.ndarray, length: int, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each phrase with a start of a string: its next trigger, its first and its last start.

    The trigger of a start is the place of the least hash (the first, of equal ones) among the
    `stretch` places from there on; it lies inside the string and depends on its bytes only.
    """
    starts = len(data) - length + 1
    low = _hashes(data[: starts + stretch + GRAM - 2])
    width = 1
    while 2 * width <= stretch:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (stretch - width)], low[stretch - width :])[:starts]
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    return at[first], first, last


#: key: name of the stretch; whole: of all bytes from first to end; first, last: the starts; lead:
#: bytes from the first start to the trigger; single: whether spans are wanted; home: where in the
#: text the bytes begin that are at hand of it.
_COLUMNS = "key long, whole long, k1 long, k2 long, home int, first int, last int, lead int, end int, single boolean"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _rows(key: list[int], whole: list[int], k1: int, k2: int, home: int, first: np.ndarray, last: np.ndarray, lead: np.ndarray, end: np.ndarray, single: np.ndarray) -> pa.RecordBatch:
    n = len(first)
    names = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, whole))
    keys = (pa.array(np.full(n, k, np.int64)) for k in (k1, k2))
    ints = (pa.array(x.astype(np.int32)) for x in (np.full(n, home), first, last, lead, end))
    return pa.RecordBatch.from_arrays([*names, *keys, *ints, pa.array(single)], _NAMES)


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(rows)
            held, count = [], 0
    if count:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(rows)


def _phrases(rows: DataFrame, length: int, least: int, stretch: int) -> DataFrame:
    """The phrases of all texts of `least` bytes or more, as _COLUMNS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for k in range(batch.num_rows):
                view = memoryview(batch.column(2)[k].as_buffer())
                at, first, last = triggers(np.frombuffer(view, np.uint8), least, stretch)
                end = np.minimum(last + length, len(view))
                key = [digest(view[a : a + least - stretch + 1]) for a in at.tolist()]
                whole = [digest(view[a:b], c) for a, b, c in zip(first.tolist(), end.tolist(), (at - first).tolist())]
                yield _rows(key, whole, batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), 0, first, last, at - first, end, np.ones(len(at), bool))

    long = rows.where(F.octet_length("text") >= least).select("k1", "k2", F.col("text").cast("binary").alias("text"))
    return long.mapInArrow(lambda batches: _joined(run(batches)), _COLUMNS)


def _with_texts(texts: DataFrame, left: DataFrame) -> DataFrame:
    """(k1, k2, home, text, wanted): texts with the rows of left that are cut out of each."""
    by = ["k1", "k2", "home"]
    wanted = left.groupBy(*by).agg(F.collect_list(F.struct("key", "first", "last", "lead", "end", "single")).alias("wanted"))
    return texts.select(*by, "text").join(wanted.hint("shuffle_hash"), by)


def _fields(wanted: pa.StructArray) -> list[np.ndarray]:
    return [wanted.field(x).to_numpy(zero_copy_only=False) for x in ("key", "first", "last", "lead", "end", "single")]


def _parts(texts: DataFrame, left: DataFrame, length: int, least: int, part: int) -> DataFrame:
    """What is left of crowded stretches, in parts of so many starts counted back from the trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for k in range(batch.num_rows):
                home, view = batch.column(2)[k].as_py(), memoryview(batch.column(3)[k].as_buffer())
                key, first, last, lead, stop, single = _fields(batch.column(4)[k].values)
                first, last, lead, stop = (x.astype(np.int64) for x in (first, last, lead, stop))
                at = first + lead
                low, high = (at - last) // part, lead // part  # parts by distance from the trigger
                n = high - low + 1
                own = np.repeat(np.arange(len(n)), n)
                number = low[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = at[own]
                begin, end = np.maximum(first[own], at - (number + 1) * part + 1), np.minimum(last[own], at - number * part)
                stop = np.minimum(end + length, stop[own])
                cut = lambda a, b: zip((a - home).tolist(), (b - home).tolist())  # noqa: B023, E731
                seeds = (key[own].view(np.uint64) ^ number.astype(np.uint64)).tolist()
                common = [digest(view[a:b], c) for (a, b), c in zip(cut(at - number * part, at - (number + 1) * part + 1 + least), seeds)]
                whole = [digest(view[a:b], c) for (a, b), c in zip(cut(begin, stop), (at - begin).tolist())]
                yield _rows(common, whole, batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), home, begin, end, at - begin, stop, single[own])

    return _with_texts(texts, left).mapInArrow(lambda batches: _joined(run(batches)), _COLUMNS)


def neighbours(group: np.ndarray, words: list[memoryview], lead: np.ndarray, room: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, members, common): for each distance d before the trigger, the members whose start there
    has the string of a neighbour in common for so many bytes, d of them before the trigger or more.

    group: the stretch of each member, ascending; words: its bytes, lead of them (room at most)
    before the trigger. Members of one stretch are neighbours in the order (dictionary suffix of d
    bytes, parse suffix).
    """
    n = len(group)
    parse, before = np.full((n, length), NONE, np.uint8), np.zeros((n, room), np.uint8)
    size = np.empty(n, np.int64)
    for m, (word, a) in enumerate(zip(words, lead.tolist())):
        raw = np.frombuffer(word, np.uint8)
        size[m] = s = min(len(raw) - a, length)
        parse[m, :s] = raw[a : a + s]
        before[m, :a] = raw[:a][::-1]
    # the suffix array of the parse, stretch by stretch, and common prefixes of neighbours
    order = np.argsort(parse.view(f"S{length}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    same = np.empty(max(n - 1, 0), np.int64)
    for lo in range(0, n - 1, 4096):
        i, j = order[lo : lo + 4096], order[lo + 1 : lo + 4097]
        i = i[: len(j)]
        other = parse[i] != parse[j]
        common = np.where(other.any(axis=1), other.argmax(axis=1), length)
        same[lo : lo + len(j)] = np.where(group[i] == group[j], np.minimum(common, np.minimum(size[i], size[j])), 0)
    least = [same.astype(np.int16)]
    while 2 << (len(least) - 1) <= len(same):
        w = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-w], least[-1][w:]))
    level = np.zeros(n + 1, np.int64)
    level[1:] = np.frexp(np.arange(1, n + 1, dtype=np.float64))[1] - 1
    flat = np.zeros((len(least), n), np.int16)  # places out of range are only read between kinds
    for k, row in enumerate(least):
        flat[k, : len(row)] = row

    at, kind = np.arange(n), group[order]  # ranks in the order of the parse, dictionary suffix of each
    for d in range(room + 1):
        if len(at) < 2:
            return
        x, y = at[:-1], at[1:]
        k = level[np.maximum(y - x, 1)]
        both = np.where(kind[:-1] == kind[1:], np.minimum(flat[k, x], flat[k, y - (1 << k)]), -1)
        common = np.maximum(np.append(both, -1), np.insert(both, 0, -1))
        yield d, order[at], common + d
        stay = (common >= 0) & (lead[order[at]] > d)
        at, kind = at[stay], kind[stay]
        if not len(at):
            return
        kind = kind * 256 + before[order[at], d]
        again = np.argsort(kind, kind="stable")
        at, kind = at[again], kind[again]
        kind = np.cumsum(np.concatenate([[0], kind[1:] != kind[:-1]]))


def runs(group: np.ndarray, words: list[memoryview], first: np.ndarray, last: np.ndarray, lead: np.ndarray, length: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(members, first starts, last starts, whether of `length` bytes): what is repeated."""
    out = []
    wanted = (least, length) if least < length else (length,)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in wanted]
    for d, members, common in neighbours(group, words, lead, int(lead.max(initial=0)), length):
        inside = lead[members] - d <= last[members] - first[members]
        for own, many in zip(found, wanted):
            hit = members[inside & (common >= many)]
            own.append((hit, lead[hit] - d))
    for own, many in zip(found, wanted):
        member, start = (np.concatenate(x) for x in zip(*own)) if own else (np.empty(0, np.int64),) * 2
        if not len(member):
            continue
        order = np.lexsort((start, member))
        member, start = member[order], start[order]
        new = np.nonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (start[1:] != start[:-1] + 1)]))[0]
        stop = np.append(new[1:], len(member)) - 1
        out.append((member[new], first[member[new]] + start[new], first[member[new]] + start[stop], many == length))
    return out


_WORD = "key long, k1 long, k2 long, first int, last int, lead int, single boolean, word binary"


def _words(texts: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of left with their bytes, from the first start to the end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                home, text, (key, first, last, lead, end, single) = batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), _fields(batch.column(4)[k].values)
                word = pa.array([text[a:b] for a, b in zip((first - home).tolist(), (end - home).tolist())], pa.binary())
                keys = (pa.array(np.full(len(key), batch.column(c)[k].as_py(), np.int64)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(key), *keys, *(pa.array(x) for x in (first, last, lead, single)), word], ["key", "k1", "k2", "first", "last", "lead", "single", "word"])

    return _with_texts(texts, left).mapInArrow(lambda batches: _joined(cut(batches), 4096), _WORD)


def _sorted_out(texts: DataFrame, left: DataFrame, length: int, least: int) -> DataFrame:
    """(k1, k2, first, last, long): the repeated starts of the members of left, by step 3."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        key, k1, k2, first, last, lead, single = (table.column(c).to_numpy().astype(kind) for c, kind in zip(range(7), (*[np.int64] * 6, bool)))
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        words = [memoryview(x.as_buffer()) for x in table.column(7)]
        for member, a, b, long in runs(group, words, first, last, lead, length, least):
            own = single[member]
            member = member[own]
            yield pa.RecordBatch.from_arrays([pa.array(k1[member]), pa.array(k2[member]), pa.array(a[own].astype(np.int32)), pa.array(b[own].astype(np.int32)), pa.array(np.full(len(member), long))], ["k1", "k2", "first", "last", "long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, now = [], 0, None
        for batch in batches:
            key = batch.column(0).to_numpy()
            bounds = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
            for a, b in zip(bounds, bounds[1:]):
                if key[a] != now and count > BATCH:
                    yield from solve(held)
                    held, count = [], 0
                now = key[a]
                held.append(batch.slice(a, b - a))
                count += b - a
        if held:
            yield from solve(held)

    return _words(texts, left).repartition("key").sortWithinPartitions("key").mapInArrow(run, "k1 long, k2 long, first int, last int, long boolean")


def repeated_spans(rows: DataFrame, length: int = 400, least: int | None = None, stretch: int | None = None, crowd: int | None = None) -> DataFrame:
    """(k1, k2, spans, shorter) for the texts of rows (k1, k2, text) that hold a repeated string of
    `length` bytes or, in shorter, of `least` bytes; both: array of (begin, end) in bytes of the
    text, in any order, overlapping, that cover exactly the repeats."""
    least = length if least is None else least
    stretch = least * 4 // 5 if stretch is None else stretch
    crowd = CROWD if crowd is None else crowd
    if stretch + GRAM > least or least > length:
        raise ValueError("the trigger of a string must lie inside it")
    phrases = stored(_phrases(rows, length, least, stretch), "phrases")
    # a table of its own: a join of two plain exchanges is one whose skew Spark can split
    again = stored(phrases.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    live = stored(phrases.join(again.hint("merge"), "key"), "live")
    discard(phrases)
    discard(again)
    spans, texts = [], rows.select("k1", "k2", F.lit(0).alias("home"), F.col("text").cast("binary").alias("text"))
    for part in (*PARTS, None):
        # the rows of each kind; those that occur once may still equal a part of another kind
        kinds = live.groupBy("key", "whole").agg(F.count("*").alias("n"), F.max("single").alias("single"), F.min(F.struct("k1", "k2", "home", "first", "last", "lead", "end")).alias("one"))
        kinds = stored(kinds, "kinds")
        settled = live.where("single").join(kinds.where("n > 1 AND single").select("key", "whole").hint("merge"), ["key", "whole"])
        if part is None:  # the key of a single string is the string: what shares it is repeated
            known = stored(kinds.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "known")
            spans.append(stored(live.where("single").join(known, "key").select("k1", "k2", "first", "last", F.lit(False).alias("long")), "spans"))
        else:
            spans.append(stored(settled.select("k1", "k2", "first", "last", F.lit(False).alias("long")), "spans"))
        spans.append(stored(settled.select("k1", "k2", "first", F.expr(f"least(last, end - {length})").alias("last"), F.lit(True).alias("long")).where("first <= last"), "spans"))
        discard(live)
        if part is None:
            break
        mixed = kinds.groupBy("key").agg(F.count("*").alias("members"), F.max(F.expr("n = 1 AND single")).alias("loose")).where("members > 1 AND loose")
        mixed = stored(mixed.select("key", "members"), "mixed")
        left = kinds.join(mixed.hint("merge"), "key").select("key", "members", "one.*", F.expr("n = 1 AND single").alias("single"))
        left = stored(left, "left")
        discard(mixed)
        spans.append(stored(_sorted_out(texts, left.where(F.col("members") <= crowd), length, least), "spans"))
        discard(kinds)
        crowded = left.where(F.col("members") > crowd)
        if crowded.isEmpty():
            discard(left)
            break
        if part == PARTS[0]:  # from here on what is looked at lies inside these words
            texts = stored(_words(texts, crowded), "words").select("k1", "k2", F.col("first").alias("home"), F.col("word").alias("text"))
            crowded = crowded.withColumn("home", F.col("first"))
        live = stored(_parts(texts, crowded, length, least, part), "parts")
        discard(left)
    found = reduce(DataFrame.union, spans).select("k1", "k2", "long", F.struct(F.col("first").alias("begin"), (F.col("last") + F.when(F.col("long"), length).otherwise(least)).alias("end")).alias("s"))
    return found.groupBy("k1", "k2").agg(F.collect_list(F.when(F.col("long"), F.col("s"))).alias("spans"), F.collect_list(F.when(~F.col("long"), F.col("s"))).alias("shorter"))


def merged_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover; runs that touch are one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(begin) - 1]])]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    words: int = 0,
    passages: tuple[int, int] | None = None,
    stretch: int | None = None,
    extra: list[str] | None = None,
    crowd: int | None = None,
) -> DataFrame:
    """(id, carried, text, kept, spans, passages) for every row of docs; carried: struct of the columns extra.

    spans: the removed runs, array of (begin, end) in bytes of the UTF-8 text, in order and apart;
    kept: binary, the bytes outside of them. A byte is removed if a string of `length` bytes over
    it starts at any other place too, of the same or another row; runs that hold fewer than `words`
    words (parted by ASCII white space) stay. passages: of (least, words), also tells of the runs
    of shorter strings, `least` bytes, that hold so many words; nothing is removed for them.
    A null text is empty; texts under `length` bytes stay whole; repeated rows repeat each other.
    Ids may be null or repeat. Columns not named in extra are ignored; an empty table gives an
    empty result. Texts of any length are taken whole.
    """
    extra = extra or []
    least, many = passages or (length, 0)
    base = ids_and_text(docs, id_col, text_col)
    carried = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in extra), F.lit(True).alias("_")).alias("carried"))
    found = repeated_spans(base.select(*text_key(), "text"), length, least, stretch, crowd)
    joined = carried.select(*text_key(), "id", "carried", F.col("text").cast("binary").alias("text")).join(found.hint("shuffle_hash"), ["k1", "k2"], "left")
    runs_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def merged(found: pa.Scalar, text: bytes, least_words: int) -> list[tuple[int, int]]:
        if not found.is_valid or not len(found.values):
            return []
        begin, end = (found.values.field(x).to_numpy(zero_copy_only=False) for x in ("begin", "end"))
        whole = zip(*(x.tolist() for x in merged_spans(begin, end)))
        return [(a, b) for a, b in whole if not least_words or len(text[a:b].split()) >= least_words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                yield cut(whole.slice(lo, 256))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, removed, told = [], [], []
        for k in range(batch.num_rows):
            text, part, at = batch.column(2)[k].as_py(), [], 0
            own = merged(batch.column(3)[k], text, words)
            for a, b in own:
                part.append(text[at:a])
                at = b
            part.append(text[at:] if at else text)
            kept.append(b"".join(part))
            removed.append([{"begin": a, "end": b} for a, b in own])
            told.append([{"begin": a, "end": b} for a, b in merged(batch.column(4)[k], text, many)] if passages else [])
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("carried"), batch.column("text"), pa.array(kept, pa.binary()), pa.array(removed, runs_type), pa.array(told, runs_type)], ["id", "carried", "text", "kept", "spans", "passages"]
        )

    names = StructType([joined.schema["id"], joined.schema["carried"]])
    return joined.select("id", "carried", "text", "spans", "shorter").mapInArrow(run, names.add("text", "binary").add("kept", "binary").add("spans", _SPAN).add("passages", _SPAN))
