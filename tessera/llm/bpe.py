"""Byte-level BPE: encoding by a walk over the trie of the distinct words, and decoding.

The last token of the encoding of a prefix is determined by the prefix alone, and taking it away
leaves the encoding of the shorter prefix. So one number per trie node, its last token, holds the
encodings of all words below: a depth-first walk over the trie of the distinct words of a batch
works each shared prefix out once. A token can end at a node if it is the first there or may follow
the last token of the node where it begins, which is so exactly if the two stay as they are when
their bytes are encoded together. The walk goes through the words in byte order, which visits the
nodes of the trie depth first, and keeps the states of the path from the root only.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import ids_and_text

#: How byte-level BPE parts a text into words (fixed value); \s as the White_Space property has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Text taken at once, in code points, and words a worker remembers: bounds of its memory only.
CHUNK, REMEMBER = 1 << 20, 500_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in vocabulary files: printable Latin-1 stands for itself,
    the other bytes in order for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary in the `tokenizers` JSON format, without normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letter = spec["model"], _byte_letters()
        wrong = [k for k in ("normalizer", "truncation", "padding") if spec.get(k)] + [k for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
        plain = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"].get("use_regex", True)
        if wrong or model["type"] != "BPE" or not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path} {wrong}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        of = {t: i for t, i in model["vocab"].items()}
        self.merges = {(of[a], of[b]): (rank, of[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self._size = {i: len(t) for i, t in self.bytes_of.items()}
        self._whole: dict[int, bool] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._words = regex.compile(WORDS)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge_all(self, data: bytes) -> list[int]:
        """BPE by its definition, for the few bytes of two tokens: the merge of least rank first."""
        parts = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while True:
            ranked = [(self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merges]
            if not ranked:
                return parts
            _, i = min(ranked)
            parts[i : i + 2] = [self.merges[parts[i], parts[i + 1]][1]]

    def may_follow(self, a: int, b: int) -> bool:
        found = self._follows.get((a, b))
        if found is None:
            if len(self._follows) > 4 * REMEMBER:
                self._follows.clear()
            # two tokens that merge can't stay as they are
            found = self._follows[a, b] = (a, b) not in self.merges and self.merge_all(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def is_whole(self, a: int) -> bool:
        found = self._whole.get(a)
        if found is None:
            found = self._whole[a] = self.merge_all(self.bytes_of[a]) == [a]
        return found

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The token ids of each different word."""
        get, follows, out, longest = self.ids.get, self._follows.get, {}, self.longest
        size = self._size
        before, last = b"", [-1]  # last[i]: the last token of the first i bytes of the path
        for data, word in sorted((w.encode(), w) for w in set(words)):
            shared, n = 0, min(len(before), len(data))
            while shared < n and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                # from the longest on that such words have; the one that fits is the only one
                for begin in range(end - longest if end > longest else 0, end):
                    token = get(data[begin:end])
                    if token is None:
                        continue
                    if begin:
                        fits = follows((last[begin], token))
                        if fits is None:
                            fits = self.may_follow(last[begin], token)
                    else:
                        fits = self.is_whole(token)
                    if fits:
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends at byte {end} of {data!r}")
            ids, end = [], len(data)
            while end:
                ids.append(last[end])
                end -= size[last[end]]
            out[word] = tuple(ids[::-1])
            before = data
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 token ids of each text; special tokens in a text become their ids."""
        split, known = self._words.findall, self._known
        parts = [[(p if p in self.special else split(p)) for p in (self._specials.split(t) if self._specials else [t])] for t in texts]
        new = {w for part in parts for p in part if isinstance(p, list) for w in p if w not in known}
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = {w for part in parts for p in part if isinstance(p, list) for w in p}
        known.update(self.encode_words(new))
        of = known.__getitem__
        one = self.special
        return [np.fromiter(chain.from_iterable(chain.from_iterable(map(of, p)) if isinstance(p, list) else (one[p],) for p in part), np.int32) for part in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def _vocabulary(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row of docs; decoded is made from ids.

    path: a vocabulary file at this place on every machine. A null or empty text has no ids and is
    decoded to an empty text. Rows may repeat, and ids be null. Other columns are ignored; an empty
    table gives an empty result. Texts are encoded whole, whatever their length.
    """

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
        texts, begin, size = batch.column(1).to_pylist(), 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK or k == len(texts) - 1:
                yield batch.column(0).slice(begin, k + 1 - begin), texts[begin : k + 1]
                begin, size = k + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(path)
        for batch in batches:
            for own, texts in chunks(batch):
                ids = bpe.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([own, lists, pa.array([bpe.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string")
