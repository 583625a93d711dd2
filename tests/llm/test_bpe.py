import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import ByteBpe, bpe_encode
from tessera.llm.queries import op8_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return ByteBpe(PATH), Tokenizer.from_file(PATH)


def compare(both, texts):
    own, library = both
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    for t, a, b in zip(texts, got, want):
        assert a.tolist() == b, repr(t)
        assert own.decode(a) == library.decode(b, skip_special_tokens=False)


def test_odd_texts(both):
    odd = ["", " ", "  a", "a  ", "it's We'LL don't", "\n\n \tx", "\x1c\x1d\x85\xa0 ​x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "é é 😀👩‍👩‍👧 日本語 ١٢٣ ²½", "a" * 3000, "ab" * 2000 + "1" * 999, "\x00�͸"]
    compare(both, odd)


def test_random_texts(both):
    rng = random.Random(2)
    pool = "abcdefghinorstABC  \n\t'.,!?0123éßñ漢字😀 ̀"
    compare(both, ["".join(rng.choices(pool, k=rng.randint(0, 300))) for _ in range(1500)])
    tokens = list(both[0].bytes_of.values())
    compare(both, ["".join(t.decode("utf-8", "ignore") for t in rng.choices(tokens, k=12)) for _ in range(1500)])


def test_words_are_remembered_within_bounds(both, monkeypatch):
    import tessera.llm.bpe as module

    monkeypatch.setattr(module, "REMEMBER", 50)
    own = ByteBpe(PATH)
    compare((own, both[1]), [f"word{i} and so on {i * 7}" for i in range(200)])
    for i in range(200):
        own.encode([f"again{i}"])
    assert len(own._known) <= 51


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")]
    got = sorted((r.id or 0, r.ids, r.decoded) for r in bpe_encode(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS id"), PATH).collect())
    assert [(a, c) for a, _, c in got] == [(0, "x"), (1, ""), (2, ""), (3, "a b"), (3, "a b")] and got[1][1] == []
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_equals_the_library(spark, sf, both):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(both[1].decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in op8_bpe(spark, sf).collect()} == want
