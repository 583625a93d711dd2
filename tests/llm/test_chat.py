import hashlib
import itertools
import random
import re

from tessera.llm.chat import chat_format, chat_parse
from tessera.llm.queries import op10_chat


def check(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS turns")
    got = {r.conv_id: r for r in chat_parse(chat_format(turns)).collect()}
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r))), key=lambda r: r[0]):
        want[c] = [(r or "", t or "") for _, _, r, t in own]
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    for c, r in got.items():
        loss = [r.formatted[s.begin : s.begin + s.length] for s in r.loss_spans]
        back = [re.sub(r"<(\\*)\\\|", r"<\1|", x) for x in loss]
        assert back == [t for role, t in want[c] if role == "assistant" and t]
    return got


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>\n", "<|im_start|>user\n", "<|", "<", "|", "\\", "<\\|", "<\\\\|", "<|im_sep|>", "\n", "é", "😀", "a b", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            text = rng.choice([None, *("".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(6))])
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "a\nb<|", None]), text))
    rows += [(99, 0, "user", "x"), (99, 0, "user", "x"), (99, None, "assistant", "z"), (None, 1, "user", "null id")]
    check(spark, rows)


def test_merge_and_mask(spark):
    rows = [(1, 1, "assistant", "b😀"), (1, 2, "assistant", "<|c"), (1, 0, "user", "a"), (1, 3, "assistant", "")]
    got = check(spark, rows)[1]
    assert got.formatted == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb😀<|im_sep|><\\|c<|im_sep|><|im_end|>\n"
    assert [got.formatted[s.begin : s.begin + s.length] for s in got.loss_spans] == ["b😀", "<\\|c"]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_parse(chat_format(empty)).count() == 0
    check(spark, [(1, 0, "user", "<|" * 100_000), (1, 1, "assistant", "x " * 300_000)])


def test_query_against_brute_force(spark, sf):
    odd = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", odd), (-1, 1, "assistant", odd)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, own in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        own = list(own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        want[c] = (len(own), sha("".join(f"{r}\n{t or ''}\n" for _, _, r, t in own)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op10_chat(spark, sf).collect()}
    assert got == want
