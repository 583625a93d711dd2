"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Everything is DataFrame or SQL expressions; the driver sees one row for each pattern of votes,
3 ** len(RULES) at most, and does the arithmetic of the EM on those.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, stored

#: Frequent function words of the four languages of the corpora this is meant for.
STOP_WORDS = (
    "the of and to in is that it for on with as was are be this by at from or have an not "
    "der die das und den von zu mit ist des im dem nicht ein eine auf für sich auch "
    "de la le les et des en un une du que est dans qui pour par sur pas au avec "
    "el los las y del que se por con para una no lo su es"
).split()

#: name -> (measure, the text may be good, the text may be bad); between the two the rule abstains.
RULES = {
    "word_length": ("word_chars / n_words", "x BETWEEN 3.5 AND 7.5", "x < 2.5 OR x > 10"),
    "symbols": ("n_symbols / n_words", "x <= 0.02", "x > 0.1"),
    "capitals": ("n_capitals / word_chars", "x <= 0.1", "x > 0.3"),
    "stop_words": ("n_stop_words / n_words", "x >= 0.1", "x < 0.03"),
    "line_ends": ("n_ended_lines / n_lines", "x >= 0.8", "x < 0.5"),
    "dup_lines": ("n_dup_lines / n_lines", "x <= 0.1", "x > 0.3"),
    "exclamations": ("n_exclamations / n_words", "x <= 0.05", "x > 0.2"),
}
ROUNDS = 30
#: Where the EM starts: share of good texts, and how often a vote is right on good and on bad texts.
PRIOR, RIGHT_IF_GOOD, RIGHT_IF_BAD = 0.8, 0.95, 0.5
#: The start counts as this share of the votes in each round, which keeps the two classes in place.
ANCHOR = 0.1

_SPACE = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
#: expressions over {t} (a text that isn't null), {w} (its words), {l} (its lines that have a word)
_CHEAP = {
    "n_words": "size({w})",
    "word_chars": f"length(translate({{t}}, {_SPACE}, ''))",
    "n_symbols": "length({t}) - length(translate({t}, '#*$%&|<>', ''))",
    "n_capitals": r"length({t}) - length(regexp_replace({t}, r'\p{{Lu}}+', ''))",
    "n_exclamations": "length({t}) - length(translate({t}, '!', ''))",
    "n_stop_words": "size(filter({w}, x -> x IN (" + ", ".join(f"'{x}', '{x.capitalize()}'" for x in dict.fromkeys(STOP_WORDS)) + ")))",
    "n_lines": "size({l})",
    "n_ended_lines": r"size(filter({l}, x -> x RLIKE r'[.!?][\x20\x09-\x0D]*$'))",
    "n_dup_lines": "size({l}) - size(array_distinct({l}))",
}
#: Hashes of the 3-word windows.
_WINDOWS = "IF(size({w}) < 3, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))"
#: The same in order, where some are equal, and of those each once for every time but the first.
_SORTED = "IF(size(array_distinct({h})) = size({h}), CAST(array() AS ARRAY<BIGINT>), sort_array({h}))"
_AGAIN = "filter({s}, (x, k) -> x = get({s}, k - 1))"
#: The places of the windows in {d}, in order: looked up one by one, or where that would take long,
#: all windows sorted with their places and those kept that equal a neighbour.
_PLACES = """CASE WHEN size({d}) = 0 THEN CAST(array() AS ARRAY<INT>)
WHEN size({d}) <= 64 THEN filter(sequence(0, size({h}) - 1), i -> array_contains({d}, {h}[i]))
ELSE transform(array(array_sort(transform({h}, (x, i) -> struct(x AS h, i AS i)))), s ->
  array_sort(transform(filter(s, (x, k) -> x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h), x -> x.i)))[0] END"""
#: The words that these windows cover.
_COVERED = "IF(size({p}) = 0, 0, aggregate(transform({p}, (x, k) -> least(3, coalesce(get({p}, k + 1) - x, 3))), 0, (a, b) -> a + b))"


def _measured(df: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """df with the measures, and how their columns are called."""
    names = {x: free_name(f"_quality_{x}", df.columns) for x in "twlhsadp"}
    put = lambda sql: F.expr(sql.format(**names))
    out = df.withColumn(names["t"], F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = out.withColumns(
        {
            names["w"]: put(r"array_remove(split({t}, r'[\x20\x09-\x0D]+'), '')"),
            names["l"]: put(r"filter(split({t}, r'\n'), x -> x RLIKE r'[^\x20\x09-\x0D]')"),
        }
    )
    for x, sql in (("h", _WINDOWS), ("s", _SORTED), ("a", _AGAIN), ("d", "array_distinct({a})"), ("p", _PLACES)):
        out = out.withColumn(names[x], put(sql))
    named = {k: free_name(f"_quality_{k}", df.columns) for k in [*_CHEAP, "n_repeat_words"]}
    sql = _CHEAP | {"n_repeat_words": _COVERED}
    return out.withColumns({named[k]: put(f"CAST({e} AS BIGINT)") for k, e in sql.items()}).drop(*names.values()), named


def vote_sql(named: dict[str, str]) -> list[str]:
    """One expression for each rule: 1 good, -1 bad, 0 abstains (also where the measure has none)."""
    out = []
    for measure, good, bad in RULES.values():
        above, below = (re.sub(r"\b[a-z]+_[a-z_]+\b", lambda m: named[m[0]], x) for x in measure.split(" / "))
        x = f"(CAST({above} AS DOUBLE) / nullif({below}, 0))"
        when = [re.sub(r"\bx\b", lambda _: x, c) for c in (good, bad)]
        out.append(f"CASE WHEN {when[0]} THEN 1 WHEN {when[1]} THEN -1 ELSE 0 END")
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """(share of good texts, how often each rule's votes are right on good texts, on bad texts).

    patterns: (votes, number of texts). The start weighs in as one case more and by ANCHOR, so no
    rule is ever certain, and no rule counts as worse than chance (then it has no weight).
    """
    n = len(RULES)
    prior, good, bad = PRIOR, [RIGHT_IF_GOOD] * n, [RIGHT_IF_BAD] * n
    for _ in range(rounds):
        total = part = 0.0
        sums = [[0.0] * 4 for _ in range(n)]
        for votes, count in patterns:
            q = 1 / (1 + math.exp(-log_odds(votes, prior, good, bad)))
            total, part = total + count, part + count * q
            for s, v in zip(sums, votes):
                if v:
                    s[0] += count * q
                    s[1] += count * q * (v > 0)
                    s[2] += count * (1 - q)
                    s[3] += count * (1 - q) * (v < 0)
        prior = (part + 1) / (total + 2)
        good = [(s[1] + RIGHT_IF_GOOD * (ANCHOR * s[0] + 1)) / (s[0] * (1 + ANCHOR) + 1) for s in sums]
        bad = [(s[3] + RIGHT_IF_BAD * (ANCHOR * s[2] + 1)) / (s[2] * (1 + ANCHOR) + 1) for s in sums]
        bad = [max(b, 1 - g) for g, b in zip(good, bad)]
    return prior, good, bad


def log_odds(votes: tuple[int, ...], prior: float, good: list[float], bad: list[float]) -> float:
    x = math.log(prior / (1 - prior))
    for v, g, b in zip(votes, good, bad):
        if v > 0:
            x += math.log(g / (1 - b))
        elif v < 0:
            x += math.log((1 - g) / b)
    return x


def quality_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns `keep` of docs (all, if None) with one more, the struct `quality` (with
    underscores in front where it would clash): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, votes, posterior (probability that the text is good) and kept.

    kept: not base_failed and posterior >= threshold. A null or empty text has no words and is
    base_failed. Repeated rows are each judged, and count in the EM, on their own. An empty table
    gives an empty result. A text of any length is judged whole. The texts are read once; what is
    kept of the rows and the measures goes to a table in the shared folder, and the EM and the
    verdicts read that.
    """
    keep = docs.columns if keep is None else keep
    full, named = _measured(docs, text_col)
    v, p = (free_name(f"_quality_{x}", full.columns) for x in ("votes", "posterior"))
    full = full.select(*(f"`{c}`" for c in keep), *named.values()).withColumn(v, F.array(*map(F.expr, vote_sql(named))))
    full = stored(full, "quality")
    rows = full.where(F.col(named["n_words"]) > 0).groupBy(v).count().collect()
    prior, good, bad = fit(sorted((tuple(r[v]), r["count"]) for r in rows))
    odds = F.lit(math.log(prior / (1 - prior)))
    for i, (g, b) in enumerate(zip(good, bad)):
        odds = odds + F.when(F.col(v)[i] > 0, math.log(g / (1 - b))).when(F.col(v)[i] < 0, math.log((1 - g) / b)).otherwise(0.0)
    full = full.withColumn(p, 1 / (1 + F.exp(-odds)))
    n, repeated = F.col(named["n_words"]), F.col(named["n_repeat_words"])
    failed = (n < 50) | (100 * repeated > 50 * n)
    base = [F.col(named[k]).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    verdict = F.struct(*base, failed.alias("base_failed"), F.col(v).alias("votes"), F.col(p).alias("posterior"), (~failed & (F.col(p) >= threshold)).alias("kept"))
    return full.withColumn(free_name("quality", keep), verdict).drop(v, p, *named.values())
