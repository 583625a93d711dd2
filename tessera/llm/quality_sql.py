"""DuckDB SQL that judges `documents` as quality_rules does, the EM as a recursive table."""

from __future__ import annotations

from tessera.llm.quality import ANCHOR, PRIOR, RIGHT_IF_BAD, RIGHT_IF_GOOD, ROUNDS, RULES, STOP_WORDS, vote_sql

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_exclamations", "n_stop_words", "n_lines", "n_ended_lines", "n_dup_lines", "n_repeat_words"]


def quality_sql(documents: str = "documents") -> str:
    """CTEs ending in `judged`: the columns of documents and n_words ... kept."""
    n, space = len(RULES), r"[\x20\x09-\x0D]"
    stop = ", ".join(f"'{x}', '{x.capitalize()}'" for x in dict.fromkeys(STOP_WORDS))
    votes = ", ".join(f"({v}) AS v{i}" for i, v in enumerate(vote_sql({k: k for k in _MEASURES})))
    up = [f"v{i}" for i in range(n)]
    odds = "ln(prior / (1 - prior)) + " + " + ".join(
        f"CASE WHEN {v} > 0 THEN ln(good[{i + 1}] / (1 - bad[{i + 1}])) WHEN {v} < 0 THEN ln((1 - good[{i + 1}]) / bad[{i + 1}]) ELSE 0 END" for i, v in enumerate(up)
    )
    good = [
        f"(sum(c * q * ({v} > 0)::INT) + {RIGHT_IF_GOOD} * ({ANCHOR} * sum(c * q * ({v} <> 0)::INT) + 1)) / (sum(c * q * ({v} <> 0)::INT) * (1 + {ANCHOR}) + 1)" for v in up
    ]
    bad = [
        f"(sum(c * (1 - q) * ({v} < 0)::INT) + {RIGHT_IF_BAD} * ({ANCHOR} * sum(c * (1 - q) * ({v} <> 0)::INT) + 1)) / (sum(c * (1 - q) * ({v} <> 0)::INT) * (1 + {ANCHOR}) + 1)" for v in up
    ]
    bad = [f"greatest({b}, 1 - ({g}))" for g, b in zip(good, bad)]
    wide = lambda x: ", ".join(f"{x}::DOUBLE" for _ in up)
    return rf"""
q_text AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, *, coalesce(text, '') AS t FROM {documents}
), q_split AS MATERIALIZED (
  SELECT rn, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM q_text
), q_word AS (
  SELECT rn, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM q_split
), q_window AS (
  SELECT rn, i, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS win FROM q_word WINDOW o AS (PARTITION BY rn ORDER BY i)
), q_place AS (
  SELECT rn, i FROM q_window WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rn, win) > 1
), q_cover AS (
  SELECT rn, least(3, coalesce(lead(i) OVER (PARTITION BY rn ORDER BY i) - i, 3)) AS x FROM q_place
), q_repeat AS (
  SELECT rn, sum(x) AS n_repeat_words FROM q_cover GROUP BY rn
), q_measure AS MATERIALIZED (
  SELECT q_split.rn, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
    len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
    len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?]{space}*$')))::BIGINT AS n_ended_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM q_split LEFT JOIN q_repeat USING (rn)
), q_vote AS MATERIALIZED (
  SELECT *, {votes} FROM q_measure
), q_pattern AS MATERIALIZED (
  SELECT {", ".join(up)}, count(*)::DOUBLE AS c FROM q_vote WHERE n_words > 0 GROUP BY ALL
), q_em AS (
  SELECT 0 AS round, {PRIOR}::DOUBLE AS prior, [{wide(RIGHT_IF_GOOD)}] AS good, [{wide(RIGHT_IF_BAD)}] AS bad
  UNION ALL
  SELECT round + 1, (sum(c * q) + 1) / (sum(c) + 2), [{", ".join(good)}], [{", ".join(bad)}]
  FROM (SELECT q_em.round, p.*, 1 / (1 + exp(-({odds}))) AS q FROM q_em, q_pattern AS p WHERE q_em.round < {ROUNDS})
  GROUP BY round
), judged AS (
  SELECT q_text.* EXCLUDE (rn, t), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce({odds} >= 0, false) AS kept
  FROM q_text JOIN q_vote USING (rn) LEFT JOIN (SELECT * FROM q_em WHERE round = {ROUNDS}) ON true
)"""


OP2_SQL = f"WITH RECURSIVE {quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
