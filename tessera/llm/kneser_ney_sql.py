"""DuckDB SQL for the same model and scores: no hash, no file, one row for each bigram and trigram."""

from __future__ import annotations

#: CRC32 of the digits of doc_id: a step for each byte, then eight shifts.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
    "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"
)


def _discounts(name: str, counts: str) -> str:
    """A row of what is taken from counts of 1, 2 and 3 or more in a column n."""
    raw = ["1 - 2 * y * n2 / n1", "2 - 3 * y * n3 / n2", "3 - 4 * y * n4 / n3"]
    some = ", ".join(f"count(*) FILTER (n = {k})::DOUBLE AS n{k}" for k in (1, 2, 3, 4))
    each = ", ".join(f"CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 AND {r} > 0 AND {r} <= {k} THEN {r} ELSE {k / 2} END AS d{k}" for k, r in enumerate(raw, 1))
    return f"{name} AS MATERIALIZED (SELECT {each} FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM (SELECT {some} FROM {counts})))"


def _less(count: str, d: str) -> str:
    return f"CASE WHEN {count} >= 3 THEN {d}.d3 WHEN {count} = 2 THEN {d}.d2 WHEN {count} = 1 THEN {d}.d1 ELSE 0 END"


OP1_SQL = rf"""
WITH doc AS MATERIALIZED (
  SELECT doc_id, coalesce({_CRC} % 7 = 2, true) AS held_out,
    list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), '') AS ws
  FROM documents
), tok AS MATERIALIZED (
  SELECT doc_id, held_out, unnest(ws) AS w, unnest(list_prepend(' ', ws[:-2])) AS p, unnest(list_concat([NULL, ' '], ws[:-3])[:len(ws)]) AS q FROM doc
), word AS MATERIALIZED (
  SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w
), total AS MATERIALIZED (
  SELECT sum(c)::BIGINT AS n, count(*) AS v FROM word
), trio AS MATERIALIZED (
  SELECT q, p, w, count(*) AS n FROM tok WHERE NOT held_out AND q IS NOT NULL GROUP BY q, p, w
), pair AS MATERIALIZED (
  SELECT p, w, count(*) AS n FROM tok WHERE NOT held_out AND p = ' ' GROUP BY p, w
  UNION ALL SELECT p, w, count(*) AS n FROM trio GROUP BY p, w
), follow AS MATERIALIZED (
  SELECT w, count(*) AS n FROM pair GROUP BY w
), context AS MATERIALIZED (
  SELECT p, sum(n)::DOUBLE AS n, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n >= 3) AS n3 FROM pair GROUP BY p
), longer AS MATERIALIZED (
  SELECT q, p, sum(n)::DOUBLE AS n, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n >= 3) AS n3 FROM trio GROUP BY q, p
), {_discounts("dt", "trio")}, {_discounts("dp", "pair")}, {_discounts("df", "follow")},
low AS MATERIALIZED (
  SELECT (SELECT count(*) FROM pair)::DOUBLE AS pairs, sum({_less("n", "df")}) / (SELECT count(*) FROM pair) / ((SELECT v FROM total) + 1) AS rest FROM follow, df
), scored AS (
  SELECT tok.doc_id, tok.held_out, word.c AS c,
    log10((coalesce(word.c, 0) + 1) / (total.n + total.v + 1)) AS base,
    (coalesce(follow.n, 0) - {_less("coalesce(follow.n, 0)", "df")}) / low.pairs + low.rest AS p1,
    (coalesce(pair.n, 0) - {_less("coalesce(pair.n, 0)", "dp")}) / coalesce(context.n, 1) AS top,
    CASE WHEN context.n IS NULL THEN 1 ELSE (dp.d1 * context.n1 + dp.d2 * context.n2 + dp.d3 * context.n3) / context.n END AS weight,
    (coalesce(trio.n, 0) - {_less("coalesce(trio.n, 0)", "dt")}) / coalesce(longer.n, 1) AS top3,
    CASE WHEN longer.n IS NULL THEN 1 ELSE (dt.d1 * longer.n1 + dt.d2 * longer.n2 + dt.d3 * longer.n3) / longer.n END AS weight3
  FROM tok CROSS JOIN total CROSS JOIN dt CROSS JOIN dp CROSS JOIN df CROSS JOIN low
  LEFT JOIN word ON word.w = tok.w LEFT JOIN follow ON follow.w = tok.w
  LEFT JOIN context ON context.p = tok.p LEFT JOIN pair ON pair.p = tok.p AND pair.w = tok.w
  LEFT JOIN longer ON longer.q = tok.q AND longer.p = tok.p LEFT JOIN trio ON trio.q = tok.q AND trio.p = tok.p AND trio.w = tok.w
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, (SELECT n FROM total) AS train_tokens,
  round(sum(base), 6) AS base_score, round(sum(log10(top3 + weight3 * (top + weight * p1))), 6) AS score
FROM scored GROUP BY doc_id, held_out
"""
