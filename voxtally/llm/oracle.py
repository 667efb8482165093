"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from voxtally.llm import mixing

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id,
  vec_id = component_id AS kept
FROM c
"""

OP7 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, i * 5 + 1, 5))::INTEGER >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11 = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT doc_id, line, pos, first IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP12 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    (4294967295 - list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(
      string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 999, 999, 999, 999, 999, 999, 999, 999]))),
      lambda a, x: CASE WHEN x < 999 THEN xor(a, x)
        WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))::BIGINT % 9 AS h
  FROM t GROUP BY conv_id
), k AS (
  SELECT s.*, least(s.h, coalesce(b.n, 0)) AS n_head FROM s LEFT JOIN s b ON b.conv_id = s.base
), r AS (
  SELECT k.conv_id, pos, role, text FROM k JOIN t ON t.conv_id = k.base AND pos <= n_head
  UNION ALL
  SELECT k.conv_id, pos - h + n_head, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND pos > h
), g AS (
  SELECT conv_id, list([role, text] ORDER BY pos) AS turns FROM r GROUP BY conv_id
), p AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS key, NULL AS up, 0 AS bytes, n_head + greatest(n - h, 0) AS last FROM k
  UNION ALL
  SELECT conv_id, d, md5(to_json(turns[1:d])), CASE WHEN d = 1 THEN '' ELSE md5(to_json(turns[1:d - 1])) END,
    strlen(turns[d][2]), len(turns)
  FROM (SELECT conv_id, turns, unnest(range(1, len(turns) + 1)) AS d FROM g)
), n AS MATERIALIZED (
  SELECT key, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
  FROM p GROUP BY key, depth
), c AS MATERIALIZED (
  SELECT n.*, parent.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children
  FROM n LEFT JOIN n parent ON parent.key = n.up
  LEFT JOIN (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up) x ON x.up = n.key
), b AS (
  SELECT p.key, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.bytes)::BIGINT AS saved_tokens
  FROM c JOIN p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.key
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM c JOIN b USING (key)
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


#: The operator goes on until no further cell gets full; the SQL has so many steps, which are more than it takes.
_BUDGET_STEPS = 12


def _op2(sweeps: int, budget_steps: int, budget: float, powers: dict[str, float]) -> str:
    """All sweeps, as a recursion; the operator stops where nothing changes any more."""
    parts = ["""d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
    coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
  FROM documents
), f AS MATERIALIZED (
  SELECT doc_id, source, lang,
    (n - length(replace(replace(t, ' ', ''), chr(10), '')) + 1)::BIGINT AS n_tokens,
    CASE WHEN (n - length(translate(t, '#$%&*{}[]<>=;|~^', ''))) * 50 > n THEN 'symbols'
      WHEN (n - length(translate(t, '0123456789', ''))) * 50 > n THEN 'figures'
      WHEN (n - length(replace(t, chr(10), ''))) * 400 > n THEN 'lines'
      WHEN n < 400 THEN 'short' ELSE 'prose' END AS topic
  FROM d
), c0 AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS w FROM f GROUP BY ALL
)"""]
    for dim, power in powers.items():
        parts.append(f"""t_{dim} AS MATERIALIZED (
  SELECT {dim}, p / sum(p) OVER () AS share
  FROM (SELECT {dim}, pow(sum(tokens)::DOUBLE, {power}) AS p FROM c0 GROUP BY {dim})
)""")
    raked = "SELECT step + 1 AS step, source, lang, topic, tokens, w FROM r WHERE step < " + str(sweeps)
    for dim in powers:
        raked = (
            f"SELECT step, source, lang, topic, tokens, w * share / sum(w) OVER (PARTITION BY {dim}) AS w"
            f" FROM ({raked}) JOIN t_{dim} USING ({dim})"
        )
    parts.append(f"""r AS (
  SELECT 0 AS step, source, lang, topic, tokens, w FROM c0
  UNION ALL
  {raked}
)""")
    parts.append(f"""x AS MATERIALIZED (
  SELECT *, w * (SELECT sum(tokens) FROM c0)::DOUBLE / tokens AS weight FROM r WHERE step = {sweeps}
), l0 AS (SELECT {budget}::DOUBLE AS z)""")
    for i in range(budget_steps):
        parts.append(f"""l{i + 1} AS MATERIALIZED (
  SELECT greatest(z, ({budget}::DOUBLE * sum(tokens)::DOUBLE - sum(CASE WHEN weight * z >= 1 THEN tokens ELSE 0 END)::DOUBLE)
    / sum(CASE WHEN weight * z >= 1 THEN 0 ELSE tokens * weight END)) AS z
  FROM x, l{i} GROUP BY z
)""")
    return "WITH RECURSIVE " + ", ".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(least(1, weight * z), 6) AS probability,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
    < round(least(1, weight * z), 6) AS sampled
FROM f JOIN x USING (source, lang, topic), l{budget_steps}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_vectors": OP1,
        "op2_mixing": _op2(mixing.MOST_SWEEPS, _BUDGET_STEPS, mixing.BUDGET, mixing.TARGETS),
        "op6_topk": OP6,
        "op7_warc": OP7,
        "op11_line_dedup": OP11,
        "op12_prefix_trie": OP12,
        "op13_hard_negatives": OP13,
    }
