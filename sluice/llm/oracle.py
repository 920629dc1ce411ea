"""DuckDB SQL of the queries that SQL can express on whole tables.

The rest have none: signature rules with suppression (1), trained models (2, 6), piece
and word merges (3, 5), page parsing (4) and XXH64 (8); tests hold them against brute force.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  win AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0) x, unnest(range(1, len(w) - n + 2)) AS r(i)),
  dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win) z, unnest(range(1, len(w) - n + 2)) AS r(i)),
  hits AS (SELECT DISTINCT doc_id, item_id, n, i FROM dw JOIN win USING (n, s)),
  cover AS (SELECT doc_id, COUNT(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
  items AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

_RULES = ("base", "symbols", "dup_lines", "word_length")
_CONDEMNED = " OR ".join(f"{r}_p - {r}_m > 1.5 * sqrt({r}_p * (1 - {r}_p) / (n + {r}_s + 1))" for r in _RULES)

OP9 = rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
  w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, [l FOR l IN string_split(x, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM t),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, len(w) - 3)) AS r(i)),
  dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
  cover AS (SELECT doc_id, COUNT(DISTINCT j) AS n FROM dup, unnest(range(i, i + 5)) AS u(j) GROUP BY doc_id),
  m AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base, n_symbols > 0.1 * word_chars AS symbols,
    n_dup_lines > 0.3 * n_lines AS dup_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length FROM m),
  h AS (SELECT source, COUNT(*) AS n, {", ".join(f"CAST(SUM(CAST({r} AS INT)) AS DOUBLE) AS {r}_k" for r in _RULES)} FROM f GROUP BY source),
  p AS (SELECT {", ".join(f"AVG({r}_k / n) AS {r}_m, VAR_POP({r}_k / n) AS {r}_v" for r in _RULES)} FROM h),
  s AS (SELECT {", ".join(f"{r}_m, CASE WHEN {r}_v > 1e-12 THEN greatest(5.0, {r}_m * (1 - {r}_m) / {r}_v - 1) ELSE 1e12 END AS {r}_s" for r in _RULES)} FROM p),
  k AS (SELECT h.*, s.*, {", ".join(f"({r}_k + {r}_m * {r}_s) / (n + {r}_s) AS {r}_p" for r in _RULES)} FROM h, s),
  c AS (SELECT source, {_CONDEMNED} AS condemned FROM k)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
    NOT base AND NOT (condemned AND (base OR symbols OR dup_lines OR word_length)) AS kept FROM f JOIN c ON f.source IS NOT DISTINCT FROM c.source"""

_MARKS = r"\[\\*/?(?:SYS\]|INST\]|ROLE[=\]])|<\\*/?s>"

OP7 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  g AS (SELECT conv_id, COUNT(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    SUM(length(text) + len(regexp_extract_all(text, '{_MARKS}')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 14 + length(url_encode(role)) END) AS chars FROM c GROUP BY conv_id)
  SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""



def _op13() -> str:
    """Ten rounds written out: every distance, every time."""
    parts = [
        """v0 AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v FROM v0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v AS c FROM v ORDER BY sha256('3:' || vec_id), v LIMIT 8)",
    ]
    for i in range(11):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM
    (SELECT r, k, CAST(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, c)]) AS BIGINT) AS d FROM v, c{i}) GROUP BY r)""")
        if i < 10:
            parts.append(f"""m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM
    (SELECT k, j, SUM(CAST(v[j] AS HUGEINT)) AS s, COUNT(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) AS t(j) GROUP BY k, j) GROUP BY k),
  c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    return f"""WITH {", ".join(parts)}
  SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(SUM(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a10 JOIN v USING (r) JOIN c10 USING (k)"""


ORACLE_SQL = {"op13_centroids": _op13(), "op7_chat_format": OP7, "op9_quality_rules": OP9, "op10_decontaminate": OP10}
