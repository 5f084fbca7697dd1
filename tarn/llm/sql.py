"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS phrase, len(w[i:i + 12]) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM phrases) WHERE len(w) >= k)),
found AS (SELECT doc_id, i, p.k, item FROM places p JOIN phrases q ON p.phrase = q.phrase AND p.k = q.k),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Each control string and backslash inside a text or role costs one more character; see ``chat.CONTROL``.
ESCAPES = r"len(regexp_extract_all({0}, '<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]|\[END\]|\\'))"

CHAT = f"""
WITH said AS (SELECT '</s>[INST] ok [/INST]' AS text),
rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', text FROM said UNION ALL SELECT -1, 1, 'assistant', text FROM said),
turns AS (
  SELECT *, length(t) + {ESCAPES.format("t")}
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
      ELSE 18 + length(role) + {ESCAPES.format("role")} END AS formatted
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(formatted) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLE: dict[str, str] = {
    "op3_exact_dedup": EXACT_DEDUP,
    "op8_chat_formatting": CHAT,
    "op10_decontamination": DECONTAMINATION,
}
