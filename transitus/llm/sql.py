"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

_WARC = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, payload,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest
  FROM hashed
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts
"""

_EXACT = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t
"""

_DECONTAMINATE = r"""
WITH RECURSIVE fold(kind, id, text) AS (
  SELECT 'd', doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents
  UNION ALL
  SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), told AS (
  SELECT kind, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM fold
), windows AS (
  SELECT DISTINCT id AS item, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 11)),
         lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS run
  FROM told WHERE kind = 'i' AND len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), runs AS (
  SELECT id, n, unnest(range(1, len(w) - n + 2)) AS pos,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS run
  FROM told, sizes WHERE kind = 'd' AND len(w) >= n
), found AS (SELECT r.id, r.pos, r.n, x.item FROM runs r JOIN windows x ON x.run = r.run AND x.n = r.n
), words AS (SELECT id, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT id, unnest(range(pos, pos + n)) AS word FROM found) GROUP BY id
), items AS (
  SELECT id, count(*) AS n_items, sha256(string_agg(item::VARCHAR, ',' ORDER BY item::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT id, item FROM found) GROUP BY id
)
SELECT t.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM told t LEFT JOIN words ON words.id = t.id LEFT JOIN items ON items.id = t.id
WHERE kind = 'd'
"""

_SUBSTRING = r"""
WITH told AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos,
         md5(unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i : i + 49], ' ')))) AS run
  FROM told WHERE len(w) >= 50
), earlier AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY run) AS first FROM runs
), gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS word FROM earlier WHERE first < doc_id
), lists AS (SELECT doc_id, list(word) AS words FROM gone GROUP BY doc_id
), cut AS (
  SELECT t.doc_id, t.w, coalesce(len(l.words), 0) AS n_removed,
         CASE WHEN l.words IS NULL THEN t.w ELSE list_transform(list_filter(list_zip(t.w, range(1, len(t.w) + 1)),
           lambda x: NOT list_contains(l.words, x[2])), lambda x: x[1]) END AS kept
  FROM told t LEFT JOIN lists l ON l.doc_id = t.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut
"""

_FILL_IN_MIDDLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), h AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS y,
         ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM t
), f AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
         AS output_sha256,
       sha256(text) AS restored_sha256
FROM o
"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": _DECONTAMINATE, "op3_warc": _WARC, "op6_substring_dedup": _SUBSTRING, "op8_exact_dedup": _EXACT,
    "op11_fill_in_middle": _FILL_IN_MIDDLE,
}
