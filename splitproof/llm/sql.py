"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_DRAW = "-ln((('0x' || substr(md5(k || '|' || {child}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}"

OP1 = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS crc_table
), docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents
), sized AS (
  SELECT doc_id, k, octet_length(encode(t)) + 1 AS size,
    xor(list_reduce(list_transform(range(octet_length(encode(t)) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ('0x' || substr(hex(encode(t)), (2 * i - 1)::BIGINT, 2))::BIGINT END),
      lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM docs, bits
), tree AS (
  SELECT s AS shard, (CASE WHEN s = 16 THEN 1 ELSE 0 END) AS generation, (CASE WHEN s = 16 THEN 0 ELSE s % 2 END) AS region, (CASE WHEN s = 16 THEN 0 ELSE s // 2 % 2 END) AS rack FROM range(17) t(s)
), paths AS (
  SELECT shard, generation || '/' || region AS region, generation || '/' || region || '/' || rack AS rack, generation || '/' || region || '/' || rack || '/' || shard AS leaf FROM tree
), region_pick AS (
  SELECT doc_id, k, n, arg_min(region, {_DRAW.format(child="region", weight="w")}) AS region
  FROM sized, (SELECT n, region, count(*) AS w FROM paths, (VALUES (16), (17)) v(n) WHERE shard < n GROUP BY ALL) r GROUP BY doc_id, k, n
), rack_pick AS (
  SELECT doc_id, k, n, arg_min(rack, {_DRAW.format(child="rack", weight="w")}) AS rack
  FROM region_pick JOIN (SELECT region, rack, count(*) AS w FROM paths GROUP BY ALL) USING (region) GROUP BY doc_id, k, n
), leaf_pick AS (
  SELECT doc_id, k, n, arg_min(leaf, {_DRAW.format(child="leaf", weight="1")}) AS leaf FROM rack_pick JOIN paths USING (rack) GROUP BY doc_id, k, n
), placed AS (
  SELECT doc_id, k, max(CASE WHEN n = 16 THEN leaf END) AS leaf, max(CASE WHEN n = 17 THEN leaf END) AS grown FROM leaf_pick GROUP BY doc_id, k
)
SELECT s.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, split_part(leaf, '/', 2)::INT AS region, split_part(leaf, '/', 3)::INT AS rack, split_part(leaf, '/', 4)::INT AS shard,
  (row_number() OVER (PARTITION BY split_part(leaf, '/', 4) ORDER BY ('0x' || right(md5(s.k || '|' || text_crc32 || '|' || size), 3))::INT, s.doc_id, text_crc32, size) - 1)::BIGINT AS slot, split_part(grown, '/', 4)::INT AS grown_shard
FROM sized s JOIN placed p ON s.k = p.k
"""

OP6 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), items AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS MATERIALIZED (
  SELECT DISTINCT item, n, array_to_string(w[s + 1:s + n], ' ') AS win FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(greatest(1, len(w) - 12))) AS s FROM items WHERE len(w) > 0)
), placed AS (
  SELECT r, p, n, array_to_string(w[p + 1:p + n], ' ') AS win FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS MATERIALIZED (
  SELECT r, p, n, item FROM placed JOIN windows USING (n, win)
), covered AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

#: Texts as hexadecimal digits, two a byte; a string is named by its MD5. Texts are cut into pieces of 2,000 bytes first, as a place far into a long text is slow to reach.
OP8 = """
WITH docs AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT doc_id, a, substr(h, 2 * a + 1, 2 * 2099) AS piece FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 2000)) AS a FROM docs)
), strings AS MATERIALIZED (
  SELECT doc_id, a + p AS start, md5_number(substr(piece, 2 * p + 1, 200)) AS name FROM (SELECT doc_id, a, piece, unnest(range(least(2000, length(piece) // 2 - 99))) AS p FROM pieces)
), again AS MATERIALIZED (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY name ORDER BY doc_id, start) AS i FROM strings) WHERE i > 1
), spans AS MATERIALIZED (
  SELECT doc_id, min(start) AS a, max(start) + 100 AS b FROM (
    SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM (SELECT doc_id, start, (start > coalesce(lag(start) OVER (PARTITION BY doc_id ORDER BY start), -1000) + 100)::INT AS fresh FROM again)
  ) GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT doc_id, max(b), 1::BIGINT << 30 FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
), removed AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_hash_tree_shards": OP1, "op4_suffix_array_decontamination": OP4, "op6_line_dedup": OP6, "op8_prefix_free_dedup": OP8}
