"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SHARDS = 24
_DRAW = "('0x' || substr(md5({}), 1, 13))::BIGINT"

#: crc32 as a fold over bytes; the table of 256 entries comes from its rule.
_CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS r(n)
)"""

OP1 = f"""
WITH {_CRC.strip()},
d AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents
),
sized AS (
  SELECT doc_id, k, strlen(body)::BIGINT + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(body)), lambda i: ('0x' || substr(hex(encode(body)), 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM d, crc_table
),
drawn AS (
  SELECT *, list_transform(range({_SHARDS + 1}), lambda s: {_DRAW.format("k || ':' || s")}) AS draws,
    {_DRAW.format("k || ':' || text_crc32 || ':' || size || ':slot'")} AS o
  FROM sized
),
placed AS (
  SELECT *, (list_position(draws, list_max(draws[1:{_SHARDS}])) - 1)::INTEGER AS shard,
    (list_position(draws, list_max(draws)) - 1)::INTEGER AS grown_shard
  FROM drawn
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents
),
iw AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark
),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM iw WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS p FROM dw, sizes WHERE len(w) >= n)
),
found AS (SELECT r, d.n, p, item FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.g = i.g),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP7 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
),
runs AS (
  SELECT r, o, p, h, array_to_string(l[p : p + h - 1], chr(10)) AS g
  FROM (SELECT r, o, l, h, unnest(range(1, (len(l) - h + 2)::BIGINT)) AS p FROM d, range(1, 4) AS s(h) WHERE len(l) >= h)
),
repeated AS (SELECT * FROM runs WHERE h = 3 OR len(regexp_extract_all(g, '[^\x20\x09-\x0D]+')) >= 50),
later AS (SELECT r, p, h FROM (SELECT r, o, p, h, min({'o': o, 'p': p}) OVER (PARTITION BY h, g) AS first FROM repeated) WHERE {'o': o, 'p': p} > first),
gone AS (SELECT DISTINCT r, unnest(range(p, p + h)) AS q FROM later),
counted AS (
  SELECT r, count(*) AS n_removed, count(*) FILTER (NOT joined) AS n_runs, list(q) AS qs
  FROM (SELECT r, q, coalesce(lag(q) OVER (PARTITION BY r ORDER BY q) = q - 1, false) AS joined FROM gone) GROUP BY r
)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  sha256(coalesce(array_to_string(list_filter(l, lambda x, i: NOT coalesce(list_contains(qs, i), false)), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN counted USING (r)
"""

ORACLE_SQL = {"op1_sharding": OP1, "op2_decontamination": OP2, "op3_line_dedup": OP3, "op7_exact_dedup": OP7}
