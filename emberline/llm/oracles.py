"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

HARD = r"\### Assistant: </turn> ok"

OP1 = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}'),
  e AS (SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '<(turn |next>|/turn>)', '\\\\<\\1', 'g') AS esc, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::bigint AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
    sum(length(esc) + CASE WHEN before IS NULL OR before <> role THEN 8 + length(role) ELSE 0 END + CASE WHEN after IS NULL OR after <> role THEN 9 ELSE 8 END)::bigint AS formatted_chars FROM e GROUP BY conv_id"""

OP3 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
  SELECT page_id, n::bigint AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.d = f.d"""

#: Words as the contract has them, lower-cased for A-Z only.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
  x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s), rare AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.g IN (SELECT g FROM rare) GROUP BY ALL),
  l AS (SELECT a, b FROM o WHERE 100 * i >= 80 * (na + nb - i)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r(id, label) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id WHERE r.label < e.b), m AS (SELECT id, min(label) AS label FROM r GROUP BY 1)
  SELECT doc_id, len(g)::bigint AS n_shingles, label AS component_id, doc_id = label AS kept FROM s JOIN m ON m.id = s.doc_id"""

OP5 = """WITH l AS (SELECT doc_id, i, parts[i] AS line, trim(parts[i], ' ') AS t, source FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents) d) x),
  bad AS (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10), k AS (SELECT *, t IN (SELECT t FROM bad) AS gone FROM l)
  SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (gone)::bigint AS n_removed, length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), ''))::bigint AS kept_chars,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id"""

#: The published loop with 128-bit integers; CRC-32 byte by byte over a table made by its rule.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_TABLE = "SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8"
OP6 = f"""WITH RECURSIVE crc(i, k, c) AS (SELECT range::bigint, 0, range::bigint FROM range(256) UNION ALL SELECT i, k + 1, {_STEP} FROM crc WHERE k < 8), tab AS ({_TABLE}),
  d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::bigint + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
  sums AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, size - 8), lambda i: ('0x' || substr(h, (2 * i + 1)::integer, 2))::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
  j(doc_id, n, key, b, j) AS (SELECT doc_id, n, doc_id::hugeint, -1::bigint, 0::bigint FROM documents, (VALUES (24), (25)) v(n) UNION ALL
    SELECT doc_id, n, (key * 2862933555777941757 + 1) % 18446744073709551616, j, floor((j + 1) * (2147483648e0 / (((key * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592) + 1)::double))::bigint FROM j WHERE j < n),
  s AS (SELECT doc_id, max(CASE WHEN n = 24 THEN b END)::integer AS shard, max(CASE WHEN n = 25 THEN b END)::integer AS grown_shard FROM j GROUP BY 1)
  SELECT s.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY (s.doc_id % 256 + text_crc32) % 256, s.doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s JOIN sums ON s.doc_id = sums.doc_id"""

SQL = {"op1_chat_formatting": OP1, "op3_warc": OP3, "op4_minhash_near_dedup": OP4, "op5_line_dedup": OP5, "op6_sharding": OP6}
