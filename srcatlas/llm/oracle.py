"""Expected results as DuckDB SQL, where SQL can express them; written from the contracts, not from the operators."""

OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, m.n, n.n
  HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l ON l.node = d.doc_id
"""

OP4 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), first AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i
  FROM (SELECT x.doc_id, x.i FROM windows x JOIN first f ON f.h = x.h WHERE f.least < x.doc_id), range(50) t(k)
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), cut AS (
  SELECT e.doc_id, count(g.i) AS n_removed,
    string_agg(CASE WHEN g.i IS NULL THEN e.word END, ' ' ORDER BY e.i) AS kept
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
  GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n_removed, 0) AS n_removed,
  sha256(coalesce(c.kept, '')) AS kept_sha256
FROM words w LEFT JOIN cut c USING (doc_id)
"""

OP5 = r"""
WITH RECURSIVE bit(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8
), rows_ AS (
  SELECT doc_id, (len(h) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, [('0x' || h[2 * j + 1:2 * j + 2])::BIGINT FOR j IN range(len(h) // 2)]),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), crc
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number, count(*) OVER () AS n FROM rows_
), sized AS (
  SELECT row_number, n, (1::BIGINT << greatest(1, (floor(log2(greatest(n - 1, 1)))::BIGINT + 2) // 2)::INT) AS half FROM numbered
), net(row_number, n, half, k, l, r) AS (
  SELECT row_number, n, half, 0, row_number // half, row_number % half FROM sized
  UNION ALL
  SELECT row_number, n, half, k + 1, r, xor(l, (mixed // 32768 % half)::BIGINT)
  FROM (
    SELECT *, (xor(first, first >> 16)::HUGEINT * 2654435761) % 18446744073709551616 AS mixed
    FROM (
      SELECT *, ((r + [314159265, 358979323, 846264338, 327950288, 419716939, 937510582][k % 6 + 1])::UBIGINT * 2654435761::UBIGINT) AS first
      FROM net WHERE k % 6 <> 0 OR k = 0 OR l * half + r >= n
    )
  )
), places AS (
  SELECT row_number, l * half + r AS place FROM net WHERE k > 0 AND k % 6 = 0 AND l * half + r < n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 16)::INTEGER AS shard, place // 16 AS slot,
  NULL::INTEGER AS grown_shard, row_number
FROM numbered JOIN places USING (row_number)
"""

OP6 = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), sources AS (
  SELECT source, sum(n_tokens)::BIGINT AS t FROM tokens GROUP BY source
), used AS (
  SELECT source, t, t / (SELECT sum(t)::DOUBLE FROM sources) AS p FROM sources WHERE t > 0
), shares AS (
  SELECT list(p) AS ps, count(*) AS n, max(p) AS most, min(p) AS least FROM used
), flat(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      ln(list_sum([pow(p, (lo + hi) / 2) FOR p IN ps]))
        - (lo + hi) / 2 * list_sum([pow(p, (lo + hi) / 2) * ln(p) FOR p IN ps])
          / list_sum([pow(p, (lo + hi) / 2) FOR p IN ps]) <= 0.98 * ln(n) + 1e-12 AS ok
    FROM flat, shares WHERE i < 44
  )
), rare(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, pow(most / least, 1 - (lo + hi) / 2) <= 2.0 + 1e-12 AS ok
    FROM rare, shares WHERE i < 44
  )
), chosen AS (
  SELECT round(greatest((SELECT hi FROM flat WHERE i = 44), (SELECT hi FROM rare WHERE i = 44)), 9) AS alpha
), plan AS (
  SELECT source, t, round(pow(p, alpha) / (SELECT sum(pow(p, alpha)) FROM used, chosen), 9) AS weight,
    pow((SELECT max(p) FROM used) / p, 1 - alpha) AS epochs,
    floor(t * pow((SELECT max(p) FROM used) / p, 1 - alpha) + 0.5)::BIGINT AS budget
  FROM used, chosen
), planned AS (
  SELECT s.source, coalesce(p.weight, 0.0) AS weight, coalesce(p.epochs, 1.0) AS epochs,
    coalesce(p.budget // p.t, 1) AS blocks, coalesce(p.budget % p.t, 0) AS rest
  FROM sources s LEFT JOIN plan p ON p.source IS NOT DISTINCT FROM s.source
), whole AS (
  SELECT d.doc_id, d.source, d.n_tokens, p.weight, p.epochs, unnest(range(p.blocks)) AS block
  FROM tokens d JOIN planned p ON p.source IS NOT DISTINCT FROM d.source
), part AS (
  SELECT doc_id, source, n_tokens, weight, epochs, block
  FROM (
    SELECT d.doc_id, d.source, d.n_tokens, p.weight, p.epochs, p.blocks AS block, p.rest,
      sum(d.n_tokens) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || p.blocks || ':' || d.doc_id)) AS run
    FROM tokens d JOIN planned p ON p.source IS NOT DISTINCT FROM d.source WHERE p.rest > 0
  ) WHERE run <= rest
), drawn AS (
  SELECT * FROM whole UNION ALL SELECT * FROM part
)
SELECT doc_id, source, n_tokens, weight, block::INTEGER AS block,
  round((block + ('0x' || left(md5('mix-1:' || block || ':' || doc_id), 8))::BIGINT / 4294967296.0::DOUBLE) / epochs, 6) AS place
FROM drawn
"""

OP7 = r"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(k)
), sized AS (
  SELECT *, 12 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11 AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP12 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    [('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 1 + 8 * k, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS h
  FROM documents
), placed AS (
  SELECT *, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a,
    greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b
  FROM cut
), parts AS (
  SELECT doc_id, t, n, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
    array_to_string(tokens[b + 1:n], '') AS suffix,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

SQL: dict[str, str] = {
    "op1_near_duplicates": OP1,
    "op4_substring_dedup": OP4,
    "op5_sharding": OP5,
    "op6_mixing": OP6,
    "op7_chat_format": OP7,
    "op12_fill_in_middle": OP12,
}
