"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

OP2 = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS k, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
summed AS (
  SELECT doc_id, size, k,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM sized, crc_table),
line AS (
  SELECT *, (sum(size) OVER w - size)::BIGINT AS pos, row_number() OVER w AS place, (sum(size) OVER ())::BIGINT AS total
  FROM summed WINDOW w AS (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT *, (pos * 16) // total AS shard FROM line)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""

OP10 = r"""
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie,
    (('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '~') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    CASE WHEN length(text) > 0 THEN length(translate(text, '#*$%&|<>{}[]=_~^', ''))::DOUBLE / length(text) ELSE 0.0 END AS clean
  FROM documents),
weighed AS (SELECT *, -ln(u) / greatest((clean * clean) * (clean * clean), 0.001) AS e FROM keyed),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
cycled AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, (sum(source_size) OVER ())::BIGINT AS total
  FROM sizes),
filled AS (
  SELECT *, row_number() OVER f AS r,
    total * 3 - 4 * (sum(source_size) OVER f - source_size)::BIGINT AS left2,
    ((sum(w) OVER ()) - (sum(w) OVER f - w))::BIGINT AS w_left
  FROM cycled WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT r AS lr, left2 AS ll, w_left AS lw FROM filled WHERE 4 * source_size * w_left >= w * left2 ORDER BY r LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN r >= lr THEN (w * ll)::DOUBLE / (2 * lw)::DOUBLE ELSE (source_size * 2)::DOUBLE END AS target
  FROM filled, level),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT doc_id, size, source_size, target, epochs,
    (sum(size) OVER (PARTITION BY k.source ORDER BY e, doc_id NULLS FIRST, tie ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS upto
  FROM weighed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  size * (epochs + CASE WHEN 2 * upto + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS taken
FROM run
"""

OP7 = r"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM split, unnest(range(1, len(w) - 6)) u(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals
  FROM split s LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
ratios AS (
  SELECT doc_id, lang, base_failed, unnest([
    {'rule': 'symbols', 'a': n_symbols, 'b': word_chars}, {'rule': 'dup_lines', 'a': n_dup_lines, 'b': n_lines},
    {'rule': 'repeats', 'a': n_repeat_words, 'b': n_words}, {'rule': 'capitals', 'a': n_capitals, 'b': word_chars}], recursive := true)
  FROM based),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
grid AS (SELECT c, row_number() OVER () AS step FROM unnest([900, 800, 700, 600, 500, 400, 300, 250, 200, 160, 130, 100, 80, 65, 50, 40, 30, 25, 20, 15, 10]) g(c)),
held AS (
  SELECT lang, rule, c, step, count(*) AS n, count(*) FILTER (1000 * a > c * b) AS k
  FROM ratios JOIN good USING (doc_id), grid WHERE NOT base_failed GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN k >= n * 0.005 THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(greatest(j, 0) + 1) - lgamma(n - j + 1) + j * ln(0.005) + (n - j) * ln(0.995)))) END
    <= 0.05 / (4 * (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents))) AS passed
  FROM held),
certified AS (
  SELECT lang, rule, min(c) AS cut
  FROM (SELECT *, bool_and(passed) OVER (PARTITION BY lang, rule ORDER BY step) AS so_far FROM tested) WHERE so_far GROUP BY ALL),
failed AS (
  SELECT DISTINCT doc_id FROM ratios r JOIN certified q ON r.rule = q.rule AND r.lang IS NOT DISTINCT FROM q.lang WHERE 1000 * a > cut * b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM based
"""

OP9 = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best
  FROM pages),
based AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS chunks FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((chunks[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM based
"""

SQL = {"op9_warc": OP9, "op7_quality": OP7, "op2_sharding": OP2, "op10_mixing": OP10}
