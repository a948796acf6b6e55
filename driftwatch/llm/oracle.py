"""SQL for DuckDB that gives what the queries over whole tables give, for those that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

#: Words are exploded with their places; windows of five are compared as text. The beta prior is fitted by moments.
OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT r, regexp_extract_all(text, '{_WORD}') AS w FROM d)),
windows AS (SELECT r, pos, string_agg(word, ' ') OVER five AS win, count(*) OVER five AS n FROM words
  WINDOW five AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
often AS (SELECT r, pos, count(*) OVER (PARTITION BY r, win) AS times FROM windows WHERE n = 5),
covered AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM often, range(5) AS steps(k) WHERE times > 1 GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
f AS (SELECT d.r, doc_id, host, len(regexp_extract_all(text, '{_WORD}')) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, few_words OR repetition AS base_failed FROM (SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repetition, 10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS repeated_lines FROM f)),
fails AS (UNPIVOT (SELECT host, few_words::INTEGER AS few_words, repetition::INTEGER AS repetition, symbols::INTEGER AS symbols, repeated_lines::INTEGER AS repeated_lines FROM b WHERE host IS NOT NULL)
  ON few_words, repetition, symbols, repeated_lines INTO NAME rule VALUE failed),
hosts AS (SELECT host, rule, count(*) AS n, sum(failed) AS k FROM fails GROUP BY host, rule),
moments AS (SELECT rule, least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6)::DOUBLE AS m, var_samp(k / n) AS v, avg(1 / n) AS inv FROM hosts GROUP BY rule),
prior AS (SELECT rule, m, CASE WHEN v - m * (1 - m) * inv > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 1), 1000) ELSE 1000 END AS strength FROM moments),
rates AS (SELECT host, max((round((k + m * strength) / (n + strength), 9), rule)) AS worst FROM hosts JOIN prior USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(worst[1] > 0.5, false) AS kept, worst[2] AS host_rule, worst[1] AS host_rate
FROM b LEFT JOIN rates USING (host)
"""

#: Base 32 by way of the digest's bits, five at a time.
OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM digests),
coded AS (SELECT page_id, payload_bytes::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS least,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_sum(list_transform(range(5), lambda j: substr(bits, k * 5 + j + 1, 1)::INTEGER * (16 >> j::INTEGER)))::INTEGER + 1, 1)), '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM coded
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Windows as text, joined on equality; an item of fewer words than a window has one of its own size.
OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
windows AS (SELECT r, n, pos, string_agg(word, ' ') OVER own AS win, count(*) OVER own AS size FROM words, sizes
  WINDOW own AS (PARTITION BY r, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
hits AS (SELECT r, pos, w.n, item FROM windows w JOIN item_windows i ON w.win = i.win AND w.n = i.n WHERE size = w.n),
hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS place FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_RUN = "[A-Za-z0-9+/_=-]{20,}"
_ALLOWED = "(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|sample|dummy|placeholder|abcdefgh|01234567|" + "|".join(
    ("[+]" if c == "+" else c) + "{6,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
)


def _found(kind: str, rank: int, pattern: str, keep: str, group: int = 0) -> str:
    """Matches with their places: each starts after the texts between and of the matches before it."""
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, value, stop - length(whole) AS start, stop FROM (
  SELECT r, k, whole, value, sum(length(gap) + length(whole)) OVER (PARTITION BY r ORDER BY k) AS stop FROM (
    SELECT r, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS whole, unnest(v) AS value, unnest(gaps[:len(m)]) AS gap FROM (
      SELECT r, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)))
  WHERE {keep}"""


#: Fixed patterns; then runs of the candidates' characters, whose windows of 20 are weighed by the definition of entropy.
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_found("assign", 0, _ASSIGN, "length(value) >= 8", 2)}
  UNION ALL {_found("access", 1, "AKIA[A-Z0-9]+", "length(whole) >= 16")}
  UNION ALL {_found("hex", 2, "[0-9a-f]+", "length(whole) >= 32")}),
runs AS ({_found("entropy", 3, _RUN, "true")}),
gaps AS (SELECT r, start AS run, unnest(range(1, len(g) + 1)) AS k, unnest(g) AS value, unnest(list_concat(m, [''])) AS allowed FROM (
  SELECT r, start, regexp_split_to_array(value, '{_ALLOWED}') AS g, regexp_extract_all(value, '{_ALLOWED}') AS m FROM runs)),
parts AS (SELECT r, value, stop - length(value) AS start, stop FROM (
  SELECT r, value, run + sum(length(value) + length(allowed)) OVER (PARTITION BY r, run ORDER BY k) - length(allowed) AS stop FROM gaps) WHERE length(value) >= 20),
apart AS (SELECT * FROM parts c WHERE NOT EXISTS (FROM base b WHERE b.r = c.r AND b.start < c.stop AND c.start < b.stop)),
candidates AS (
  SELECT *, 3.0 AS bits FROM apart WHERE regexp_full_match(value, '[0-9a-fA-F]+') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-fA-F]')
  UNION ALL SELECT *, 3.9 AS bits FROM apart WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')),
windows AS (SELECT r, start, value, bits, unnest(range(0, length(value) - 19)) AS i FROM candidates),
letters AS (SELECT r, start, bits, i, c, count(*) AS n FROM (SELECT r, start, bits, i, unnest(string_split(substr(value, i + 1, 20), '')) AS c FROM windows) GROUP BY ALL),
dense AS (SELECT r, start, bits, i FROM letters GROUP BY ALL HAVING log2(20) - sum(n * log2(n)) / 20 >= bits - 1e-9),
entropy AS (SELECT DISTINCT r, 'entropy' AS kind, 3 AS rank, a AS start, z AS stop FROM (
  SELECT r, bits, start + min(i) AS a, start + max(i) + 20 AS z FROM dense GROUP BY r, start, bits)),
spans AS (SELECT r, kind, rank, start, stop FROM base UNION ALL SELECT * FROM entropy),
listed AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, rank, stop) FILTER (kind <> 'entropy') AS base_spans,
  string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, rank, stop) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)
"""

#: Masks of the texts, the smallest id of each text, then every order's steps against the cells.
OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
known AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER
  + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INTEGER + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER
  + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INTEGER AS mask FROM d LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT concat(a.name, b.name, c.name, d.name, e.name) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INTEGER AS before FROM orders, range(1, 6) AS s(step)),
placed AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (bit | before) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
  sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM placed
"""

SQL = {"op1_quality_rules": OP1, "op4_warc": OP4, "op5_decontamination": OP5, "op7_secret_scan": OP7, "op13_filter_audit": OP13}
