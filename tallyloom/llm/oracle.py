"""DuckDB SQL of the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_UNSPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
c AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS said FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM c)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS said FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, said)),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""

NGRAM_GROUPS = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_UNSPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
f AS (SELECT u, min(v) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f ON f.u = d.doc_id
"""

_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|\[ROLE |\[/ROLE\]"
_ESCAPED = r"<\\s>|<\\/s>|\[\\INST\]|\[\\/INST\]|\[\\ROLE |\[\\/ROLE\]|\\\\"

CHAT_FORMAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, length(text) + CASE WHEN regexp_matches(text, '{_CONTROL}|{_ESCAPED}') THEN len(regexp_extract_all(text, '{_CONTROL}|\\')) ELSE 0 END
  + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

LICENSE_PLACES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
p(pw, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
h AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, pw, label, unnest(range(1, len(w) - len(pw) + 2)) AS i FROM d, p) WHERE w[i : i + len(pw) - 1] = pw),
g AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""

RULE_COUNTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_UNSPACED}) AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o
"""

_BLANKS = r"\x20\x09-\x0D"

#: CRC-32 by its byte table, the damage, the faults, and a step a row that keeps the cheapest (cost, audit) of each of four states.
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS b))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS fate FROM k, crc),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM f, (SELECT unnest([1, 2]) AS copy) WHERE fate <> 0 AND (copy = 1 OR fate = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r FROM d),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_BLANKS}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{_BLANKS}]*\z') THEN 'truncated' END AS fault,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o),
m AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM g),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': ''}} AS s1, {{'c': 5::BIGINT, 'a': 'I'}} AS s2, {{'c': 10::BIGINT, 'a': 'II'}} AS s3 FROM m
  UNION ALL
  SELECT conv_id, i, n0, n1, n2, least(n3, {{'c': n2.c + 5, 'a': n2.a || 'I'}}) FROM (
    SELECT conv_id, i, n0, n1, n3, list_min([n2, {{'c': n0.c + 5, 'a': n0.a || 'I'}}, {{'c': n1.c + 5, 'a': n1.a || 'I'}}, {{'c': n3.c + 5, 'a': n3.a || 'I'}}]) AS n2 FROM (
      SELECT s.conv_id, m.i,
        {{'c': s0.c + 2, 'a': s0.a || 'D'}} AS n0,
        least({{'c': s1.c + 2, 'a': s1.a || 'D'}}, {{'c': CASE WHEN gone OR r <> 's' THEN 1000000000 ELSE s0.c + more END, 'a': s0.a || 'K'}}) AS n1,
        list_min(list_prepend({{'c': s2.c + 2, 'a': s2.a || 'D'}}, flatten(list_transform([s0, s1, s3], lambda p: [{{'c': CASE WHEN gone OR r <> 'u' THEN 1000000000 ELSE p.c + more END, 'a': p.a || 'K'}}, {{'c': CASE WHEN gone THEN 1000000000 ELSE p.c + more + 1 END, 'a': p.a || 'R'}}])))) AS n2,
        list_min([{{'c': s3.c + 2, 'a': s3.a || 'D'}}, {{'c': CASE WHEN gone OR r <> 'a' THEN 1000000000 ELSE s2.c + more END, 'a': s2.a || 'K'}}, {{'c': CASE WHEN gone THEN 1000000000 ELSE s2.c + more + 1 END, 'a': s2.a || 'R'}}]) AS n3
      FROM s JOIN m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1))),
b AS (SELECT conv_id, least(s0, s3) AS best FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
-- each letter of the audit, the row that it takes and the roles before it
x AS (SELECT conv_id, best.c AS cost, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS p FROM b),
y AS (SELECT conv_id, p, audit[p] AS e, length(replace(audit[:p], 'I', '')) AS i, length(replace(replace(audit[:p], 'D', ''), 'S', '')) AS nth FROM x),
z AS (SELECT y.conv_id, p, e, nth, role, text, coalesce(any_value(role) FILTER (nth = 1) OVER (PARTITION BY y.conv_id), '') AS opening FROM y LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM y.conv_id AND m.i = y.i AND e <> 'I' WHERE e <> 'D'),
w AS (SELECT *, bool_or(nth = 1 AND e = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS led FROM z),
q AS (SELECT conv_id, sha256(string_agg((CASE e WHEN 'K' THEN role ELSE CASE (nth + led::INT) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END) || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS digest FROM w GROUP BY 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL = {
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op3_benchmark_decontamination": DECONTAMINATION,
    "op7_ngram_jaccard_join": NGRAM_GROUPS,
    "op9_chat_format": CHAT_FORMAT,
    "license_places": LICENSE_PLACES,
    "quality_rule_counts": RULE_COUNTS,
}
