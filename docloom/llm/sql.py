"""SQL for the queries that SQL can express, written from their contracts and not from the operators.

Left out: op1 (name-based UUIDs, base-32 digests), op3 (shards by a 64-bit hash of Spark's), op5 (concentration steps), op6 and op8
(a tokenizer), op7 (a learned model), op11 (XXH64); tests hold those against brute force, round trips or held-out rows.
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(2, len(w)) - 1], ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(w) - least(2, len(w)) + 2)) AS k) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (
  SELECT s.doc_id, g, n FROM s JOIN n ON n.doc_id = s.doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2
), l AS (
  SELECT a, b FROM both_ WHERE 100 * c >= 80 * (na + nb - c) UNION SELECT b, a FROM both_ WHERE 100 * c >= 80 * (na + nb - c)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), m AS (
  SELECT a, min(b) AS m FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""

URLS = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 1 THEN (2 * d[length(d) - i]::INT) // 10 + (2 * d[length(d) - i]::INT) % 10 ELSE d[length(d) - i]::INT END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", "list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(v, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END), ''), ''), lambda c: c::INT)), lambda a, b: (a * 10 + b) % 97) = 1"),
    ("secret", r"[A-Za-z0-9]+", "regexp_full_match(v, '[0-9a-fA-F]{32,128}') AND regexp_matches(lower(substr(text, greatest(s - 40, 0) + 1, least(s, 40)) || ' ' || substr(text, s + length(v) + 1, 25)), 'token|secret|password|passwd|api.?key|credential')"),
)


def _kind(rank: int, name: str, pattern: str, valid: str) -> str:
    return rf"""
  SELECT r, {rank} AS rank, '{name}' AS kind, s, s + length(v) AS e FROM (
    SELECT r, text, m[k] AS v, regexp_replace(m[k], '[^0-9]', '', 'g') AS d, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT r, text, regexp_extract_all(text, '{pattern}', 0) AS m, string_split_regex(text, '{pattern}') AS g FROM t), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS k)
  ) WHERE {valid}"""


PERSONAL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), f AS ({" UNION ALL ".join(_kind(i, *k) for i, k in enumerate(_KINDS))}
), a AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 4) AS base,
    {", ".join(f"count(*) FILTER (WHERE kind = '{k[0]}') AS n_{k[0]}" for k in _KINDS[:4])} FROM f GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in _KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a ON a.r = t.r
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = rf"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g
  FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k) WHERE len(w) > 0
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents
), sizes AS (
  SELECT DISTINCT n FROM win
), gram AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)
), hit AS (
  SELECT r, gram.n, k, item FROM gram JOIN win ON win.n = gram.n AND win.g = gram.g
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
), place AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hit, LATERAL (SELECT unnest(range(k, k + n)) AS p) GROUP BY r
), word AS (
  SELECT r, p, w[p] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)
), asked AS (
  SELECT DISTINCT i, item, unnest(w) AS word FROM (SELECT row_number() OVER () AS i, * FROM i)
), often AS (
  SELECT word, count(*) AS n FROM word WHERE word IN (SELECT word FROM asked) GROUP BY word
), rare AS (
  SELECT i, item, word, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY i ORDER BY coalesce(n, 0), word) AS k FROM asked LEFT JOIN often USING (word) QUALIFY k <= 3
), three AS (
  SELECT i, item, max(word) FILTER (WHERE k = 1) AS a, max(word) FILTER (WHERE k = 2) AS b, max(word) FILTER (WHERE k = 3) AS c FROM rare GROUP BY i, item HAVING min(n) > 0
), placed AS (
  SELECT * FROM word WHERE word IN (SELECT word FROM rare)
), near AS (
  SELECT r, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT x.r, item FROM three JOIN placed x ON x.word = a
    WHERE (b IS NULL OR EXISTS (SELECT 1 FROM placed y WHERE y.r = x.r AND y.word = b AND y.p BETWEEN x.p - 20 AND x.p + 20))
      AND (c IS NULL OR EXISTS (SELECT 1 FROM placed z WHERE z.r = x.r AND z.word = c AND z.p BETWEEN x.p - 20 AND x.p + 20))
  ) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near_items, coalesce(near.items, '') AS near_items
FROM d LEFT JOIN items ON items.r = d.r LEFT JOIN place ON place.r = d.r LEFT JOIN near ON near.r = d.r
"""

COLLOCATIONS = rf"""
WITH p AS (
  SELECT row_number() OVER () AS i, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
  )
), n AS (
  SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), f AS (
  SELECT lang, w[k:k + m - 1] AS w, count(*) AS a
  FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS k) GROUP BY 1, 2 HAVING count(*) >= 100
), inside AS (
  SELECT DISTINCT lang, w[k:k + m - 1] AS w, a FROM f, (SELECT unnest([2, 3, 4]) AS m), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS k) WHERE m < len(w)
), cut AS (
  SELECT f.lang, f.w, f.a, k, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * f.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1) f
  JOIN f x ON x.lang = f.lang AND x.w = f.w[1:k] JOIN f y ON y.lang = f.lang AND y.w = f.w[k + 1:] JOIN n ON n.lang = f.lang
), best AS (
  SELECT lang, w, any_value(a) AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, any_value(n) AS n, min(score) AS score FROM cut GROUP BY lang, w
), ranked AS (
  SELECT best.*, array_to_string(best.w, ' ') AS phrase, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, array_to_string(best.w, ' ')) AS rank
  FROM best ANTI JOIN inside ON inside.lang = best.lang AND inside.w = best.w AND inside.a = best.a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000
"""


def _add(way: str, cost: str, letters: str) -> str:
    """A way (eight digits of cost, then letters) with more of both; null stays null."""
    return f"printf('%08d', {way}[1:8]::INT + {cost}) || {way}[9:] || '{letters}'"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


_CUT = "CASE WHEN cut THEN 3 ELSE 0 END"
_U = _least("u", _add("none", "3", "I"), _add("s", "3", "I"), _add("a", "3", "I"))
_A = _least("a", _add("u", "3", "I"), _add("none", "6", "II"), _add("s", "6", "II"))

CONVERSATIONS = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), crc AS (
  SELECT name, len(name) AS n, 4294967295::UBIGINT AS c, 0 AS i FROM (SELECT DISTINCT name FROM raw)
  UNION ALL
  SELECT name, n, list_reduce(list_prepend(xor(c, ascii(name[i + 1])::UBIGINT), range(8)::UBIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), i + 1 FROM crc WHERE i < n
), kind AS (
  SELECT name, xor(c, 4294967295::UBIGINT) % 20 AS kind FROM crc WHERE i = n
), turns AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw JOIN kind USING (name), LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))
), ordered AS (
  SELECT *, coalesce(conv_id::VARCHAR, '') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, E' \t\n\x0b\f\r') AS rest FROM turns
), rows_ AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rest = '' AS blank, right(rest, 1) NOT IN ('.', '!', '?') AS cut, role[1:1] AS r, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered
), way AS (
  SELECT DISTINCT c, 0::BIGINT AS i, '00000000' AS none, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM rows_
  UNION ALL
  SELECT c, i, {_add("none", "4", "D")},
    CASE WHEN gone OR r <> 's' THEN {_add("s", "4", "D")} ELSE {_least(_add("s", "4", "D"), _add("none", _CUT, "K"))} END,
    CASE WHEN gone THEN {_add("u1", "4", "D")} WHEN r = 'u' THEN {_least(_add("u1", "4", "D"), _add("to_u", "3 + " + _CUT, "R"), _add("to_u", _CUT, "K"))} ELSE {_least(_add("u1", "4", "D"), _add("to_u", "3 + " + _CUT, "R"))} END,
    CASE WHEN gone THEN {_add("a1", "4", "D")} WHEN r = 'a' THEN {_least(_add("a1", "4", "D"), _add("u1", "3 + " + _CUT, "R"), _add("u1", _CUT, "K"))} ELSE {_least(_add("a1", "4", "D"), _add("u1", "3 + " + _CUT, "R"))} END
  FROM (SELECT rows_.c, rows_.i, rows_.r, rows_.cut, blank OR again AS gone, none, s, {_U} AS u1, {_A} AS a1, least(none, s, {_A}) AS to_u FROM way JOIN rows_ ON rows_.c = way.c AND rows_.i = way.i + 1)
), done AS (
  SELECT c, {_least("none", "a", _add("u", "3", "I"), _add("s", "6", "II"))} AS best FROM way QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1
), letter AS (
  SELECT c, k, best[8 + k:8 + k] AS x, sum((best[8 + k:8 + k] <> 'I')::INT) OVER w AS i, sum((best[8 + k:8 + k] <> 'D')::INT) OVER w AS p
  FROM done, LATERAL (SELECT unnest(range(1, length(best) - 7)) AS k) WINDOW w AS (PARTITION BY c ORDER BY k)
), named AS (
  SELECT letter.*, role, text, max((x = 'K' AND p = 1 AND r = 's')::INT) OVER (PARTITION BY letter.c) AS system FROM letter LEFT JOIN rows_ ON rows_.c = letter.c AND rows_.i = letter.i AND x <> 'I'
), line AS (
  SELECT c, string_agg(CASE x WHEN 'K' THEN role ELSE CASE WHEN (p - system) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE x WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS lines FROM named WHERE x <> 'D' GROUP BY c
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate,
    count(*) FILTER (WHERE NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (WHERE i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best[1:8]::BIGINT, 0) AS cost, coalesce(best[9:], '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) LEFT JOIN counts USING (c) LEFT JOIN done USING (c) LEFT JOIN line USING (c)
"""

SQL = {"op2_setsketch": NEAR_DUPLICATES, "op4_host_trie": URLS, "op9_spans": PERSONAL, "op10_inverted_index": CONTAMINATION, "op12_pattern_growth": COLLOCATIONS, "op13_retained_turns": CONVERSATIONS}
