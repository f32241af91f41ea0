"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS1 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS1} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS1} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
widths AS (SELECT DISTINCT n FROM grams),
wins AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, widths WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, i, wins.n FROM wins JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WORDS9 = "regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')"

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
firsts AS (SELECT g, min(doc_id) AS least FROM wins GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM wins JOIN firsts USING (g) WHERE doc_id > least
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""



def _spans(kind: str, pattern: str, keep: str, group: int = 0) -> str:
    """A list of {kind, a, b, n} of the matches that pass, with their places: text between matches and matches take turns."""
    m, p = f"regexp_extract_all(t, '{pattern}')", f"string_split_regex(t, '{pattern}')"
    body = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""SELECT doc_id, '{kind}' AS kind, a, a + length(m) AS b, {_KINDS[kind]} AS k FROM (
  SELECT doc_id, unnest(m) AS m, unnest(v) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))) AS a
  FROM (SELECT doc_id, {m} AS m, {body} AS v, {p} AS p FROM d) WHERE len(m) > 0
) WHERE {keep}"""


_KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "assign": 0, "access": 1, "hex": 2}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT)
  ELSE CAST(substr(reverse({_DIGITS}), i, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_TEXTS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"

PII = f"""
WITH {_TEXTS}, spans AS (
{_spans("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
UNION ALL {_spans("ip", "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS UBIGINT), 999) > 255)) = 0")}
UNION ALL {_spans("card", "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")}
UNION ALL {_spans("phone", "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")}
)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a), '')) AS base_sha256
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""

_EITHER = "".join(c if not c.isalpha() else f"[{c.upper()}{c}]" for c in "(password|passwd|secret|token|api_?key)")

SECRETS = f"""
WITH {_TEXTS}, spans AS (
{_spans("assign", _EITHER.replace("(", "(?:", 1) + """["'']?[ ]*[:=][ ]*["'']?([A-Za-z0-9+/_.=-]+)""", "length(v) >= 6", 1)}
UNION ALL {_spans("access", "AKIA[A-Z0-9]+", "length(m) >= 20")}
UNION ALL {_spans("hex", "[0-9a-f]{24,}", "true")}
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k), '')) AS base_sha256
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""

_WORD = "[^ \\x09-\\x0D]"

COUNTS = f"""
WITH {_TEXTS}, w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}+') AS w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM windows JOIN again USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
counts AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN hit USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""

LAW = """
WITH n AS (SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))) + 1) AS size FROM documents)
SELECT CAST(s AS INT) AS shard, CAST((n - s + 15) // 16 AS BIGINT) AS records, CAST((n - s + 15) // 16 AS BIGINT) AS slots, CAST(0 AS BIGINT) AS first_slot,
  CAST((n - s + 15) // 16 - 1 AS BIGINT) AS last_slot, CAST(size AS BIGINT) AS size FROM n, range(16) t(s) WHERE n > s
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) END AS s FROM d
),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS g FROM classes),
edges AS (
  SELECT a, b FROM (SELECT x.c AS a, y.c AS b, x.n AS m, y.n AS n, count(*) AS shared FROM tokens x JOIN tokens y ON x.g = y.g AND x.c <> y.c AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n GROUP BY ALL)
  WHERE 100 * shared >= 90 * (m + n - shared)
),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN roots USING (c)
"""


OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS9} AS w FROM documents),
f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) THEN 16 ELSE 0 END AS m FROM d
),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(x, b)),
taken AS (SELECT x AS o, [b] AS bits FROM letters UNION ALL SELECT o || x, list_append(bits, b) FROM taken, letters WHERE NOT contains(o, x)),
steps AS (
  SELECT o AS filter_order, CAST(s AS INT) AS step, bits[s] AS b, coalesce(list_sum(bits[1:s-1]), 0)::INT AS e
  FROM (SELECT * FROM taken WHERE length(o) = 5), range(1, 6) r(s)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (m & (b | e) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (m & b > 0 AND m & e = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (m & b > 0 AND m & e > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = b), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (m & b > 0 AND m & e = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (m & b > 0 AND m & e = 0), 0)::BIGINT AS toxic_lost,
  coalesce((SELECT sum(c2.n) FROM c c2, steps s2 WHERE c2.part = c.part AND s2.b = steps.b AND c2.m & s2.b > 0 AND c2.m & s2.e = 0), 0)::BIGINT AS shapley
FROM c, steps GROUP BY part, filter_order, step, b, e
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op5_jaccard_join": OP5, "op9_substring_dedup": OP9, "op13_filter_audit": OP13, "pii_base": PII, "quality_counts": COUNTS, "secrets_base": SECRETS, "sharding_law": LAW}
