"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from murmura.llm.quality import LineRules

_R = LineRules()
#: A word of every contract, for DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chars(s: str) -> str:
    """A character class of plain marks."""
    return "[" + "".join("\\" + c for c in s) + "]" if s.isascii() else "[" + s + "]"


OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
win AS (SELECT doc_id, i, words[i:i+4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d),
line AS (SELECT doc_id, parts[k] AS line, k FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM cut)),
m AS (
  SELECT doc_id, line, k, len(regexp_extract_all(line, '{WORD}')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    length(line) - length(regexp_replace(line, '{_chars(_R.noise)}', '', 'g')) AS noise,
    length(line) - length(regexp_replace(line, '{_chars(_R.separators)}', '', 'g')) AS seps
  FROM line
),
j AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS dup,
    (noise >= {_R.noise_least} AND 2 * noise > n)
    OR NOT regexp_matches(line, {_q(_R.sentence_end)})
    OR (seps >= {_R.separators_least} AND n <= {_R.words_per_part} * (seps + 1))
    OR regexp_matches(line, {_q("(?i:" + _R.boilerplate_pattern() + ")")}) AS fails
  FROM m WHERE n > 0
),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(chars) FILTER (fails), 0) AS chars_removed FROM j GROUP BY doc_id),
a AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(chars_removed, 0) AS chars_removed
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN l USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words) AND 100 * chars_removed <= {_R.max_loss_percent} * word_chars AS kept,
  n_lines::BIGINT AS n_lines, n_lines_removed::BIGINT AS n_lines_removed, chars_removed::BIGINT AS chars_removed
FROM a
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
hits AS (
  SELECT page_id, rules.host || rules.path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rules.host) DESC, length(rules.path) DESC) AS r
  FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
)
SELECT u.page_id, u.host, u.path, hits.rule, coalesce(hits.verdict, 'allow') AS verdict FROM u LEFT JOIN hits ON u.page_id = hits.page_id AND r = 1
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, k, parts[k] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM d)),
x AS (SELECT doc_id, k, line, {_LOWER.format("regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l),
f AS (SELECT doc_id, k, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM x)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

#: All windows: any that passes shares four tokens in a row, so diagonals come from a join on those.
OP2 = r"""
WITH d AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS h FROM documents),
b AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS ih FROM benchmark),
dg AS (SELECT doc_id, h, i, h[i:i+3] AS g FROM (SELECT doc_id, h, unnest(range(1, len(h) - 2)) AS i FROM d WHERE len(h) >= 4)),
bg AS (SELECT item_id, ih, j, ih[j:j+3] AS g FROM (SELECT item_id, ih, unnest(range(1, len(ih) - 2)) AS j FROM b WHERE len(ih) >= 13)),
dia AS (SELECT DISTINCT doc_id, h, item_id, ih, i - j AS k FROM dg JOIN bg USING (g)),
win AS (SELECT doc_id, item_id, k, unnest(range(greatest(1, 1 - k), least(len(ih), len(h) - k) - 11)) AS s, h, ih FROM dia),
m AS (SELECT doc_id, item_id, list_sum(list_transform(range(0, 13), lambda o: CASE WHEN ih[s + o] = h[s + k + o] THEN 1 ELSE 0 END)) AS n FROM win)
SELECT doc_id, item_id, count(*)::BIGINT AS n_windows, max(n)::BIGINT AS best_matches FROM m WHERE n >= 11 GROUP BY ALL
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

#: Links by counting shared shingles, then reachability by repeated minimum.
OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, ws[i:i+4] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 4)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


def _assigned(codebook: str) -> str:
    """Each part's nearest entry of a codebook, ties to the lower index."""
    return f"SELECT vec_id, label, p, x, least // 64 AS error, least % 64 AS e FROM (SELECT vec_id, label, p, x, min(64 * list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + e) AS least FROM part JOIN {codebook} USING (p) GROUP BY ALL)"


def _moved(codebook: str, assigned: str) -> str:
    """A codebook whose used entries are floors of their parts' means."""
    return f"""SELECT p, e, CASE WHEN m IS NULL THEN c ELSE m END AS c FROM {codebook} LEFT JOIN (
  SELECT p, e, list(((total - ((total % n) + n) % n) // n) ORDER BY i) AS m FROM (
    SELECT p, e, i, sum(x[i])::BIGINT AS total, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM {assigned}) GROUP BY ALL) GROUP BY ALL) USING (p, e)"""


OP11 = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(0, 16)) AS p FROM kept)),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64) USING (vec_id)),
a0 AS MATERIALIZED ({_assigned("c0")}),
c1 AS MATERIALIZED ({_moved("c0", "a0")}),
a1 AS MATERIALIZED ({_assigned("c1")}),
c2 AS MATERIALIZED ({_moved("c1", "a1")}),
a2 AS MATERIALIZED ({_assigned("c2")}),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
codes AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(error)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes, books
"""

OP12 = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
m AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

ORACLES = {"op2_benchmark_decontamination": OP2, "op8_ngram_jaccard_join": OP8, "op9_warc": OP9, "op7_line_dedup": OP7, "op1_quality_rules": OP1, "op4_url_filters": OP4, "op11_vector_codes": OP11, "op12_filter_audit": OP12}
