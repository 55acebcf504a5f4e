"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations


def _placed(source: str, patterns: dict[str, str]) -> str:
    """found(doc_id, kind, m, start, before, after): leftmost matches of each pattern with code-point offsets."""
    parts = [
        f"SELECT doc_id, '{kind}' AS kind, regexp_extract_all(s, '{p}', 0) AS ms, string_split_regex(s, '{p}') AS ps FROM {source}" for kind, p in ((k, v.replace("'", "''")) for k, v in patterns.items())
    ]
    return f"""searched AS ({' UNION ALL '.join(parts)}),
spread AS (SELECT doc_id, kind, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(ps[2:]) AS q, unnest(range(1, len(ms) + 1)) AS i FROM searched WHERE len(ms) > 0),
found AS (
  SELECT doc_id, kind, m, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m) AS BIGINT) AS start, right(p, 80) AS before, left(q, 80) AS after FROM spread
)"""


def _spans(kinds: list[str], where: str = "true") -> str:
    rank = " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(kinds))
    return f"string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, CASE kind {rank} END) FILTER (WHERE {where})"


# Written out here, not taken from the operators.
_ASSIGN = """[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"""
_VALUE = """["']?[ ]*[:=][ ]*["']?"""
_NO_SECRET = ["^[A-Za-z]+$", "^[0-9_=+/-]+$", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "(?i)example|sample|dummy|placeholder|changeme|lorem", "(?i)^(?:0123456789|abcdefghij|qwertyuiop)", "^[A-Za-z]+(?:[/_-][A-Za-z]+)+[0-9]{0,4}$"]
_BITS = "CASE WHEN regexp_matches(m, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN 3.0 WHEN regexp_matches(m, '^(?:[0-9a-z]+|[0-9A-Z]+)$') THEN 3.6 WHEN regexp_matches(m, '^[0-9A-Za-z]+$') THEN 3.8 WHEN regexp_matches(m, '^[0-9A-Za-z+/_=-]+$') THEN 3.9 END"
_SECRETS = ["assign", "access", "hex", "entropy"]
OP3 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
{_placed('texts', {'assign': f'(?:{_ASSIGN}){_VALUE}[A-Za-z0-9+/_.=-]+', 'access': 'AKIA[A-Z0-9]{16,}', 'hex': '[0-9a-f]{24,}', 'run': '[A-Za-z0-9+/_=-]{20,}'})},
base AS (
  SELECT doc_id, kind, m, start, start + length(m) AS stop FROM found
  WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND length(regexp_extract(m, '^(?:{_ASSIGN}){_VALUE.replace("'", "''")}([A-Za-z0-9+/_.=-]+)', 1)) >= 6)
),
reached AS (SELECT doc_id, start, stop, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM base),
grouped AS (SELECT doc_id, start, stop, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS g FROM reached),
known AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM grouped GROUP BY doc_id, g),
runs AS (
  SELECT doc_id, m, start, start + length(m) AS stop FROM found f WHERE kind = 'run' AND regexp_matches(m, '[0-9]') AND NOT ({' OR '.join(f"regexp_matches(m, '{p}')" for p in _NO_SECRET)})
    AND NOT EXISTS (SELECT 1 FROM known b WHERE b.doc_id = f.doc_id AND b.start <= f.start AND b.stop >= f.start + length(f.m))
),
windows AS (SELECT doc_id, start, stop, m, unnest(range(0, length(m) - 20 + 1)) AS w FROM runs),
letters AS (SELECT doc_id, start, stop, m, w, substr(m, CAST(w + j AS BIGINT), 1) AS c FROM windows, range(1, 21) t(j)),
counted AS (SELECT doc_id, start, stop, m, w, c, count(*) AS n FROM letters GROUP BY ALL),
entropies AS (SELECT doc_id, start, stop, m, w, log2(20) - sum(n * log2(n)) / 20 AS h FROM counted GROUP BY doc_id, start, stop, m, w),
secret AS (SELECT doc_id, 'entropy' AS kind, m, start, stop FROM entropies GROUP BY doc_id, start, stop, m HAVING max(h) >= {_BITS}),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, kind, m, start, stop FROM secret),
joined AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _SECRETS)}, {_spans(_SECRETS, "kind <> 'entropy'")} AS base, {_spans(_SECRETS)} AS spans FROM every GROUP BY doc_id
)
SELECT t.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _SECRETS[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM texts t LEFT JOIN joined j ON j.doc_id = t.doc_id
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""(SELECT sum(CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, CAST(i AS BIGINT), 1) AS INTEGER)
  ELSE 2 * CAST(substr({_DIGITS}, CAST(i AS BIGINT), 1) AS INTEGER) - CASE WHEN substr({_DIGITS}, CAST(i AS BIGINT), 1) > '4' THEN 9 ELSE 0 END END) FROM range(1, length({_DIGITS}) + 1) t(i)) % 10 = 0"""
_BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?"
_RATED = "SELECT kind, pattern, sum(score) / (count(*) + 1) AS confidence, sum(seed) AS support FROM {0} GROUP BY kind, pattern"
_SCORED = """SELECT e.kind, e.pattern, e.value, e.seed, greatest(e.seed, l.best) AS score FROM edges e
  JOIN (SELECT x.kind, x.value, max(r.confidence) AS best FROM edges x JOIN {0} r ON r.kind = x.kind AND r.pattern = x.pattern GROUP BY x.kind, x.value) l ON l.kind = e.kind AND l.value = e.value"""
_PERSONAL = ["email", "ip", "card", "phone"]
OP1 = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
{_placed('texts', {'email': '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'ip': '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', 'card': '[0-9](?:[ -]?[0-9])+', 'phone': '[+][0-9][ ().0-9-]+[0-9]', 'word': '[^ \\x09-\\x0D0-9@]*[0-9@][^ \\x09-\\x0D]*'})},
base AS (
  SELECT doc_id, kind, m, start, start + length(m) AS stop, before, after FROM found
  WHERE kind = 'email' OR (kind = 'ip' AND regexp_full_match(m, '{_BYTE}(?:[.]{_BYTE}){{3}}'))
     OR (kind = 'card' AND length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}) OR (kind = 'phone' AND length({_DIGITS}) BETWEEN 10 AND 15)
),
words AS (
  SELECT doc_id, lower(m) AS m, start, start + length(m) AS stop, before, after FROM found f WHERE kind = 'word'
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start < f.start + length(f.m) AND b.stop > f.start)
),
shaped AS (
  SELECT w.*, k.kind FROM words w, (VALUES ('email'), ('ip'), ('card'), ('phone')) k(kind)
  WHERE CASE k.kind WHEN 'email' THEN regexp_matches(m, '^[^@]+@[^@]+$') WHEN 'ip' THEN regexp_matches(m, '[0-9]{{1,3}}(?:[.:_]+[0-9]{{1,3}}){{3}}')
        WHEN 'card' THEN length({_DIGITS}) BETWEEN 13 AND 19 AND NOT regexp_matches(m, '[a-z@]') ELSE length({_DIGITS}) BETWEEN 7 AND 15 AND NOT regexp_matches(m, '[a-z@]') END
),
seen AS (SELECT doc_id, kind, lower(m) AS value, start, stop, before, after, 1.0::DOUBLE AS seed FROM base UNION ALL SELECT doc_id, kind, m, start, stop, before, after, 0.0 FROM shaped),
sides AS (SELECT *, lower(regexp_extract(before, '(\S{{1,40}})\s*$', 1)) AS l, lower(regexp_extract(after, '^\S{{0,40}}?\s+(\S{{1,40}})', 1)) AS r FROM seen),
beside AS (
  SELECT *, '<' || l AS pattern FROM sides WHERE l <> '' UNION ALL SELECT *, '>' || r FROM sides WHERE r <> '' UNION ALL SELECT *, '=' || l || chr(9) || r FROM sides WHERE l <> '' OR r <> ''
),
edges AS (SELECT kind, pattern, value, max(seed) AS seed FROM beside GROUP BY kind, pattern, value),
start0 AS (SELECT *, seed AS score FROM edges),
rated1 AS ({_RATED.format('start0')}), scored1 AS ({_SCORED.format('rated1')}),
rated2 AS ({_RATED.format('scored1')}), scored2 AS ({_SCORED.format('rated2')}),
rated3 AS ({_RATED.format('scored2')}),
good AS (SELECT kind, pattern, confidence FROM rated3 WHERE confidence >= 0.8 AND support >= 3),
hits AS (SELECT b.doc_id, b.start, b.stop, b.kind, max(g.confidence) AS confidence FROM beside b JOIN good g ON g.kind = b.kind AND g.pattern = b.pattern WHERE b.seed = 0 GROUP BY b.doc_id, b.start, b.stop, b.kind),
added AS (SELECT doc_id, kind, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, stop ORDER BY confidence DESC, kind DESC) AS k FROM hits) WHERE k = 1),
every AS (SELECT doc_id, kind, start, stop, true AS own FROM base UNION ALL SELECT doc_id, kind, start, stop, false FROM added),
joined AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE own AND kind = '{k}') AS n_{k}" for k in _PERSONAL)}, {_spans(_PERSONAL, 'own')} AS base, {_spans(_PERSONAL)} AS spans FROM every GROUP BY doc_id
)
SELECT t.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PERSONAL)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN joined j ON j.doc_id = t.doc_id
"""

OP9 = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT count(*)::DOUBLE AS weights, sum(n)::DOUBLE AS docs FROM counts),
rates AS (SELECT source, docs * 1.0 / weights / n AS rate FROM counts, sums),
pmf AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k)
),
cdf AS (SELECT source, rate, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
uniforms AS (
  SELECT *, CAST(CAST('0x' || substr(md5('count-42|' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents
),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.rate, (SELECT count(*) FROM cdf WHERE cdf.source = d.source AND cdf.c <= d.u) AS n
  FROM uniforms d JOIN rates r ON r.source = d.source
)
SELECT doc_id, text, lang, source, n_chars, rate, CAST(copy AS INTEGER) AS copy, md5('order-42|' || doc_id || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(0, n)) AS copy FROM counted WHERE n > 0)
"""

OP5 = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages),
groups AS (SELECT *, CASE WHEN bytes >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS last FROM payloads)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM groups
"""

# Every 200-byte window as hex; fine at the size of a correctness check.
OP4 = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS w FROM bytes, LATERAL (SELECT unnest(range(0, n - 199)) AS p) WHERE n >= 200),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM windows WHERE w IN (SELECT w FROM twice)),
gaps AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
islands AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM gaps),
runs AS (SELECT doc_id, k, min(p) AS s, max(p) + 200 AS e FROM islands GROUP BY doc_id, k),
pieces AS (
  SELECT r.doc_id, r.s, substr(b.h, CAST(2 * coalesce(lag(r.e) OVER (PARTITION BY r.doc_id ORDER BY r.s), 0) + 1 AS BIGINT), CAST(2 * (r.s - coalesce(lag(r.e) OVER (PARTITION BY r.doc_id ORDER BY r.s), 0)) AS BIGINT)) AS before,
         substr(b.h, CAST(2 * r.e + 1 AS BIGINT)) AS after, r.e - r.s AS gone
  FROM runs r JOIN bytes b USING (doc_id)
),
cleaned AS (
  SELECT doc_id, string_agg(before, '' ORDER BY s) || arg_max(after, s) AS kept, sum(gone) AS n_removed, count(*) AS n_spans FROM pieces GROUP BY doc_id
)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(c.kept, b.h))) AS kept_sha256
FROM bytes b LEFT JOIN cleaned c USING (doc_id)
"""

OP12 = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
),
positives AS (SELECT * FROM scored WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
pairs AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM pairs QUALIFY rank <= 10
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# crc32 of a decimal number, bit by bit.
_CRC = """crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, s, k + 1, CASE WHEN c0 % 2 = 1 THEN xor(c0 >> 1, 3988292384) ELSE c0 >> 1 END
  FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(s[CAST(k // 8 + 1 AS BIGINT)]) AS BIGINT)) ELSE c END AS c0 FROM crc WHERE k < 8 * length(s))
)"""
OP13 = f"""
WITH RECURSIVE {_CRC},
marked AS (SELECT doc_id FROM crc WHERE k = 8 * length(s) AND xor(c, 4294967295) % 7 = 0),
leaves AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM marked) AND n_chars IS NOT NULL THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS used FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM leaves
),
low AS (
  SELECT g, 0 AS level, i AS j, n AS wide, leaf AS h FROM placed
  UNION ALL SELECT g, level + 1, j // 2, any_value((wide + 1) // 2), sha256(string_agg(h, '' ORDER BY j)) FROM low WHERE wide > 1 GROUP BY g, level, j // 2
),
subroots AS (SELECT g, h, level AS top FROM low WHERE wide = 1),
high AS (
  SELECT 0 AS level, g AS j, (SELECT count(*) FROM subroots) AS wide, h FROM subroots
  UNION ALL SELECT level + 1, j // 2, any_value((wide + 1) // 2), sha256(string_agg(h, '' ORDER BY j)) FROM high WHERE wide > 1 GROUP BY level, j // 2
),
root AS (SELECT h, level AS top FROM high WHERE wide = 1),
nodes AS (SELECT g, level, j, h FROM low WHERE wide > 1 UNION ALL SELECT s.g, s.top + y.level, y.j, y.h FROM high y, subroots s WHERE y.level > 0 OR y.j <> s.g),
walk AS (
  SELECT p.doc_id, p.leaf, p.used, p.g, 0 AS level, CASE WHEN s.top = 0 THEN p.g ELSE p.i END AS j, p.used AS f, '' AS met, s.top AS mid, s.top + r.top AS top FROM placed p JOIN subroots s ON s.g = p.g, root r
  UNION ALL
  SELECT w.doc_id, w.leaf, w.used, w.g, w.level + 1, CASE WHEN w.level + 1 = w.mid THEN w.g ELSE w.j // 2 END,
         CASE WHEN x.h IS NULL THEN sha256(w.f) WHEN x.j < w.j THEN sha256(x.h || w.f) ELSE sha256(w.f || x.h) END, w.met || coalesce(x.h, ''), w.mid, w.top
  FROM walk w LEFT JOIN nodes x ON x.g = w.g AND x.level = w.level AND x.j = CASE WHEN w.j % 2 = 0 THEN w.j + 1 ELSE w.j - 1 END WHERE w.level < w.top
)
SELECT w.doc_id, w.leaf, s.h AS subroot, r.h AS root, sha256(w.met) AS proof_sha256, w.f AS folded_root, w.f = r.h AS verified
FROM walk w JOIN subroots s ON s.g = w.g, root r WHERE w.level = w.top
"""

ORACLES: dict[str, str] = {"op1_pii": OP1, "op3_secrets": OP3, "op4_suffix_dedup": OP4, "op5_warc": OP5, "op9_mixing": OP9, "op12_hard_negatives": OP12, "op13_merkle": OP13}
