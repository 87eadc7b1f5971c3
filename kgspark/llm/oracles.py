"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN k.keeper IS NOT NULL AND d.page_id IS DISTINCT FROM k.keeper AND n >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper IS NOT NULL AND d.page_id IS DISTINCT FROM k.keeper AND n >= 1000 THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest"""

POISSON_MIX = r"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '\S+')) + 1)::BIGINT AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, (pow(size::DOUBLE, 0.5) / (SELECT sum(pow(size::DOUBLE, 0.5)) FROM sizes)) * (SELECT sum(size)::DOUBLE FROM sizes) / size AS rate FROM sizes),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cum FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM terms WHERE k < 59),
drawn AS (
  SELECT *, ('0x' || substr(md5('7|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents),
counts AS (
  SELECT d.doc_id, count(*) AS n, any_value(t.rate) AS rate FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.cum <= d.u GROUP BY d.doc_id),
copies AS (SELECT doc_id, rate, unnest(range(n)) AS copy FROM counts)
SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, c.copy::INTEGER AS copy, c.rate,
  md5('8|' || coalesce(d.doc_id::VARCHAR, '') || '|' || c.copy) AS shuffle_key
FROM documents d JOIN copies c ON d.doc_id = c.doc_id"""


def url_graph(rounds: int = 12, damping: float = 0.85, threshold: float = 0.5) -> str:
    """Rules, then both rank vectors round by round."""
    rules = [("allow", "com/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/")]
    rule = verdict = "NULL"
    for kind, text in rules:
        host, _, rest = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    rest = "CASE WHEN contains({0}, '://') THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    name = "translate(regexp_extract(coalesce(" + rest + ", ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(" + rest + ", ''), '^[^/?#]*([^?#]*)', 1)"
    link = r"""(?i)\s(?:href|src)\s*=\s*["'']?\s*((?:https?:)?//[^\s"''<>]+)"""
    parts = [
        f"parts AS (SELECT page_id, {name.format('url')} AS host, {path.format('url')} AS path, html FROM pages)",
        f"judged AS (SELECT page_id, host, path, html, {rule} AS rule, {verdict} AS verdict FROM parts)",
        "seeds AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') / count(*) AS trust, count(*) FILTER (WHERE verdict = 'block') / count(*) AS distrust FROM judged GROUP BY host)",
        f"links AS (SELECT host AS source, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM judged)",
        f"ends AS (SELECT source, {name.format('(CASE WHEN starts_with(link, $$//$$) THEN $$http:$$ || link ELSE link END)')} AS target FROM links)",
        "counted AS (SELECT source, target, count(*) AS n FROM ends WHERE source <> target AND source <> '' AND target <> '' GROUP BY source, target)",
        "edges AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS share, n / sum(n) OVER (PARTITION BY target) AS back FROM counted)",
    ]
    for kind, frm, to, w in (("trust", "source", "target", "share"), ("distrust", "target", "source", "back")):
        parts.append(f"{kind}0 AS (SELECT host, {kind} AS score FROM seeds WHERE {kind} > 0)")
        for n in range(1, rounds + 1):
            parts.append(
                f"{kind}{n} AS (SELECT host, sum(score) AS score FROM (SELECT host, score FROM {kind}0 UNION ALL SELECT e.{to}, s.score * e.{w} * {damping} "
                f"FROM {kind}{n - 1} s JOIN edges e ON e.{frm} = s.host) GROUP BY host)"
            )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > {threshold} "
        f"THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN trust{rounds} t ON j.host = t.host LEFT JOIN distrust{rounds} d ON j.host = d.host"
    )


TOP_K = """
WITH p AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM p q JOIN p c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

FINGERPRINT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER w AS following, first_value(coalesce(text, '')) OVER w AS head,
  lead(doc_id) OVER w AS after, first_value(doc_id) OVER w AS first_id FROM documents WINDOW w AS (ORDER BY doc_id)),
n AS (SELECT doc_id, t, coalesce(following, head) AS nx, length(t) AS c, coalesce(after, first_id) AS next_id FROM d),
texts AS (SELECT doc_id, 0 AS kind, t FROM n UNION ALL SELECT doc_id, 1, substr(t, 1, c - c // 2) || substr(nx, 1, c // 2) FROM n),
b AS (SELECT doc_id, kind, unnest(regexp_extract_all(hex(encode(t)), '..')) AS x, generate_subscripts(regexp_extract_all(hex(encode(t)), '..'), 1) AS i FROM texts),
v AS (SELECT doc_id, kind, ('0x' || x || lead(x, 1) OVER w || lead(x, 2) OVER w)::BIGINT * 2654435761 % 4294967296 AS h FROM b WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
counted AS (SELECT doc_id, kind, (xor(h, h // 32768) * 73244475 % 4294967296) // 16777216 AS bucket, count(*) AS n FROM v WHERE h IS NOT NULL GROUP BY ALL),
dense AS (SELECT t.doc_id, t.kind, r.bucket, coalesce(k.n, 0) AS n FROM texts t CROSS JOIN (SELECT unnest(range(256)) AS bucket) r
  LEFT JOIN counted k ON k.doc_id = t.doc_id AND k.kind = t.kind AND k.bucket = r.bucket),
q AS (SELECT doc_id, kind, list_sort(list(n)) AS s FROM dense GROUP BY ALL),
codes AS (SELECT e.doc_id, e.kind, e.bucket, (e.n > s[64])::INT + (e.n > s[128])::INT + (e.n > s[192])::INT AS code FROM dense e JOIN q USING (doc_id, kind)),
listed AS (SELECT doc_id, kind, list(code ORDER BY bucket) AS codes FROM codes GROUP BY ALL),
headed AS (SELECT t.doc_id, t.kind, strlen(t.t) AS size, length(bin(strlen(t.t))) AS bits, s[64] * 100 // greatest(s[192], 1) % 16 AS r1,
  s[128] * 100 // greatest(s[192], 1) % 16 AS r2 FROM texts t JOIN q USING (doc_id, kind)),
f AS (SELECT doc_id, kind, least(255, CASE WHEN size < 4 THEN size ELSE 4 * (bits - 2) + (size // pow(2, bits - 3)::BIGINT) % 4 END) AS len, r1, r2, codes,
  FROM headed JOIN listed USING (doc_id, kind)),
w AS (SELECT *, lpad(lower(hex(len)), 2, '0') || lower(hex(r1)) || lower(hex(r2))
  || array_to_string([lower(hex(codes[2 * i + 1] * 4 + codes[2 * i + 2])) FOR i IN range(128)], '') AS fingerprint FROM f),
pairs AS (SELECT n.doc_id, x.kind AS kind, a.fingerprint AS one, x.fingerprint AS two, abs(a.len - x.len) + least(abs(a.r1 - x.r1), 16 - abs(a.r1 - x.r1))
  + least(abs(a.r2 - x.r2), 16 - abs(a.r2 - x.r2))
  + list_sum([CASE WHEN abs(z[1] - z[2]) = 3 THEN 6 ELSE abs(z[1] - z[2]) END FOR z IN list_zip(a.codes, x.codes)]) AS apart
  FROM n JOIN w a ON a.doc_id = n.doc_id AND a.kind = 0 JOIN w x ON (x.doc_id = n.doc_id AND x.kind = 1) OR (x.doc_id = n.next_id AND x.kind = 0))
SELECT n.doc_id, n.c::BIGINT AS n_chars, sha256(substr(t, 1, c - c // 2) || substr(nx, 1, c // 2)) AS edited_sha256, e.one AS fingerprint, e.two AS edited_fingerprint,
  1.0::DOUBLE - least(e.apart, 416)::DOUBLE / 416 AS near_edited, 1.0::DOUBLE - least(x.apart, 416)::DOUBLE / 416 AS near_next
FROM n JOIN pairs e ON e.doc_id = n.doc_id AND e.kind = 1 JOIN pairs x ON x.doc_id = n.doc_id AND x.kind = 0"""

PHRASES = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
spans AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0),
grams AS (SELECT lang, words[i : i + k - 1] AS g, k FROM spans, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, g, k, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, g, k, a FROM f WHERE a >= 30 AND k >= 2),
cuts AS (SELECT c.lang, c.g, c.a, s, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS s FROM c) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : s] JOIN f y ON y.lang = c.lang AND y.g = c.g[s + 1 :]),
best AS (SELECT lang, g, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, s) = 1),
inside AS (SELECT lang, g[i : i + m - 1] AS g, max(a) AS longer FROM (SELECT c.lang, c.g, c.a, c.k, m, unnest(range(1, c.k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < c.k)
  GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank::INTEGER AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""
