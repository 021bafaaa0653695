"""DuckDB statements for the queries that SQL can express, written from their definitions and not from the operators."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
windows AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, key) AS n
    FROM (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS key
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8))),
repeated AS (
    SELECT doc_id, count(DISTINCT q) AS n
    FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
    SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN repeated r ON r.doc_id = d.doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source),
sums AS (SELECT sum(f) / sum(n) AS m, sum(f::DOUBLE * f / n) / sum(n) AS second, count(*) / sum(n) AS noise FROM hosts),
prior AS (SELECT m, second - m * m - m * (1 - m) * noise AS between_hosts FROM sums),
verdicts AS (
    SELECT source, CASE WHEN between_hosts > 0
        THEN (f + m * greatest(m * (1 - m) / between_hosts - 1, 0)) / (n + greatest(m * (1 - m) / between_hosts - 1, 0))
        ELSE m END > 0.5 AS host_failed
    FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM judged JOIN verdicts ON verdicts.source IS NOT DISTINCT FROM judged.source
"""

SOURCE_MIX = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS tie FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
rounds AS (  -- each round fixes the sources that would pass their limit, and shares what is left among the others
    SELECT 0 AS round, []::BIGINT[] AS fixed
    UNION ALL
    SELECT round + 1, over_limit FROM (
        SELECT round, fixed, (
            SELECT list(rank ORDER BY rank) FROM w
            WHERE list_contains(fixed, rank) OR cap::DOUBLE <= weight *
                ((SELECT sum(source_size) FROM w) - (SELECT coalesce(sum(cap), 0) FROM w WHERE list_contains(fixed, rank)))::DOUBLE
                / (SELECT sum(weight) FROM w WHERE NOT list_contains(fixed, rank))) AS over_limit
        FROM rounds) WHERE len(over_limit) > len(fixed) AND round < 1000),
fixed AS (SELECT fixed FROM rounds ORDER BY round DESC LIMIT 1),
t AS (
    SELECT source, rank, source_size, CASE WHEN list_contains(fixed, rank) THEN cap::DOUBLE ELSE (weight *
        ((SELECT sum(source_size) FROM w) - (SELECT coalesce(sum(cap), 0) FROM w, fixed WHERE list_contains(fixed, rank))))::DOUBLE
        / (SELECT sum(weight) FROM w, fixed WHERE NOT list_contains(fixed, rank)) END AS target
    FROM w, fixed),
q AS (
    SELECT d.*, rank, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id, tie ROWS UNBOUNDED PRECEDING) AS run
    FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
passes AS (
    SELECT doc_id, tie, rank, h, size, (source_size * e + run)::DOUBLE / target AS time FROM q, (VALUES (0), (1), (2)) AS x(e) WHERE size > 0),
mixed AS (
    SELECT doc_id, tie, sum(size) AS taken
    FROM (SELECT *, sum(size) OVER (ORDER BY time, h, rank, doc_id, tie ROWS UNBOUNDED PRECEDING) - size AS start FROM passes)
    WHERE start < (SELECT sum(source_size) FROM w) GROUP BY doc_id, tie)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN mixed ON mixed.doc_id = q.doc_id AND mixed.tie = q.tie
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sh AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
rare AS (  -- a pair of that similarity shares one of the first fifth (and one more) of a set's shingles in any one order of all shingles
    SELECT doc_id, s, n FROM (
        SELECT sh.doc_id, s, n, row_number() OVER (PARTITION BY sh.doc_id ORDER BY f, s) AS r
        FROM sh JOIN sizes USING (doc_id) JOIN (SELECT s, count(*) AS f FROM sh GROUP BY s) USING (s)) WHERE r <= n - (n * 4 + 4) // 5 + 1),
pairs AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id < b.doc_id
    WHERE 80 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)),
links AS (
    SELECT a, b FROM (
        SELECT a, b, na, nb, count(*) AS c FROM pairs JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY ALL)
    WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT DISTINCT a AS doc_id, a AS r FROM both_ways
    UNION
    SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
low AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY key) AS n
    FROM (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS key
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35))),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM windows WHERE n > 1),
kept AS (
    SELECT d.doc_id, count(g.q) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (g.q IS NULL) AS words
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) d LEFT JOIN gone g USING (doc_id, q) GROUP BY d.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ARCHIVES = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first, count(*) AS n FROM p WHERE strlen(html) >= 100 GROUP BY digest),
host AS (
    SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h,
           regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS rest FROM p)
SELECT p.page_id, strlen(html)::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n > 1 AND first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND first <> p.page_id THEN first END AS refers_to,
       coalesce(array_to_string(list_reverse(string_split(h, '.')), ',') || ')' || rest, '') AS url_key,
       strftime(make_timestamp((1700000000 + p.page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM p LEFT JOIN f ON f.digest = p.digest JOIN host ON host.page_id = p.page_id
"""

NEAR_VECTORS = r"""
WITH RECURSIVE e AS (
    SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL)
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (
    SELECT DISTINCT a AS vec_id, a AS r FROM links
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
low AS (SELECT vec_id, min(r) AS r FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(r, e.vec_id) AS component_id, coalesce(r, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""

DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
kept AS (SELECT lang, t FROM (SELECT DISTINCT r, lang, t FROM words) GROUP BY lang, t HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(DISTINCT t) AS v FROM g LEFT JOIN kept USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, t, count(*) AS c FROM words JOIN kept USING (lang, t) GROUP BY ALL),
filled AS (SELECT lang, source, t, coalesce(c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, t)),
p AS (
    SELECT lang, source, t, c, 1 + (1000000000::HUGEINT * (c + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p
    FROM filled JOIN v USING (lang)),
q AS (
    SELECT lang, t, 1 + (1000000000::HUGEINT * (c + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
    FROM (SELECT lang, t, sum(c) AS c FROM filled GROUP BY lang, t) JOIN v USING (lang)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f
               FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL) s
        ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', t, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, t)
    FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM every WHERE part = 'pair' OR rank <= 50
"""
