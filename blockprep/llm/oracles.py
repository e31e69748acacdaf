"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), reach AS (
    SELECT a AS doc_id, a AS root FROM links
    UNION
    SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.root < links.b
), roots AS (
    SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(root, doc_id), doc_id) AS component_id,
    doc_id = coalesce(least(root, doc_id), doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""

OP3 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM pairs QUALIFY "rank" <= 10
"""

OP6 = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, w[i:i + n - 1] AS p, n
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0))
), places AS (
    SELECT doc_id, n, i, w[i:i + n - 1] AS p
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
    SELECT doc_id, item_id, i, places.n AS n FROM places JOIN windows USING (p)
), hit AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), ids AS (
    SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP9 = r"""
WITH texts AS (
    SELECT doc_id, string_split(text, chr(10)) AS x, text,
        list_transform(string_split(text, chr(10)), lambda t: trim(regexp_replace(t, '\r$', ''))) AS h
    FROM documents
), rows AS (
    SELECT doc_id, i, h, greatest(len(regexp_extract_all(h, '[^ \t\n\x0B\f\r]+')), 1) AS w
    FROM (SELECT doc_id, unnest(h) AS h, unnest(range(len(h))) AS i FROM texts)
), pairs AS (
    SELECT b.doc_id, b.i, b.w, a.doc_id AS s, b.i - a.i AS shift
    FROM rows a JOIN rows b ON a.h = b.h AND (a.doc_id, a.i) < (b.doc_id, b.i)
), numbered AS (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, s, shift ORDER BY i) AS run FROM pairs
), runs AS (
    SELECT doc_id, min(i) AS low, max(i) AS high FROM numbered GROUP BY doc_id, s, shift, run HAVING sum(w) >= 50
), gone AS (
    SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(low, high + 1)) AS k FROM runs) GROUP BY doc_id
)
SELECT doc_id,
    CASE WHEN gone IS NULL THEN text
         ELSE coalesce(array_to_string(list_transform(list_filter(range(len(x)), lambda k: NOT list_contains(gone, k)), lambda k: x[k + 1]), chr(10)), '') END AS text,
    CAST(coalesce(len(x), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM texts LEFT JOIN gone USING (doc_id)
"""

OP11 = r"""
WITH parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), split AS (
    SELECT page_id, after, regexp_extract(coalesce(after, ''), '^[^/?#]*') AS h FROM parts
), asked AS (
    SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(coalesce(after, ''), length(h) + 1), '^[^?#]*') AS path, substr(coalesce(after, ''), length(h) + 1) AS rest
    FROM split
), rules(h, p, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), patterns(pattern, regex, verdict) AS (
    VALUES ('||ads-track.', '^([^/?#]*\.)?ads-track\.', 'block'), ('||ads.', '^([^/?#]*\.)?ads\.', 'block'),
        ('||tracker.', '^([^/?#]*\.)?tracker\.', 'block'), ('/login^', '/login([^A-Za-z0-9_.%-]|$)', 'block'),
        ('/search?', '/search\?', 'block'), ('^sessionid=', '[^A-Za-z0-9_.%-]sessionid=', 'block'),
        ('||m.*/print/', '^([^/?#]*\.)?m\..*/print/', 'block'),
        ('||blog.*/de/*.html|', '^([^/?#]*\.)?blog\..*/de/.*\.html$', 'block'), ('.exe|', '\.exe$', 'block'),
        ('.zip|', '\.zip$', 'block'), ('/de/*#top|', '/de/.*#top$', 'allow')
), site AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM asked JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), other AS (
    SELECT page_id, arg_max(pattern, (length(pattern), verdict, pattern)) AS pattern,
        arg_max(verdict, (length(pattern), verdict, pattern)) AS verdict
    FROM asked JOIN patterns ON regexp_matches(host || rest, regex, 's') GROUP BY page_id
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern,
    coalesce(site.verdict, other.verdict, 'allow') AS verdict
FROM asked LEFT JOIN site USING (page_id) LEFT JOIN other USING (page_id)
"""

OP12 = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), hexed AS (
    SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM runs
), summed AS (
    SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
    FROM hexed, crc_table
), known AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gaps AS (
    SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS z FROM (SELECT *, unnest(range(length(word))) AS i FROM known)
), pairs AS (
    SELECT x.word, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM gaps x JOIN known y ON y.word = x.a || x.z
    UNION SELECT y.word, x.word, x.n FROM gaps x JOIN known y ON y.word = x.a || x.z
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
    SELECT known.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n,
        CASE WHEN near_n >= 2 * n THEN (SELECT min(near) FROM pairs p WHERE p.word = known.word AND p.near_n = best.near_n) END AS form
    FROM known LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root FROM known
    UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE form IS NOT NULL
), ends AS (
    SELECT walk.word, root FROM walk JOIN forms ON forms.word = root WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

OP13 = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY "rank" <= 10
"""

ORACLES: dict[str, str] = {
    "op2_minhash": OP2,
    "op3_topk": OP3,
    "op6_decontamination": OP6,
    "op9_line_dedup": OP9,
    "op11_url_filter": OP11,
    "op12_spelling": OP12,
    "op13_hard_negatives": OP13,
}
