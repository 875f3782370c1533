"""DuckDB statements for the corpus queries that SQL can express."""

ORACLE: dict[str, str] = {}

# Every window of ten item words, or a shorter item whole, against every place of every text.
ORACLE["op1_decontamination"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), span AS (
    SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0
), win AS (
    SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS words
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM span)
), place AS (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
    FROM doc CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
    SELECT doc_id, p, place.n AS n, item_id
    FROM place JOIN win ON win.n = place.n AND win.words = array_to_string(w[p:p + place.n - 1], ' ')
), covered AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# The Poisson distribution function in closed form, inverted by counting steps below the draw.
ORACLE["op6_poisson_mixing"] = r"""
WITH doc AS (
    SELECT doc_id, source, coalesce('=' || source, '') AS stratum,
           CAST('0x' || substr(md5('mixture:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
               / 4503599627370496.0 AS u
    FROM documents
), counts AS (
    SELECT stratum, count(*) AS n FROM doc GROUP BY stratum
), rates AS (
    SELECT stratum, pow(n, 0.7) / sum(pow(n, 0.7)) OVER () * sum(n) OVER () / n AS rate FROM counts
), steps AS (
    SELECT stratum, rate, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (
        PARTITION BY stratum ORDER BY k) AS step
    FROM (SELECT stratum, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 31) AS BIGINT))) AS k
          FROM rates)
), drawn AS (
    SELECT doc_id, source, rate,
           (SELECT count(*) FROM steps WHERE steps.stratum = doc.stratum AND step <= u) AS n_copies
    FROM doc JOIN rates USING (stratum)
), copies AS (
    SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM drawn
)
SELECT doc_id, source, round(rate, 6) AS rate, n_copies, copy,
       md5('mixture:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key
FROM copies
"""

# The same plan, joined to the whole documents.
ORACLE["op6_mixed_rows"] = f"""
SELECT doc_id, text, lang, documents.source AS source, n_chars, rate, n_copies, copy, shuffle_key
FROM ({ORACLE["op6_poisson_mixing"]}) AS plan JOIN documents USING (doc_id)
"""

# Every phrase of up to four words counted, every cut scored, inner phrases looked up directly.
ORACLE["op12_collocations"] = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS t
    FROM documents
), word AS (
    SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece
), total AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM word GROUP BY lang
), place AS (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM word CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size
), often AS (
    SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f, any_value(w[i:i + size - 1]) AS w
    FROM place GROUP BY 1, 2
), candidate AS (
    SELECT lang, phrase, w, len(w) AS size, f AS a FROM often WHERE f >= 30 AND len(w) > 1
), cut AS (
    SELECT lang, phrase, w, size, a, unnest(range(1, size)) AS k FROM candidate
), scored AS (
    SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, k,
           CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
    FROM cut AS c
    JOIN often AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN often AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:size], ' ')
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, size - m + 2)) AS i
          FROM (SELECT *, unnest(range(2, size)) AS m FROM candidate WHERE size > 2))
    GROUP BY 1, 2
), kept AS (
    SELECT weakest.* FROM weakest LEFT JOIN inside USING (lang, phrase)
    WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE["op13_url_rules"] = r"""
WITH parts AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM parts
), listed(verdict, h, p) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
           ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
    SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
    FROM split JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, verdict FROM split LEFT JOIN fits USING (page_id)
"""
