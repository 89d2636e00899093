"""Check SQL of the training-data queries that standard SQL can express, in DuckDB's dialect."""

_SPACE = "[\\x20\\x09-\\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_SPACE}'), lambda w: w <> '')"


#: op10: all pairs that share a shingle, and the closure of their links.
COMPONENTS = f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
    ), sets AS (
        SELECT doc_id, CASE
            WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
        FROM w
    ), each AS (
        SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
    ), links AS (
        SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reach(x, y) AS (
        SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
    )
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id
    FROM sets LEFT JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) ON doc_id = x
"""

#: op5 on pages whose main text stands in one article element without furniture inside.
ARTICLES = """
    WITH a AS (
        SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS t FROM pages
    ), b AS (
        SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a
    ), c AS (
        SELECT page_id, url, trim(regexp_replace(replace(replace(t, '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM b
    )
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""

_SEPARATORS = "['|', '||', '»', '›', '>', '>>', '•', '·', '/', '::']"
_SYMBOL_WORD = "[#*$%&<>|=~^]{2,}|[!?]{2,}$"
_BOILERPLATE = (
    "all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados"
    "|(?:accept|use of|uses|our) cookies|cookie(?:s)? (?:policy|settings)|wir verwenden cookies|utilise(?:r)? des cookies|usamos cookies"
    "|(?:enable|requires?|turn on) javascript|privacy policy|terms (?:of (?:use|service)|and conditions)|datenschutzerklärung|mentions légales|aviso legal"
    "|(?:log|sign) ?(?:in|up) (?:to|for|now|here)|subscribe (?:to|now|here)|click here|read more\\b|share (?:this|on)|skip to (?:main )?content"
    "|lorem ipsum|404 not found|page not found"
)


def _hits(test: str) -> str:
    return f"len(list_filter(w, lambda v: {test}))"


#: op1: base counts and line rules with their default limits.
LINES = f"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, {_words('text')} AS words FROM documents
    ), g AS (
        SELECT doc_id, i, array_to_string(words[i:i + 4], chr(10)) AS gram
        FROM t, unnest(range(1, len(words) - 3)) r(i)
    ), twice AS (
        SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
    ), again AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) o(k) GROUP BY doc_id
    ), l AS (
        SELECT doc_id, line, {_words('line')} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
    ), judged AS (
        SELECT doc_id, line, len(w) AS n, len(w) > 0 AND (
            {_hits(f"regexp_matches(v, '{_SYMBOL_WORD}')")} > 0.3 * len(w)
            OR len(w) >= 3 AND {_hits(f"list_contains({_SEPARATORS}, v)")} >= 2 AND {_hits(f"list_contains({_SEPARATORS}, v)")} >= 0.15 * len(w)
            OR len(w) IN (2, 3) AND list_contains({_SEPARATORS}, w[2])
            OR len(w) >= 4 AND {_hits('v = upper(v) AND v <> lower(v)')} > 0.7 * len(w)
            OR len(w) >= 12 AND list_max(map_values(list_histogram(w))) > 0.4 * len(w)
            OR len(w) >= 40 AND NOT regexp_matches(line, '[.!?…:;。！？]')
            OR len(w) >= 6 AND len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0.35 * len(w)
            OR len(w) <= 40 AND regexp_matches(lower(line), '{_BOILERPLATE}')) AS bad
        FROM l
    ), lines AS (
        SELECT doc_id, count(*) FILTER (WHERE bad) AS lines_removed, coalesce(sum(n) FILTER (WHERE bad), 0) AS words_removed,
            count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines
        FROM judged GROUP BY doc_id
    ), out AS (
        SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
            CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
            CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(lines_removed AS BIGINT) AS lines_removed, CAST(words_removed AS BIGINT) AS words_removed
        FROM t JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)
    )
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_removed <= 0.5 * n_words AS kept
    FROM out
"""

#: op12: shares of every kept term in every group, and all pairs of groups of a language.
DIVERGENCE = """
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
    ), t AS (
        SELECT id, lang, source, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM d
    ), kept AS (
        SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
    ), sizes AS (
        SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
    ), g AS (
        SELECT DISTINCT lang, source FROM d
    ), c AS (
        SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
    ), own AS (
        SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
    ), p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
            CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(own.total, 0) + s.v) AS BIGINT) AS p,
            CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v) AS BIGINT) AS q
        FROM g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
            LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
    ), sums AS (
        SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY a.lang, a.source, b.source
    ), every AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
    )
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM every
    QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""

#: op13: every anchor against all rows.
NEGATIVES = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), pairs AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
            CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        WHERE a.vec_id % 100 = 0
    ), positive AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN pairs USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
