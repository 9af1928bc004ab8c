"""SQL for the corpus queries that SQL can express, written for DuckDB."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("{text}", LOWERED)


def _in_repeats(n: int) -> str:
    """Words inside n-word windows that a text holds twice or more."""
    return f"""
        SELECT doc_id, count(DISTINCT k) AS n FROM (
            SELECT doc_id, unnest(range(i, i + {n})) AS k FROM (
                SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (
                    SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS win
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) > {n})
                )
            ) WHERE c > 1
        ) GROUP BY doc_id"""


OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
three AS ({_in_repeats(3)}), covered AS ({_in_repeats(12)}), long AS ({_in_repeats(101)}),
lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
),
base AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(three.n, 0) AS n_repeat_words,
        coalesce(covered.n, 0) AS covered_words, coalesce(long.n, 0) AS long_words
    FROM d LEFT JOIN three USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN long USING (doc_id)
    LEFT JOIN lines USING (doc_id)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 10 * covered_words <= 3 * n_words AND long_words = 0 AS kept, covered_words
FROM judged"""

OP5 = f"""
WITH d AS (SELECT doc_id, {PLAIN_WORDS.format(text="text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN_WORDS.format(text="text")} AS w FROM benchmark),
wins AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
        SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d JOIN (SELECT DISTINCT n FROM wins) s ON len(w) >= n)
),
hits AS (SELECT doc_id, n, i, item FROM dw JOIN wins USING (n, win)),
covered AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
),
named AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP10 = r"""
WITH p AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
hp AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM p
),
rows_ AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule,
        list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '[0-9]')
            THEN '*' || regexp_extract(s, '(\.[A-Za-z]+)$', 1) ELSE s END) AS segs
    FROM hp
),
labelled AS (
    SELECT *, array_to_string(segs, '/') AS shape,
        CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS v
    FROM rows_
),
levels AS (
    SELECT page_id, host, v, depth, segs[depth] AS seg, array_to_string(segs[1:depth - 1], '/') AS up
    FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS depth FROM labelled)
),
variable AS (
    SELECT host, depth, up FROM levels WHERE seg <> '' AND seg NOT LIKE '*%'
    GROUP BY ALL HAVING count(DISTINCT seg) >= 20 AND count(*) < 5 * count(DISTINCT seg)
),
general AS (
    SELECT page_id, list(CASE WHEN x.host IS NOT NULL AND seg <> '' AND seg NOT LIKE '*%'
        THEN '*' || regexp_extract(seg, '(\.[A-Za-z]+)$', 1) ELSE seg END ORDER BY l.depth) AS g
    FROM levels l LEFT JOIN variable x ON l.host = x.host AND l.depth = x.depth AND l.up = x.up GROUP BY page_id
),
tree AS (
    SELECT page_id, host, v, depth, g[depth] AS seg, array_to_string(g[1:depth - 1], '/') AS up
    FROM (SELECT *, unnest(range(1, len(g) + 1)) AS depth FROM general JOIN labelled USING (page_id))
),
nodes AS (
    SELECT host, depth, up, seg, (count(*) FILTER (v = 'block'))::DOUBLE AS b, count(v)::DOUBLE AS n FROM tree GROUP BY ALL
),
siblings AS (
    SELECT *, sum(b) OVER family - b AS c, sum(n) OVER family - n AS m FROM nodes WINDOW family AS (PARTITION BY host, depth, up)
),
tested AS (
    SELECT host, depth, up, seg, depth > 1 AND n > 0 AND m > 0
        AND ((b + 1) * (m + 2) - (c + 1) * (n + 2)) * ((b + 1) * (m + 2) - (c + 1) * (n + 2)) * (n + m + 4)
            > 3.84::DOUBLE * ((n + 2) * (m + 2) * (b + c + 2) * (n + m + 2 - b - c)) AS alone
    FROM siblings
),
marks AS (
    SELECT page_id, list(CASE WHEN alone THEN seg WHEN depth = 1 THEN '' ELSE '~' END ORDER BY depth) AS ms
    FROM tree JOIN tested USING (host, depth, up, seg) GROUP BY page_id
),
steps AS (
    SELECT page_id, host, v, depth, array_to_string(ms[1:depth], '/') AS template
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS depth FROM marks JOIN labelled USING (page_id))
),
counted AS (
    SELECT page_id, list({'s': 0.0::DOUBLE, 'b': b, 'l': l} ORDER BY depth) AS path FROM (
        SELECT page_id, depth, (count(*) FILTER (v = 'block') OVER template_)::DOUBLE AS b, (count(v) OVER template_)::DOUBLE AS l
        FROM steps WINDOW template_ AS (PARTITION BY host, depth, template))
    GROUP BY page_id
),
overall AS (
    SELECT CASE WHEN count(v) = 0 THEN 0.0::DOUBLE ELSE (count(*) FILTER (v = 'block') + 1) / (count(v) + 2) END AS o
    FROM labelled
),
priors AS (
    SELECT page_id, (count(*) FILTER (v = 'block') OVER (PARTITION BY shape) + 10.0::DOUBLE * o)
        / (count(v) OVER (PARTITION BY shape) + 10.0::DOUBLE) AS prior
    FROM labelled, overall
),
shares AS (
    SELECT page_id, list_reduce(list_prepend({'s': prior, 'b': 0.0::DOUBLE, 'l': 0.0::DOUBLE}, path),
        lambda a, x: {'s': (x.b + 10.0::DOUBLE * a.s) / (x.l + 10.0::DOUBLE), 'b': 0.0::DOUBLE, 'l': 0.0::DOUBLE}).s AS share
    FROM counted JOIN priors USING (page_id)
)
SELECT l.page_id, host, path, rule, coalesce(v, CASE WHEN share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM labelled l JOIN shares USING (page_id)"""

TERMS = r"regexp_extract_all({text}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')".replace("{text}", LOWERED.replace("{text}", "text"))

OP13 = f"""
WITH d AS (
    SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS} AS w FROM documents
),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
cells AS (
    SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, v,
        sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
        sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, k.term) AS whole,
        sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang) AS every
    FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN n USING (lang, source, term)
),
shares AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p,
        1 + (1000000000::HUGEINT * (whole + 5)) // (every + 5 * v) AS q
    FROM cells
),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b USING (lang, term) WHERE a.source != b.source GROUP BY ALL
),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS rank
    FROM (FROM pairs UNION ALL FROM terms)
) WHERE part = 'pair' OR rank <= 50"""

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
WORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = WORD + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, place: int, text: str, pattern: str, group: int, table: str) -> str:
    """Matches with their code points: lengths of the gaps and matches before, added up."""
    return f"""
        SELECT k, {place} AS place, '{kind}' AS kind, e - length(m) AS b, e, v FROM (
            SELECT k, m, v, sum(g + length(m)) OVER (PARTITION BY k ORDER BY i) AS e FROM (
                SELECT k, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
                FROM (SELECT k, regexp_extract_all({text}, '{pattern}') AS ms,
                        regexp_extract_all({text}, '{pattern}', {group}) AS vs,
                        list_transform(string_split_regex({text}, '{pattern}'), lambda s: length(s)) AS gs FROM {table})
            ))"""


def _codes(string: str) -> str:
    return f"list_transform(string_split({string}, ''), lambda c: instr('{ALPHABET}', c))"


def _blank(text: str, pattern: str) -> str:
    """The text with one blank for each character of a match."""
    gaps, found = f"string_split_regex({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}')"
    return f"array_to_string(list_transform(list_zip({gaps}, {found}), lambda z: z[1] || repeat(' ', coalesce(length(z[2]), 0))), '')"


OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
    SELECT * FROM ({_spans('assign', 0, 't', ASSIGN, 2, 'd')}) WHERE length(v) >= 6
    UNION ALL {_spans('access', 1, 't', 'AKIA[A-Z0-9]+', 0, 'd')} WHERE length(m) >= 20
    UNION ALL {_spans('hex', 2, 't', '[0-9a-f]+', 0, 'd')} WHERE length(m) >= 24
),
blanked AS (SELECT k, {_blank('t', ASSIGN)} AS t FROM d),
bare AS (
    SELECT {_blank(_blank('t', 'AKIA[A-Z0-9]{16,}'), '[0-9a-f]{24,}')} AS t FROM blanked
),
strings AS (
    SELECT DISTINCT v AS s, true AS random FROM base
    UNION ALL SELECT DISTINCT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_-]{4,}')), false FROM bare
),
pairs AS (
    SELECT random, unnest(c[1:len(c) - 1]) AS a, unnest(c[2:len(c)]) AS b FROM (SELECT random, {_codes('s')} AS c FROM strings)
),
counts AS (SELECT random, a, b, count(*) AS n FROM pairs GROUP BY ALL),
after AS (SELECT random, a, sum(n) AS n FROM counts GROUP BY ALL),
labels_ AS (SELECT count(DISTINCT random) = 2 AS ok FROM counts),
chances AS (
    SELECT random, a, b, (coalesce(c.n, 0) + 0.5::DOUBLE) / (coalesce(x.n, 0) + 0.5::DOUBLE * 67) AS p
    FROM (SELECT unnest([true, false]) AS random) CROSS JOIN (SELECT unnest(range(67)) AS a)
    CROSS JOIN (SELECT unnest(range(67)) AS b) LEFT JOIN counts c USING (random, a, b) LEFT JOIN after x USING (random, a)
),
ratios AS (
    SELECT a, b, round(1000 * ln(max(p) FILTER (random) / max(p) FILTER (NOT random))) AS r FROM chances GROUP BY ALL
),
runs AS (SELECT *, row_number() OVER () AS j FROM ({_spans('random', 3, 't', '[A-Za-z0-9+/_-]{16,}', 0, 'blanked')})),
scored AS (
    SELECT j, sum(r) AS r FROM (SELECT j, unnest(c[1:len(c) - 1]) AS a, unnest(c[2:len(c)]) AS b
        FROM (SELECT j, {_codes('v')} AS c FROM runs)) JOIN ratios USING (a, b) GROUP BY j
),
added AS (
    SELECT k, place, kind, b, e, v FROM runs JOIN scored USING (j)
    WHERE r >= 8000 AND (SELECT ok FROM labels_) AND NOT EXISTS (
        SELECT 1 FROM base x WHERE x.k = runs.k AND x.b < runs.e AND runs.b < x.e)
),
spans AS (
    SELECT k, place, b, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT) AS s FROM (FROM base UNION ALL FROM added)
),
listed AS (
    SELECT k, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
        count(*) FILTER (place = 2) AS n_hex, count(*) FILTER (place = 3) AS n_random,
        string_agg(s, ',' ORDER BY b, place) FILTER (place < 3) AS base, string_agg(s, ',' ORDER BY b, place) AS spans
    FROM spans GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN listed USING (k)"""

ORACLES = {"op12_secrets": OP12, "op13_source_divergence": OP13, "op4_repetition": OP4, "op5_decontamination": OP5, "op10_url_templates": OP10}
