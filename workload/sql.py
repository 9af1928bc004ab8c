"""SQL counterparts, written independently of the Spark plans: lists of positions and
characters instead of back-references, ranks over whole classes instead of hash cuts."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from urlspark import constants as K
from urlspark.functions.url import BRACKETED_HOST
from urlspark.operators.features import FAMILIES
from workload.data import GIVEN_C, GIVEN_COEFFICIENTS, GIVEN_INTERCEPT, GIVEN_TREES, GIVEN_URL_TREES, NUMERIC
from workload.templates import PHISHING_VARIANTS, TEMPLATES, WEAK_TERMS, pieces

LETTER, DIGIT, ALNUM = r"\p{L}", r"\p{Nd}²³¹", r"\p{L}\p{N}"


def s(text: str) -> str:
    """SQL literal."""
    plain = "'" + text.replace("'", "''") + "'"
    return plain.replace("\t", "' || chr(9) || '")


def slist(items) -> str:
    return "[" + ", ".join(s(i) for i in items) + "]"


def variants_cte() -> str:
    fields = {"url": "url", "rest": "rest", "host": "host", "tail": "substr(rest, length(host) + 1)",
              "id": "page_id::VARCHAR", "b": "(page_id % 256)::VARCHAR"}
    shapes = ",\n".join(
        "NULL::VARCHAR" if t is None
        else " || ".join(fields[p] if is_field else s(p) for p, is_field in pieces(t))
        for t in TEMPLATES
    )
    return f"""
pg AS (SELECT page_id, url, rest, split_part(rest, '/', 1) AS host
       FROM (SELECT page_id, url, substr(url, strpos(url, '://') + 3) AS rest FROM pages)),
shaped AS (SELECT page_id, [{shapes}] AS shapes FROM pg),
variants AS (
  SELECT page_id * 100 + i AS row_id, i AS variant, url,
         (coalesce(regexp_matches(url, {s(WEAK_TERMS)}), false) OR i IN ({", ".join(map(str, PHISHING_VARIANTS))}))::INT AS phishing
  FROM (SELECT page_id, unnest(range(0, {len(TEMPLATES)})) AS i, unnest(shapes) AS url FROM shaped)
)"""


def cc(x: str, char_class: str) -> str:
    return f"length(regexp_replace({x}, {s('[^' + char_class + ']')}, '', 'g'))"


def matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {s(pattern)}))"


def sub(x: str, piece: str) -> str:
    return f"((length({x}) - length(replace({x}, {s(piece)}, ''))) // {len(piece)})"


def gram_list(x: str, k: int) -> str:
    return f"list_transform(range(1, length({x}) - {k - 2}), lambda i: substr({x}, i, {k}))"


def entropy(x: str, k: int = 1) -> str:
    return f"CASE WHEN length({x}) < {k} THEN 0.0 ELSE coalesce(list_entropy({gram_list(x, k)}), 0.0) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def any_of(x: str, terms) -> str:
    return f"len(list_filter({slist(terms)}, lambda t: contains({x}, t))) > 0"


PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def parse_cte(source: str, keep: str) -> str:
    """parsed(keep, url, scheme, hostname, path, query, port, feature_error)."""
    schemes = ", ".join(s(x) for x in K.PARAM_SCHEMES)
    return f"""
cleaned AS (SELECT {keep}, url, translate(regexp_replace(url, '^[\\x00-\\x20]+', ''), chr(9) || chr(10) || chr(13), '') AS c FROM {source}),
located AS (SELECT *, lower(regexp_extract(c, {s(PARTS)}, 1)) AS sch, regexp_extract(c, {s(PARTS)}, 2) AS nl,
              regexp_extract(c, {s(PARTS)}, 3) AS pp, regexp_extract(c, {s(PARTS)}, 4) AS qq FROM cleaned),
hosted AS (SELECT *, split_part(nl, '@', -1) AS hi FROM located),
ported AS (SELECT *, CASE WHEN contains(hi, '[') THEN regexp_extract(hi, '\\[[^\\]]*\\][^:]*:(.*)', 1)
                     WHEN contains(hi, ':') THEN substr(hi, strpos(hi, ':') + 1) ELSE '' END AS po FROM hosted),
judged AS (SELECT *, CASE WHEN url IS NULL THEN 'null_url'
                     WHEN contains(nl, '[') <> contains(nl, ']') THEN 'unbalanced_bracket'
                     WHEN contains(nl, '[') AND NOT regexp_matches(split_part(substr(nl, strpos(nl, '[') + 1), ']', 1), {s(BRACKETED_HOST)})
                       THEN 'bad_bracketed_host'
                     WHEN regexp_matches(nl, {s('[' + K.HOST_BREAKING_CHARS + ']')}) THEN 'netloc_normalization'
                     WHEN po <> '' AND (NOT regexp_full_match(po, '[0-9]+') OR try_cast(po AS BIGINT) IS NULL OR try_cast(po AS BIGINT) > 65535)
                       THEN 'bad_port' END AS feature_error FROM ported),
parsed AS (SELECT {keep}, url, feature_error,
             CASE WHEN feature_error IS NULL THEN sch END AS scheme,
             CASE WHEN feature_error IS NULL THEN lower(nl) END AS hostname,
             CASE WHEN feature_error IS NULL THEN
               CASE WHEN sch IN ({schemes}) THEN
                 CASE WHEN contains(pp, '/') THEN left(pp, length(pp) - length(split_part(pp, '/', -1))) ELSE '' END
                 || split_part(split_part(pp, '/', -1), ';', 1) ELSE pp END END AS path,
             CASE WHEN feature_error IS NULL THEN qq END AS query,
             CASE WHEN feature_error IS NULL AND po <> '' THEN po::INT END AS port
           FROM judged)"""


def lookup_host(x: str) -> str:
    rest = f"regexp_replace({x}, '^(?:[a-zA-Z0-9+.\\-]+:)?//', '')"
    authority = f"split_part(regexp_extract({rest}, '^[^/?#]*'), '@', -1)"
    return (
        f"lower(translate(regexp_replace(CASE WHEN regexp_matches({authority}, '^\\[[^\\]]*\\]') "
        f"THEN regexp_extract({authority}, '^\\[[^\\]]*\\]') ELSE trim(split_part({authority}, ':', 1)) END, "
        f"'[.。．｡]+$', ''), '。．｡', '...'))"
    )


OCTET = "([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def suffix_cte(source: str, host: str, out: str) -> str:
    """source plus column ``out``; host is a column holding a lookup host."""
    plain = slist([*K.GENERIC_SUFFIXES, *K.COUNTRY_SUFFIXES, *K.SECOND_LEVEL_SUFFIXES])
    wild, exc = slist(K.WILDCARD_SUFFIXES), slist(K.EXCEPTION_SUFFIXES)
    return f"""
{out}_l AS (SELECT *, string_split({host}, '.') AS lab FROM {source}),
{out}_t AS (SELECT *, list_transform(range(1, len(lab) + 2), lambda i: array_to_string(lab[i:], '.')) AS tails FROM {out}_l),
{out}_h AS (SELECT *,
    list_filter(range(1, len(lab) + 1), lambda i: list_contains({exc}, tails[i])) AS ex_at,
    list_filter(range(1, len(lab) + 1), lambda i: list_contains({plain}, tails[i]) OR list_contains({wild}, tails[i + 1])) AS rule_at
  FROM {out}_t),
{out}_s AS (SELECT * EXCLUDE (lab, tails, ex_at, rule_at),
    CASE WHEN {host} IS NULL THEN NULL
         WHEN regexp_full_match({host}, '{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}') OR starts_with({host}, '[') THEN ''
         WHEN len(ex_at) > 0 THEN tails[ex_at[1] + 1]
         WHEN len(rule_at) > 0 THEN tails[rule_at[1]] ELSE '' END AS {out}
  FROM {out}_h)"""


def registrable_cte(source: str) -> str:
    """split_url(source columns, tld, domain, subdomain)."""
    return f"""
looked AS (SELECT *, {lookup_host('url')} AS lh FROM {source}),
{suffix_cte('looked', 'lh', 'tld')},
rested AS (SELECT *, CASE WHEN tld = '' THEN lh WHEN lh = tld THEN '' ELSE left(lh, length(lh) - length(tld) - 1) END AS rst,
             (regexp_full_match(lh, '{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}') OR starts_with(lh, '[')) AS whole FROM tld_s),
split_url AS (SELECT * EXCLUDE (lh, rst, whole), CASE WHEN whole THEN lh ELSE split_part(rst, '.', -1) END AS domain,
             CASE WHEN whole OR NOT contains(rst, '.') THEN '' ELSE left(rst, length(rst) - length(split_part(rst, '.', -1)) - 1) END AS subdomain
           FROM rested)"""


def pairs_cte(source: str) -> str:
    """with_q(source columns, cookie text, redirect target)."""
    def dec(x):
        return f"url_decode(replace({x}, '+', ' '))"

    val = "substr(p, strpos(p, '=') + 1)"
    key = "left(p, strpos(p, '=') - 1)"
    return f"""
qp AS (SELECT *, list_transform(list_filter(string_split(query, '&'), lambda p: strpos(p, '=') > 0 AND {val} <> ''),
         lambda p: {{'k': {dec(key)}, 'v': {dec(val)}}}) AS prs FROM {source}),
with_q AS (SELECT * EXCLUDE (prs),
    coalesce(array_to_string(list_transform(list_filter(prs, lambda p: list_contains({slist(K.SESSION_KEYS)}, lower(p.k))), lambda p: p.v), ''), '') AS cookie,
    list_filter(prs, lambda p, i: list_contains({slist(K.REDIRECT_KEYS)}, lower(p.k)) AND contains(p.v, '//')
       AND list_position(list_transform(prs, lambda o: o.k), p.k) = i)[1].v AS redirect_to
  FROM qp)"""


U, H, P, Q, D, SUB, T = "url", "hostname", "path", "query", "domain", "subdomain", "tld"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda t: t <> '')"


def labels(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, '.')) END"


def at_positions(x: str, width: int, cond: str) -> str:
    """Number of positions i where ``cond`` holds for w = the next ``width`` characters."""
    return (
        f"len(list_filter(list_transform(range(1, length({x}) - {width} + 2), lambda i: substr({x}, i, {width})), "
        f"lambda w: {cond}))"
    )


def windows(x: str) -> str:
    return f"list_transform(range(1, length({x}) - 4), lambda i: substr({x}, i, 5))"


def chars(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1))"


def window_entropies(x: str) -> str:
    inner = "list_entropy(list_transform(range(1, 6), lambda j: substr(w, j, 1)))"
    return f"list_transform({windows(x)}, lambda w: {inner})"


def window_distinct(x: str) -> str:
    inner = "len(list_distinct(list_transform(range(1, 6), lambda j: substr(w, j, 1))))"
    return f"list_transform({windows(x)}, lambda w: {inner})"


def feature_sql(family: str) -> list[str]:
    n = f"length({U})"
    n1 = f"greatest({n}, 1)"
    seg = f"list_transform({tokens(P)}, lambda t: list_entropy(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1))))"
    name = f"CASE WHEN {D} <> '' AND {T} <> '' THEN {D} || '.' || {T} ELSE {D} || {T} END"
    first, last = f"split_part({SUB}, '.', 1)", f"split_part({SUB}, '.', -1)"
    digits_d = cc(D, DIGIT)
    if family == "lexical":
        sizes = f"list_transform({tokens(U)}, lambda t: length(t))"
        return [
            n, *[f"length({x})" for x in (H, D, T, SUB, P, Q)],
            f"coalesce(list_max({sizes}), 0)", f"coalesce(list_min({sizes}), 0)", f"coalesce(list_avg({sizes}), 0)",
            cc(U, DIGIT), labels(SUB), labels(D), labels(T), f"length({H}) - {cc(H, ALNUM)}",
            sub(U, "/"), sub(U, "."), sub(H, "-"), f"CASE WHEN {Q} = '' THEN 0 ELSE len(string_split({Q}, '&')) END",
            sub(P, "/"), "coalesce(port, -1)", flag("port IS NOT NULL"), f"{sub(P, '../')} + {sub(P, '..' + chr(92))}",
        ]
    if family == "ratios":
        return [
            *[ratio(f"length({x})", n) for x in (D, SUB, H, P, Q)],
            ratio(f"length({P})", f"length({D})"), ratio(f"length({Q})", f"length({D})"),
            ratio(f"length({Q})", f"length({P})"), ratio(cc(U, r"\p{Lu}"), n),
            ratio(matches(SUB, r"\p{Nd}+"), f"{matches(SUB, '[a-z]+')} + {matches(SUB, chr(92) + 'p{Nd}+')}"),
        ]
    if family == "entropy":
        return [
            entropy(H), entropy(P), entropy(Q), entropy(U, 2), entropy(U, 3), entropy(H, 2), entropy(D),
            f"CASE WHEN len({tokens(P)}) < 2 THEN 0.0 ELSE list_var_pop({seg}) END",
            f"CASE WHEN {n} <= 5 THEN 0.0 ELSE list_max({window_entropies(U)}) - list_min({window_entropies(U)}) END",
            f"CASE WHEN contains({SUB}, '.') THEN ({entropy(first)}) - ({entropy(last)}) ELSE 0.0 END",
            entropy("cookie"),
        ]
    if family == "composition":
        hl = f"length({H})"
        return [
            cc(H, DIGIT), cc(H, LETTER), cc(U, r"!@#$%\^&*()"), f"{n} - {cc(U, chr(92) + 'x00-' + chr(92) + 'x7F')}",
            ratio(cc(H, LETTER), hl), ratio(cc(H, DIGIT), hl), ratio(f"{hl} - {cc(H, ALNUM)}", hl), cc(H, K.HOMOGLYPHS),
        ]
    if family == "transitions":
        def full(pattern):
            return f"regexp_full_match(w, {s(pattern)})"

        le, di = f"[{LETTER}]", f"[{DIGIT}]"
        return [
            at_positions(U, 3, full(le + di + le)), at_positions(U, 3, full(di + le + di)),
            f"{at_positions(U, 2, full(le + di))}::DOUBLE / {n1}", f"{at_positions(U, 2, full(di + le))}::DOUBLE / {n1}",
            at_positions(U, 2, "w[1] = w[2]"), at_positions(U, 2, full(di + di)), at_positions(U, 2, full(le + le)),
            f"coalesce(list_max(list_transform(regexp_extract_all({U}, {s('[^' + ALNUM + '_./' + chr(92) + '-]{2,}')}), lambda x: length(x))), 0)",
            f"CASE WHEN {n} <= 5 THEN 0.0 ELSE list_avg({window_distinct(U)}) END",
        ]
    if family == "heuristics":
        ranges = " ".join(f"WHEN {T} = {s(t)} THEN {flag(f'length({D}) NOT BETWEEN {a} AND {b}')}"
                          for t, (a, b) in K.DOMAIN_LENGTH_RANGE.items())
        return [
            flag(any_of(f"lower({U})", K.SUSPICIOUS_TERMS)),
            flag(f"list_contains({slist(K.SHORTENER_HOSTS)}, {H}) OR (length({H}) <= 5 AND NOT contains({H}, '.')) "
                 f"OR regexp_full_match({H}, '[a-z][0-9][a-z]{{1,2}}\\.[a-z]{{2,3}}') OR (regexp_full_match({H}, '[a-z]{{1,3}}\\.[a-z]{{2,3}}') "
                 f"AND NOT list_contains({slist(K.SHORT_HOST_EXEMPT)}, split_part({H}, '.', 1)))"),
            flag(f"{cc(SUB, DIGIT)} > 0"), flag(f"contains({P}, '//') OR contains(lower({P}), 'redirect')"),
            flag(f"length({D}) > 8 AND {digits_d} > 0"),
            f"CASE WHEN list_contains({slist(K.MAJOR_SITES)}, {name}) OR {any_of(name, K.TRUST_KEYWORDS)} THEN 0.0 "
            f"WHEN {any_of(name, K.SUSPICIOUS_HOSTS)} THEN 1.0 WHEN list_contains({slist(K.RARE_TLDS)}, '.' || {T}) THEN 0.9 ELSE 0.0 END",
            flag(any_of(H, K.SUSPICIOUS_HOSTS)),
            flag(f"length({D}) > 0 AND ({digits_d} > 3 OR {digits_d}::DOUBLE / length({D}) > 0.3)"),
            flag(f"regexp_matches({H}, '(0x[a-f0-9]{{8}})|(\\d+\\.\\d+\\.\\d+\\.\\d+)')"),
            f"CASE {ranges} ELSE {flag(f'length({D}) > 0')} END",
            flag(f"port IS NOT NULL AND port <> 0 AND port NOT IN ({', '.join(map(str, K.USUAL_PORTS))})"),
        ]
    if family == "protocol":
        octets = f"string_split({H}, '.')"
        return [
            flag(f"len({octets}) = 4 AND len(list_filter({octets}, lambda o: regexp_full_match(o, '[0-9]+') AND try_cast(o AS INT) <= 255)) = 4"),
            flag("scheme <> 'http'"), flag(f"starts_with({H}, 'www.')"), flag(f"{T} = 'com'"), flag(f"starts_with({D}, 'xn--')"),
        ]
    if family == "diversity":
        return [ratio(f"len(list_distinct({chars(x)}))", f"length({x})") for x in (U, H)]
    if family == "obfuscation":
        return [
            flag(f"contains({U}, '%') OR {n} > {cc(U, chr(92) + 'x00-' + chr(92) + 'x7F')}"),
            flag(f"regexp_matches({U}, '(?i)(base64|hex)[^a-zA-Z0-9]')"), flag(any_of(f"lower({Q})", K.REDIRECT_MARKERS)),
            f"{sub(U, '//')} - {flag(f'contains({U}, ' + s('://') + ')')}",
            at_positions(U, 2, f"w[1] = w[2] AND NOT regexp_matches(w[1], '[{ALNUM}]')"),
            ratio(f"len(list_filter(regexp_extract_all({U}, '%[0-9a-fA-F]{{2}}'), lambda x: NOT list_contains({slist(K.PLAIN_ESCAPES)}, upper(x))))", n),
            flag(f"{T} <> '' AND coalesce(rtld, '') <> '' AND rtld <> {T}"),
        ]
    raise KeyError(family)


def family_query(family: str) -> str:
    columns = ",\n  ".join(
        f"CASE WHEN feature_error IS NULL THEN round(({expr})::DOUBLE, 6) END AS {name}"
        for name, expr in zip(FAMILIES[family], feature_sql(family), strict=True)
    )
    ctes = [variants_cte(), parse_cte("variants", "row_id, variant, phishing"), registrable_cte("parsed")]
    source = "split_url"
    if family in ("entropy", "obfuscation"):
        ctes.append(pairs_cte("split_url"))
        source = "with_q"
    if family == "obfuscation":
        ctes.append(f"red AS (SELECT *, {lookup_host('redirect_to')} AS rh FROM with_q)")
        ctes.append(suffix_cte("red", "rh", "rtld"))
        source = "rtld_s"
    return f"WITH {', '.join(ctes)}\nSELECT row_id,\n  {columns}\nFROM {source}"


def parse_query() -> str:
    return (f"WITH {variants_cte()}, {parse_cte('variants', 'row_id')} SELECT row_id, scheme, hostname, path, query, port, "
            f"feature_error FROM parsed")


def suffix_query(more: str = "") -> str:
    return (f"WITH {variants_cte()}, {registrable_cte('variants')} SELECT row_id, subdomain, domain, tld{more} FROM split_url")


def naive_query() -> str:
    return f"""WITH {variants_cte()}, {parse_cte('variants', 'row_id')},
l AS (SELECT row_id, hostname, string_split(hostname, '.') AS lab FROM parsed WHERE feature_error IS NULL)
SELECT row_id, CASE WHEN len(lab) > 2 THEN array_to_string(lab[1:len(lab) - 2], '.') ELSE '' END AS naive_subdomain,
  CASE WHEN len(lab) >= 2 THEN lab[len(lab) - 1] ELSE hostname END AS naive_domain,
  CASE WHEN len(lab) >= 2 THEN lab[len(lab)] ELSE '' END AS naive_tld FROM l"""


def quarantine_query() -> str:
    return (f"WITH {variants_cte()}, {parse_cte('variants', 'row_id')} SELECT row_id, url, feature_error FROM parsed "
            f"WHERE feature_error IS NOT NULL")


# --- n-grams --------------------------------------------------------------------------------
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2,}"
TEXTS = "texts AS (SELECT d.doc_id AS row_id, d.text AS txt, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"
ALL_TEXTS = "texts AS (SELECT doc_id AS row_id, text AS txt, NULL::INT AS label FROM documents)"
PAGES = f"texts AS (SELECT page_id AS row_id, url AS txt, regexp_matches(url, {s(WEAK_TERMS)})::INT AS label FROM pages)"


def counts_cte(texts: str, sizes=K.NGRAM_SIZES) -> str:
    each = " UNION ALL ".join(
        f"SELECT row_id, label, unnest({gram_list('t', k)}) AS gram FROM norm" for k in sizes
    )
    return f"""{texts},
norm AS (SELECT row_id, label, lower(regexp_replace(txt, {s(SPACE)}, ' ', 'g')) AS t FROM texts),
pieces AS ({each}),
counts AS (SELECT row_id, label, gram, count(*)::INT AS tf FROM pieces GROUP BY ALL)"""


def counts_query(texts: str) -> str:
    return f"WITH {counts_cte(texts)} SELECT row_id, gram, tf FROM counts"


def vocab_cte(texts: str) -> str:
    return f"""{counts_cte(texts)},
nn AS (SELECT count(*) AS n FROM texts),
vocab AS (SELECT gram, count(*) AS df, sum(tf * tf)::DOUBLE / any_value(n) - (sum(tf)::DOUBLE / any_value(n)) ^ 2 AS variance
          FROM counts, nn GROUP BY gram HAVING count(*) >= {K.NGRAM_MIN_DF} AND count(*) <= {K.NGRAM_MAX_DF} * any_value(n)),
kept AS (SELECT * FROM vocab WHERE variance > {K.NGRAM_MIN_VARIANCE})"""


def vocab_query(texts: str) -> str:
    return f"WITH {vocab_cte(texts)} SELECT gram, df FROM vocab"


def variance_query(texts: str) -> str:
    return f"WITH {vocab_cte(texts)} SELECT gram, round(variance, 6) AS variance FROM kept"


def mi_cte(texts: str) -> str:
    return f"""{vocab_cte(texts)},
cls AS (SELECT label, count(*) AS total FROM texts GROUP BY label),
nonzero AS (SELECT gram, tf, label, count(*) AS c FROM counts SEMI JOIN kept USING (gram) GROUP BY ALL),
zero AS (SELECT k.gram, 0 AS tf, cls.label, any_value(cls.total) - coalesce(sum(z.c), 0) AS c
         FROM kept k, cls LEFT JOIN nonzero z ON z.gram = k.gram AND z.label = cls.label GROUP BY k.gram, cls.label),
cells AS (SELECT * FROM nonzero UNION ALL SELECT * FROM zero WHERE c > 0),
marg AS (SELECT *, sum(c) OVER (PARTITION BY gram, tf) AS rt, sum(c) OVER (PARTITION BY gram, label) AS ct,
           sum(c) OVER (PARTITION BY gram) AS n FROM cells),
mi AS (SELECT gram, greatest(sum(c / n * ln(c::DOUBLE * n / (rt * ct))), 0.0) AS mi FROM marg GROUP BY gram)"""


def mi_query(texts: str) -> str:
    return f"WITH {mi_cte(texts)} SELECT gram, round(mi, 6) AS mi FROM mi"


def top_query(texts: str, k: int) -> str:
    """Score from MI and document frequency (a given second score), best k."""
    return f"""WITH {mi_cte(texts)},
both_scores AS (SELECT gram, round(mi, 9) AS mi, df::DOUBLE AS weight FROM mi JOIN kept USING (gram)),
scored AS (SELECT gram, round(0.5 * mi / (SELECT CASE WHEN max(mi) = 0 THEN 1 ELSE max(mi) END FROM both_scores)
           + 0.5 * weight / (SELECT CASE WHEN max(weight) = 0 THEN 1 ELSE max(weight) END FROM both_scores), 6) AS score FROM both_scores)
SELECT gram, score FROM scored ORDER BY score DESC, gram LIMIT {k}"""


def vectors_query(texts: str) -> str:
    return f"""WITH {vocab_cte(texts)}, numbered AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS idx FROM kept)
SELECT row_id, idx::INT AS idx, tf::DOUBLE AS tf FROM counts JOIN numbered USING (gram)"""


def names_query(texts: str) -> str:
    return f"WITH {vocab_cte(texts)} SELECT (row_number() OVER (ORDER BY gram) - 1)::INT AS idx, gram FROM kept"


def text_entropy_query() -> str:
    return f"""SELECT doc_id, round({entropy('text')}, 6) AS h1, round({entropy('text', 2)}, 6) AS h2,
round({entropy('text', 3)}, 6) AS h3 FROM documents"""


# --- numeric rows -----------------------------------------------------------------------------
ROWS = """r AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS row_id, (l_returnflag = 'R')::INT AS label,
  l_extendedprice * (1 - l_discount) / 120000.0::DOUBLE AS score,
  (l_extendedprice * (1 - l_discount) / 120000.0::DOUBLE >= 0.5)::INT AS prediction,
  l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_linenumber::DOUBLE AS line,
  l_extendedprice * (1 - l_discount) AS net, 1.0::DOUBLE AS flat FROM lineitem)"""

SPLIT = f"""{ROWS},
cls AS (SELECT label, count(*) AS n FROM r GROUP BY label),
a AS (SELECT *, sum(n) OVER () AS n_all FROM cls),
b AS (SELECT *, n_all - ceil(round(n_all * 0.2, 6)) AS tr FROM a),
c AS (SELECT *, floor(n * tr / n_all) AS fl, n * tr / n_all - floor(n * tr / n_all) AS re FROM b),
d AS (SELECT *, fl + (row_number() OVER (ORDER BY re DESC, label) <= tr - sum(fl) OVER ())::INT AS n_train FROM c),
e AS (SELECT *, n - n_train AS held, sum(n - n_train) OVER () AS held_all FROM d),
f AS (SELECT *, held_all - ceil(round(held_all * 0.5, 6)) AS va FROM e),
g AS (SELECT *, floor(held * va / held_all) AS vfl, held * va / held_all - floor(held * va / held_all) AS vre FROM f),
q AS (SELECT label, n_train, vfl + (row_number() OVER (ORDER BY vre DESC, label) <= va - sum(vfl) OVER ())::INT AS n_val FROM g),
o AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id)) AS rn FROM r),
sp AS (SELECT row_id, label, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'val' ELSE 'test' END AS split
       FROM o JOIN q USING (label))"""

COLUMNS = ["quantity", "price", "discount", "tax", "line", "net", "flat"]


def scale_query() -> str:
    cols = ", ".join(
        f"round((r.{c} - (SELECT avg({c}) FROM tr)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM tr), 6) AS {c}"
        for c in COLUMNS
    )
    return f"""WITH {SPLIT}, tr AS (SELECT r.* FROM r JOIN sp USING (row_id) WHERE split = 'train')
SELECT row_id, {cols} FROM r JOIN sp USING (row_id) WHERE split = 'test'"""


def subsample_query(runs: int, fraction: float) -> str:
    each = " UNION ALL ".join(
        f"SELECT {k} AS run, row_id, row_number() OVER (ORDER BY md5('{42 + k}|' || row_id)) AS rn FROM r" for k in range(runs)
    )
    return f"""WITH {ROWS}, x AS ({each})
SELECT row_id, count(*) AS runs FROM x WHERE rn <= (SELECT floor({fraction} * count(*)) FROM r) GROUP BY row_id"""


def binned_mi_query(bins: int = 32) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, label, CASE WHEN hi = lo THEN 0 ELSE len(list_filter(list_transform(range(1, {bins}), "
        f"lambda b: lo + (hi - lo) * b / {bins}.0::DOUBLE), lambda e: v >= e)) END AS bin "
        f"FROM (SELECT label, {c} AS v, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM r)"
        for c in COLUMNS
    )
    return f"""WITH {ROWS}, x AS ({each}), n AS (SELECT feature, bin, label, count(*) AS c FROM x GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY feature, bin) AS rt, sum(c) OVER (PARTITION BY feature, label) AS ct,
        sum(c) OVER (PARTITION BY feature) AS t FROM n)
SELECT feature, round(greatest(sum(c / t * ln(c::DOUBLE * t / (rt * ct))), 0.0), 6) AS mi FROM m GROUP BY feature"""


def quantile_mi_query(bins: int = 32) -> str:
    """Edges are the values of rank ceil(b n / bins), found by numbering all rows."""
    each = " UNION ALL ".join(f"SELECT '{c}' AS feature, y AS label, {c}::DOUBLE AS v FROM lab" for c in COLUMNS)
    return f"""WITH {ROWS}, lab AS (SELECT *, ((net > 30000 AND quantity > 20) OR tax > 0.07)::INT AS y FROM r), a AS ({each}),
rn AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS k, count(*) OVER (PARTITION BY feature) AS n FROM a),
e AS (SELECT feature, list_distinct(list(v)) AS edges FROM rn JOIN (SELECT unnest(range(1, {bins})) AS b) s
  ON k = (b * n + {bins - 1}) // {bins} GROUP BY feature),
x AS (SELECT feature, label, len(list_filter(edges, lambda e: v >= e)) AS bin FROM a JOIN e USING (feature)),
n AS (SELECT feature, bin, label, count(*) AS c FROM x GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY feature, bin) AS rt, sum(c) OVER (PARTITION BY feature, label) AS ct,
        sum(c) OVER (PARTITION BY feature) AS t FROM n)
SELECT feature, round(greatest(sum(c / t * ln(c::DOUBLE * t / (rt * ct))), 0.0), 6) AS mi FROM m GROUP BY feature"""


def correlation_query() -> str:
    pairs = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:]]
    each = " UNION ALL ".join(
        f"SELECT '{a}' AS f1, '{b}' AS f2, round(CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN 0.0 ELSE corr({a}, {b}) END, 6) AS r FROM r"
        for a, b in pairs
    )
    return f"WITH {ROWS} {each}"


def focal_query() -> str:
    p = "1.0 / (1.0 + exp(-(score * 8.0 - 4.0)))"
    return f"""WITH {ROWS}, pr AS (SELECT row_id, label AS y, {p} AS p FROM r),
pt AS (SELECT *, least(greatest(y * p + (1 - y) * (1 - p), 1e-15), 1 - 1e-15) AS pt, y * {K.FOCAL_ALPHA}::DOUBLE + (1 - y) * (1 - {K.FOCAL_ALPHA}::DOUBLE) AS a FROM pr)
SELECT row_id, round(p, 6) AS prob,
  round(a * (2 * y - 1) * p * (1 - p) * pow(1 - pt, {K.FOCAL_GAMMA}::DOUBLE - 1) * ({K.FOCAL_GAMMA}::DOUBLE * ln(pt) - (1 - pt) / pt), 6) + 0.0 AS grad,
  round(p * (1 - p) * pow(1 - pt, {K.FOCAL_GAMMA}::DOUBLE - 1) * a, 6) AS hess FROM pt"""


METRICS = f"""WITH {ROWS}, c AS (SELECT count(*) AS n, count(*) FILTER (label = prediction) AS hit,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM r)
SELECT round(hit / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"""

AUC = f"""WITH {ROWS}, ranked AS (SELECT label, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS ties FROM r)
SELECT round((sum(lo + (ties - 1) / 2.0) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)), 6) AS auc FROM ranked"""

WEIGHTED = f"""WITH {ROWS}, k AS (SELECT unnest([0, 1]) AS c),
p AS (SELECT c, count(*) FILTER (label = c) AS actual, count(*) FILTER (prediction = c) AS guessed,
        count(*) FILTER (label = c AND prediction = c) AS hit FROM r, k GROUP BY c)
SELECT round(sum(hit) / sum(actual), 6) AS accuracy,
  round(sum(coalesce(2 * hit / nullif(actual + guessed, 0), 0) * actual) / sum(actual), 6) AS weighted_f1 FROM p"""

PREDICT = f"""WITH {ROWS}, p AS (SELECT row_id, 1.0 / (1.0 + exp(-(score * 8.0 - 4.0))) AS p FROM r)
SELECT row_id, round(1 - p, 6) AS prob_0, round(p, 6) AS prob_1, (p >= 0.5)::INT AS prediction FROM p"""


# --- importances on a tree-shaped table ----------------------------------------------------------
def importance_cte(names: list[str]) -> str:
    return f"""nm AS (SELECT unnest(range(0, {len(names)})) AS idx, unnest({slist(names)}) AS feature),
tr AS (SELECT CASE WHEN l_linenumber = 7 THEN -1 ELSE (l_partkey * 31 + l_suppkey * 17) % {len(names)} END AS idx FROM lineitem),
imp AS (SELECT feature, count(tr.idx) AS importance FROM nm LEFT JOIN tr USING (idx) GROUP BY feature)"""


def handcrafted_list() -> str:
    return slist(n for names in K.FEATURE_FAMILIES.values() for n in names)


def importance_query(names) -> str:
    return f"WITH {importance_cte(names)} SELECT feature, importance FROM imp"


def handcrafted_query(names) -> str:
    return (f"WITH {importance_cte(names)} SELECT feature, importance FROM imp WHERE list_contains({handcrafted_list()}, feature) "
            f"ORDER BY importance DESC, feature LIMIT {K.TOP_IMPORTANCE}")


def bands_query(names) -> str:
    return f"""WITH {importance_cte(names)}, b AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature)::INT AS rank
  FROM imp WHERE NOT list_contains({handcrafted_list()}, feature))
SELECT feature, importance, rank, ceil(rank / {K.IMPORTANCE_BAND})::INT AS band FROM b WHERE rank <= {K.TOP_IMPORTANCE}"""


# --- views on a contribution-shaped table ----------------------------------------------------------
CONTRIB = """c AS (SELECT l_orderkey AS row_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS feature, l_quantity AS value,
  round((l_discount - 0.05::DOUBLE) * l_quantity, 4) AS contribution, 's' || l_suppkey AS grp FROM lineitem)"""

SUMMARY = f"""WITH {CONTRIB}, a AS (SELECT grp AS feature, round(avg(abs(contribution)), 6) AS mean_abs FROM c GROUP BY grp)
SELECT feature, mean_abs FROM a ORDER BY mean_abs DESC, feature LIMIT {K.SUMMARY_TOP}"""

SCATTER = f"WITH {CONTRIB} SELECT row_id, round(value, 6) AS value, round(contribution, 6) + 0.0 AS contribution FROM c WHERE grp = 's1'"

DECISION = f"""WITH {CONTRIB} SELECT row_id, feature, round(contribution, 6) + 0.0 AS contribution,
  (row_number() OVER w)::INT AS step,
  round(0.5 + sum(contribution) OVER (w ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cumulative
FROM c WINDOW w AS (PARTITION BY row_id ORDER BY abs(contribution), feature)"""

WATERFALL = f"""WITH {CONTRIB}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS rn,
  count(*) OVER (PARTITION BY row_id) AS n FROM c),
b AS (SELECT row_id, rn AS bar, feature, value, contribution, 1 AS features FROM k WHERE n <= 4 OR rn < 4
  UNION ALL SELECT row_id, 4, 'other', NULL, sum(contribution), count(*) FROM k WHERE n > 4 AND rn >= 4 GROUP BY row_id)
SELECT b.row_id, 0.5::DOUBLE AS base, bar::INT AS bar, feature, round(value, 6) AS value, round(contribution, 6) + 0.0 AS contribution, features,
  (o_totalprice > 200000)::INT AS prediction, (o_orderstatus = 'F')::INT AS label
FROM b JOIN orders ON o_orderkey = b.row_id"""

ADDITIVITY = f"WITH {ROWS} SELECT row_id, 0.0::DOUBLE AS gap FROM r"

METRIC_TEXT = """SELECT unnest(['Test Set Metrics:', 'Accuracy: ' || printf('%.4f', accuracy), 'Precision: ' || printf('%.4f', precision),
  'Recall: ' || printf('%.4f', recall), 'F1 Score: ' || printf('%.4f', f1)]) AS line FROM ({inner})"""

SUBSET = f"WITH {ROWS} SELECT row_id, round(net, 6) AS net, round(quantity, 6) AS quantity, round(tax, 6) AS tax FROM r"


def merged_query() -> str:
    mi = binned_mi_query().replace(", 6) AS mi FROM m", ", 9) AS mi FROM m")
    freq = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c} / greatest({c}, 50.0::DOUBLE)), 9) AS frequency, round(stddev_pop({c}), 6) AS gain FROM r"
        for c in COLUMNS
    )
    return f"""WITH {ROWS}, mi AS ({mi}), fg AS ({freq}), sc AS (SELECT * FROM mi JOIN fg USING (feature)),
hy AS (SELECT *, {K.MI_WEIGHT}::DOUBLE * mi / (SELECT coalesce(nullif(max(mi), 0), 1) FROM sc)
   + (1 - {K.MI_WEIGHT}::DOUBLE) * gain / (SELECT coalesce(nullif(max(gain), 0), 1) FROM sc) AS hybrid FROM sc)
SELECT feature, round(frequency, 6) AS frequency, round(hybrid, 6) AS hybrid,
  round({K.FREQUENCY_WEIGHT}::DOUBLE * frequency + (1 - {K.FREQUENCY_WEIGHT}::DOUBLE) * hybrid, 6) AS merged
FROM hy WHERE frequency >= {K.FREQUENCY_THRESHOLD} OR (SELECT max(frequency) FROM hy) < {K.FREQUENCY_THRESHOLD}"""


def greedy_query() -> str:
    """The walk over the columns as a recursion with the kept positions as its state."""
    return f"""WITH RECURSIVE pr AS ({correlation_query()}),
cols AS (SELECT unnest({slist(COLUMNS)}) AS name, unnest(range(0, {len(COLUMNS)})) AS idx),
pairs AS (SELECT a.idx AS i, b.idx AS j, coalesce(p.r, q.r, 1.0) AS r FROM cols a CROSS JOIN cols b
  LEFT JOIN pr p ON p.f1 = a.name AND p.f2 = b.name LEFT JOIN pr q ON q.f1 = b.name AND q.f2 = a.name),
mat AS (SELECT list(rs ORDER BY i) AS m FROM (SELECT i, list(r ORDER BY j) AS rs FROM pairs GROUP BY i)),
walk AS (SELECT 0 AS i, []::INT[] AS kept UNION ALL
  SELECT i + 1, CASE WHEN coalesce(list_max(list_transform(kept, lambda k: m[i + 1][k + 1])), 0.0) < {K.CORRELATION_DEFAULT}
    THEN list_append(kept, i) ELSE kept END FROM walk, mat WHERE i < {len(COLUMNS)}),
fin AS (SELECT kept FROM walk WHERE i = {len(COLUMNS)})
SELECT (t.pos - 1)::INT AS position, name AS feature
FROM (SELECT unnest(kept) AS k, unnest(range(1, len(kept) + 1)) AS pos FROM fin) t JOIN cols ON cols.idx = t.k"""


def vector_query() -> str:
    """86 features and grams of the pages in long form: variant 0 of every page is the page's URL."""
    from urlspark.operators.features import FEATURES

    joined, seen = [], []
    for i, fam in enumerate(FAMILIES):
        joined.append(f"f{i} AS ({family_query(fam)})")
        seen.append(f"SELECT row_id, unnest({slist(FAMILIES[fam])}) AS name, unnest([{', '.join(FAMILIES[fam])}]) AS value FROM f{i}")
    slots = f"slots AS (SELECT unnest({slist(FEATURES)}) AS name, unnest(range(0, {len(FEATURES)})) AS slot)"
    return f"""WITH {", ".join(joined)}, {slots}, long AS ({" UNION ALL ".join(seen)}),
gr AS ({vectors_query(PAGES)})
SELECT row_id // 100 AS row_id, slot::INT AS slot, value FROM long JOIN slots USING (name) WHERE row_id % 100 = 0 AND value <> 0
UNION ALL SELECT row_id, idx + {len(FEATURES)} AS slot, tf AS value FROM gr"""


# --- trees ---------------------------------------------------------------------------------------
def _cuts(cells: str, side: str) -> str:
    """All allowed cuts of cells (side, feature, pos, threshold, g, h, n) with their gain, each side for itself."""
    def score(g, h):
        return f"pow(greatest(abs({g}) - {K.BOOST_L1}, 0), 2) / ({h} + {K.BOOST_L2})"

    return f"""SELECT *, {score('gl', 'hl')} + {score('(g - gl)', '(h - hl)')} - {score('g', 'h')} AS gain FROM (
  SELECT {side}, feature, pos, threshold, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
    sum(g) OVER p AS g, sum(h) OVER p AS h, sum(n) OVER p AS n FROM {cells}
    WINDOW w AS (PARTITION BY {side}, feature ORDER BY threshold), p AS (PARTITION BY {side}, feature))
  WHERE nl >= {K.BOOST_MIN_CHILD} AND n - nl >= {K.BOOST_MIN_CHILD}"""


def _cells(rows: str, side: str, columns: list[str]) -> str:
    """Sums per value of each column at a score of 0, where each class has one gradient and one curvature."""
    a, gamma = K.FOCAL_ALPHA, K.FOCAL_GAMMA
    h = {1: f"({a}::DOUBLE * 0.25 * pow(0.5, {gamma} - 1))", 0: f"((1 - {a}::DOUBLE) * 0.25 * pow(0.5, {gamma} - 1))"}
    factor = f"({gamma}::DOUBLE * ln(0.5) - 1)"
    cells = " UNION ALL ".join(
        f"SELECT {side} AS side, '{c}' AS feature, {i} AS pos, {c} AS threshold, y FROM {rows}" for i, c in enumerate(columns))
    return f"""SELECT side, feature, pos, threshold, sum(CASE WHEN y = 1 THEN {h[1]} * {factor} ELSE -{h[0]} * {factor} END) AS g,
  sum(CASE WHEN y = 1 THEN {h[1]} ELSE {h[0]} END) AS h, count(*) AS n FROM ({cells}) GROUP BY ALL"""


def _step(g: str, h: str) -> str:
    return f"round(-{K.BOOST_RATE} * sign({g}) * greatest(abs({g}) - {K.BOOST_L1}, 0) / ({h} + {K.BOOST_L2}), 6) + 0.0"


def _first_cut(columns: list[str]) -> str:
    return f"""{ROWS}, lab AS (SELECT *, ((net > 30000 AND quantity > 20) OR tax > 0.07)::INT AS y FROM r),
cell AS ({_cells('lab', "''", columns)}),
first AS (FROM ({_cuts('cell', 'side')}) ORDER BY gain DESC, pos, threshold LIMIT 1)"""


LEAVES = f"""round(threshold, 6) AS threshold, {_step('gl', 'hl')} AS left_value, {_step('(g - gl)', '(h - hl)')} AS right_value,
  nl::BIGINT AS left_rows, (n - nl)::BIGINT AS right_rows"""


def stump_query(columns: list[str]) -> str:
    return f"WITH {_first_cut(columns)} SELECT feature, {LEAVES} FROM first"


def second_query(columns: list[str]) -> str:
    """The better of the best cuts of the first cut's two sides; equal gains take the left side."""
    at = " ".join(f"WHEN '{c}' THEN {c}" for c in columns)
    return f"""WITH {_first_cut(columns)},
sides AS (SELECT lab.*, CASE WHEN CASE first.feature {at} END <= first.threshold THEN 'left' ELSE 'right' END AS s FROM lab, first),
cell2 AS ({_cells('sides', 's', columns)}),
best AS (FROM ({_cuts('cell2', 'side')}) QUALIFY row_number() OVER (PARTITION BY side ORDER BY gain DESC, pos, threshold) = 1)
SELECT side, feature, {LEAVES} FROM best WHERE gain > 0 ORDER BY gain DESC, side LIMIT 1"""


def l1_given_query() -> str:
    """Gradient of the mean log loss per column, and what it misses of the optimum's conditions."""
    w, b = dict(zip(NUMERIC, GIVEN_COEFFICIENTS)), GIVEN_INTERCEPT
    margin = " + ".join(f"{v}::DOUBLE * {c}" for c, v in w.items())
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {v}::DOUBLE AS w, avg(d * {x}) AS g, {lam} / (count(*) * {GIVEN_C}::DOUBLE) AS lam FROM p"
        for c, v, x, lam in [*((c, v, c, 1) for c, v in w.items()), ("intercept", b, "1", 0)])
    return f"""WITH {ROWS}, p AS (SELECT *, 1 / (1 + exp(-({margin} + {b}))) - label AS d FROM r), g AS ({cells})
SELECT feature, round(w, 4) + 0.0 AS coefficient, round(g, 4) + 0.0 AS gradient,
  round(CASE WHEN lam = 0 THEN abs(g) WHEN w != 0 THEN abs(g + sign(w) * lam) ELSE greatest(abs(g) - lam, 0) END, 4) + 0.0 AS residual
FROM g"""


def l1_fit_query() -> str:
    """At the optimum nothing is missing."""
    return f"SELECT unnest({[*NUMERIC, 'intercept']}) AS feature, 0.0::DOUBLE AS residual"


def tree_rows(node) -> float:
    return node[1] if len(node) == 2 else tree_rows(node[2]) + tree_rows(node[3])


def tree_value(node, known: set[str] | None = None) -> str:
    """Value of a given tree as SQL; columns that are not ``known`` are averaged by the rows on both sides (None: all known)."""
    if len(node) == 2:
        return f"({node[0]}::DOUBLE)"
    column, cut, left, right = node
    low, high = tree_value(left, known), tree_value(right, known)
    if known is None or column in known:
        return f"(CASE WHEN {column} <= {cut}::DOUBLE THEN {low} ELSE {high} END)"
    share = tree_rows(left) / tree_rows(node)
    return f"({share!r}::DOUBLE * {low} + {1 - share!r}::DOUBLE * {high})"


def tree_scores_query() -> str:
    raw = " + ".join(tree_value(t) for t in GIVEN_TREES)
    return f"""WITH {ROWS}, z AS (SELECT row_id, {raw} AS raw FROM r)
SELECT row_id, round(raw, 6) + 0.0 AS raw, round(1 / (1 + exp(-raw)), 6) AS prob_1, (raw >= 0)::INT AS prediction FROM z"""


def url_scores_query() -> str:
    raw = " + ".join(tree_value(t) for t in GIVEN_URL_TREES)
    return f"""WITH f AS ({family_query("lexical")}), z AS (SELECT row_id, url_length IS NULL AS rejected, {raw} AS raw FROM f)
SELECT row_id, rejected, CASE WHEN NOT rejected THEN round(1 / (1 + exp(-raw)), 6) END AS prob_1,
  CASE WHEN NOT rejected THEN (raw >= 0)::INT END AS prediction FROM z"""


def shapley_cte() -> str:
    """Shapley values by their definition: weighted over all sets of the other columns of a tree."""
    def columns(node) -> set[str]:
        return set() if len(node) == 2 else {node[0]} | columns(node[2]) | columns(node[3])

    used = sorted(set().union(*map(columns, GIVEN_TREES)))
    base = " + ".join(tree_value(t, set()) for t in GIVEN_TREES)
    parts = []
    for c in used:
        terms = []
        for tree in GIVEN_TREES:
            mine = sorted(columns(tree))
            others = [o for o in mine if o != c]
            if c not in mine:
                continue
            for k in range(len(others) + 1):
                weight = factorial(k) * factorial(len(others) - k) / factorial(len(mine))
                terms += [f"{weight!r}::DOUBLE * ({tree_value(tree, {*s, c})} - {tree_value(tree, set(s))})"
                          for s in combinations(others, k)]
        parts.append(f"SELECT row_id, '{c}' AS feature, {c} AS value, {' + '.join(terms)} AS contribution, {base} AS base FROM r")
    return f"{ROWS}, sh AS ({' UNION ALL '.join(parts)})"


def tree_contributions_query() -> str:
    return f"""WITH {shapley_cte()} SELECT row_id, feature, round(value, 6) AS value, round(contribution, 6) + 0.0 AS contribution,
  round(base, 6) AS base FROM sh"""


def tree_summary_query() -> str:
    return f"WITH {shapley_cte()} SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs FROM sh GROUP BY feature"


def all_queries(names: list[str], top: int = 500) -> dict[str, str]:
    return {
        "url_parse": parse_query(), "url_suffix": suffix_query(), "url_suffix_table": suffix_query(),
        "url_suffix_joined": suffix_query(", tld <> '' AS suffix_known"),
        "url_host_naive": naive_query(), "url_quarantine": quarantine_query(),
        **{f"url_{f}": family_query(f) for f in FAMILIES},
        "url_stream": family_query("lexical"), "url_feature_vectors": vector_query(),
        "url_feature_vectors_joined": vector_query(),
        "text_entropy": text_entropy_query(),
        "ngram_counts": counts_query(PAGES), "ngram_counts_docs": counts_query(ALL_TEXTS),
        "ngram_vocab": vocab_query(PAGES), "ngram_vocab_docs": vocab_query(ALL_TEXTS),
        "ngram_variance": variance_query(PAGES), "ngram_variance_docs": variance_query(ALL_TEXTS),
        "ngram_mi": mi_query(PAGES), "ngram_mi_docs": mi_query(TEXTS),
        "ngram_top": top_query(TEXTS, top), "ngram_vectors": vectors_query(PAGES), "ngram_names": names_query(PAGES),
        "split_stratified": f"WITH {SPLIT} SELECT row_id, label, split FROM sp",
        "split_distribution": f"WITH {SPLIT} SELECT split, label, count(*) AS n FROM sp GROUP BY ALL",
        "scale_standard": scale_query(), "scale_vectors": scale_query(), "column_subset": SUBSET,
        "subsample_runs": subsample_query(K.STABILITY_RUNS, K.STABILITY_FRACTION), "binned_mi": binned_mi_query(), "quantile_mi": quantile_mi_query(),
        "correlation_pairs": correlation_query(), "merged_rank": merged_query(),
        "greedy_prune": greedy_query(), "boost_stump": stump_query(["discount", "tax", "line"]),
        "l1_residual_given": l1_given_query(), "l1_residual_fit": l1_fit_query(),
        "boost_second_level": second_query(["discount", "tax", "line"]),
        "tree_scores": tree_scores_query(), "url_scores": url_scores_query(), "url_scores_stream": url_scores_query(), "tree_contributions": tree_contributions_query(),
        "tree_contribution_summary": tree_summary_query(), "focal_grad_hess": focal_query(), "predict_class": PREDICT,
        "binary_metrics": METRICS, "roc_auc": AUC, "weighted_f1": WEIGHTED,
        "metrics_text": METRIC_TEXT.format(inner=METRICS),
        "importance_splits": importance_query(names), "importance_handcrafted": handcrafted_query(names),
        "importance_ngram_bands": bands_query(names),
        "contributions_additivity": ADDITIVITY,
        "contribution_summary": SUMMARY, "contribution_scatter": SCATTER, "decision_path": DECISION, "waterfall": WATERFALL,
    }
