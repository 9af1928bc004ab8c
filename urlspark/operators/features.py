"""The 86 URL features as one projection.

``url_features`` parses, splits the host and computes every requested feature; nothing
shuffles (with inlined suffix rules), so it runs unchanged on batches and streams, and
features that are not asked for never enter the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.functions import text as T
from urlspark.functions import url as U
from urlspark.operators.parse import parse_urls
from urlspark.operators.suffix import SuffixRules, split_registrable, with_suffix


def column_name(feature: str) -> str:
    """'URL 2-Gram Entropy' -> 'url_2_gram_entropy'."""
    return re.sub("[^0-9a-z]+", "_", feature.lower()).strip("_")


FAMILIES = {family: [column_name(n) for n in names] for family, names in K.FEATURE_FAMILIES.items()}
FEATURES = [column for columns in FAMILIES.values() for column in columns]
DISPLAY_NAMES = {column_name(n): n for names in K.FEATURE_FAMILIES.values() for n in names}


def feature_table(spark: SparkSession) -> DataFrame:
    """Dimension table (idx, column, name, family) of the hand-written features."""
    family_of = {c: f for f, columns in FAMILIES.items() for c in columns}
    rows = [(i, c, DISPLAY_NAMES[c], family_of[c]) for i, c in enumerate(FEATURES)]
    return spark.createDataFrame(rows, "idx int, column string, name string, family string")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _labels(name: Column) -> Column:
    return F.when(name == "", F.lit(0)).otherwise(T.count_sub(name, ".") + 1)


def _lexical(u, h, d, s, t, p, q, port) -> list[Column]:
    tokens = F.filter(F.split(u, "/"), lambda x: x != "")
    sizes = F.transform(tokens, F.length)
    # the non-empty tokens hold every character that is not a slash
    token_chars = F.length(u) - T.count_sub(u, "/")
    token_count = T.count_matches(u, r"[^/]+")
    return [
        F.length(u), F.length(h), F.length(d), F.length(t), F.length(s), F.length(p), F.length(q),
        F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)),
        T.ratio(token_chars, token_count),
        T.count_class(u, T.DIGIT), _labels(s), _labels(d), _labels(t),
        T.count_not_class(h, T.ALNUM), T.count_sub(u, "/"), T.count_sub(u, "."), T.count_sub(h, "-"),
        F.when(q == "", F.lit(0)).otherwise(T.count_sub(q, "&") + 1), T.count_sub(p, "/"),
        F.coalesce(port, F.lit(-1)), port.isNotNull().cast("int"),
        T.count_sub(p, "../") + T.count_sub(p, "..\\"),
    ]


def _ratios(u, h, d, s, p, q) -> list[Column]:
    n = F.length(u)
    return [
        *[T.ratio(F.length(x), n) for x in (d, s, h, p, q)],
        T.ratio(F.length(p), F.length(d)), T.ratio(F.length(q), F.length(d)), T.ratio(F.length(q), F.length(p)),
        T.ratio(T.count_class(u, T.UPPER), n),
        T.ratio(T.count_matches(s, r"\p{Nd}+"), T.count_matches(s, r"[a-z]+|\p{Nd}+")),
    ]


def _entropy(u, h, d, s, p, q, session_text) -> list[Column]:
    gradient = T.char_entropy(F.substring_index(s, ".", 1)) - T.char_entropy(F.substring_index(s, ".", -1))
    return [
        T.char_entropy(h), T.char_entropy(p), T.char_entropy(q),
        T.gram_entropy(u, 2), T.gram_entropy(u, 3), T.gram_entropy(h, 2), T.char_entropy(d),
        T.piece_entropy_variance(p), T.window_entropy_range(u),
        F.when(s.contains("."), gradient).otherwise(0.0),
        F.coalesce(T.char_entropy(session_text), F.lit(0.0)),
    ]


def _composition(u, h) -> list[Column]:
    n = F.length(h)
    digits, letters = T.count_class(h, T.DIGIT), T.count_class(h, T.LETTER)
    return [
        digits, letters, T.count_class(u, T.quote(K.PUNCTUATION)), T.count_not_class(u, r"\x00-\x7F"),
        T.ratio(letters, n), T.ratio(digits, n), T.ratio(T.count_not_class(h, T.ALNUM), n),
        T.count_class(h, K.HOMOGLYPHS),
    ]


def _transitions(u) -> list[Column]:
    n = F.greatest(F.length(u), F.lit(1))
    letter, digit = f"[{T.LETTER}]", f"[{T.DIGIT}]"
    return [
        T.count_matches(u, f"{letter}(?={digit}{letter})"), T.count_matches(u, f"{digit}(?={letter}{digit})"),
        T.count_matches(u, f"{letter}(?={digit})") / n, T.count_matches(u, f"{digit}(?={letter})") / n,
        T.count_matches(u, r"(.)(?=\1)"),
        # adjacent pairs of a class = its characters minus its runs
        T.count_class(u, T.DIGIT) - T.count_matches(u, f"{digit}+"),
        T.count_class(u, T.LETTER) - T.count_matches(u, f"{letter}+"),
        T.longest_match(u, rf"[^{T.ALNUM}_./-]{{2,}}"), T.window_distinct_mean(u),
    ]


def _tld_risk(d: Column, t: Column) -> Column:
    name = F.concat_ws(".", F.when(d != "", d), F.when(t != "", t))
    return (
        F.when(name.isin(K.MAJOR_SITES) | T.contains_any(name, K.TRUST_KEYWORDS), F.lit(0.0))
        .when(T.contains_any(name, K.SUSPICIOUS_HOSTS), F.lit(1.0))
        .when(F.concat(F.lit("."), t).isin(K.RARE_TLDS), F.lit(0.9))
        .otherwise(0.0)
    )


def _length_mismatch(d: Column, t: Column) -> Column:
    n = F.length(d)
    out = None
    for tld, (low, high) in K.DOMAIN_LENGTH_RANGE.items():
        value = _flag(~n.between(low, high))
        out = F.when(t == tld, value) if out is None else out.when(t == tld, value)
    return out.otherwise(_flag(n > 0))


def _heuristics(u, h, d, s, t, p, port) -> list[Column]:
    shortener = (
        h.isin(K.SHORTENER_HOSTS)
        | ((F.length(h) <= 5) & ~h.contains("."))
        | h.rlike(r"^[a-z][0-9][a-z]{1,2}\.[a-z]{2,3}$")
        | (h.rlike(r"^[a-z]{1,3}\.[a-z]{2,3}$") & ~F.substring_index(h, ".", 1).isin(K.SHORT_HOST_EXEMPT))
    )
    domain_digits = T.count_class(d, T.DIGIT)
    return [
        _flag(T.contains_any(F.lower(u), K.SUSPICIOUS_TERMS)), _flag(shortener),
        _flag(s.rlike(f"[{T.DIGIT}]")), _flag(p.contains("//") | F.lower(p).contains("redirect")),
        _flag((F.length(d) > 8) & (domain_digits > 0)), _tld_risk(d, t),
        _flag(T.contains_any(h, K.SUSPICIOUS_HOSTS)),
        _flag((T.ratio(domain_digits, F.length(d)) > 0.3) | (domain_digits > 3)),
        _flag(h.rlike(r"0x[a-f0-9]{8}|\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+")), _length_mismatch(d, t),
        _flag((port != 0) & ~port.isin(K.USUAL_PORTS)),
    ]


def _protocol(scheme, h, d, t) -> list[Column]:
    number = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return [
        _flag(h.rlike(rf"^{number}(?:\.{number}){{3}}\z")), _flag(scheme != "http"), _flag(h.startswith("www.")),
        _flag(t == "com"), _flag(d.startswith("xn--")),
    ]


def _diversity(u, h) -> list[Column]:
    return [T.ratio(T.distinct_chars(u), F.length(u)), T.ratio(T.distinct_chars(h), F.length(h))]


def _obfuscation(u, q, t, redirect_tld) -> list[Column]:
    slashes = T.count_sub(u, "//")
    escapes = T.count_matches(u, "%[0-9a-fA-F]{2}")
    plain = T.count_matches(u, "(?i)" + "|".join(K.PLAIN_ESCAPES))
    return [
        _flag(u.rlike(r"[^\x00-\x7F]|%")), _flag(u.rlike("(?i)(?:base64|hex)[^a-zA-Z0-9]")),
        _flag(T.contains_any(F.lower(q), K.REDIRECT_MARKERS)), slashes - u.contains("://").cast("int"),
        T.count_matches(u, rf"([^{T.ALNUM}])(?=\1)"), T.ratio(escapes - plain, F.length(u)),
        _flag((t != "") & (redirect_tld != "") & (redirect_tld != t)),
    ]


def url_features(df: DataFrame, url: str = "url", rules: SuffixRules | None = None,
                 families: list[str] | None = None) -> DataFrame:
    """All input columns plus ``feature_error`` and the DOUBLE features of ``families`` (default: all 86).

    A URL that cannot be decomposed keeps its row, with NULL features and a reason.
    """
    rules = rules or SuffixRules.default()
    wanted = families or list(FAMILIES)
    keep = df.columns
    out = split_registrable(parse_urls(df, url), url, rules)
    ok = F.col("feature_error").isNull()
    u, h, p, q = F.when(ok, F.col(url)), F.col("hostname"), F.col("path"), F.col("query")
    d, s, t, port = F.col("domain"), F.col("subdomain"), F.col("tld"), F.col("port")
    if {"entropy", "obfuscation"} & set(wanted):
        out = out.withColumn("_pairs", F.when(q.contains("="), U.query_pairs(q)))
        out = out.withColumns({
            "_session": U.session_values(F.col("_pairs")),
            "_redirect_host": U.lookup_host(U.redirect_target(F.col("_pairs"))),
        })
    if "obfuscation" in wanted:
        out = with_suffix(out, "_redirect_host", "_redirect_tld", rules)
    build = {
        "lexical": lambda: _lexical(u, h, d, s, t, p, q, port),
        "ratios": lambda: _ratios(u, h, d, s, p, q),
        "entropy": lambda: _entropy(u, h, d, s, p, q, F.col("_session")),
        "composition": lambda: _composition(u, h),
        "transitions": lambda: _transitions(u),
        "heuristics": lambda: _heuristics(u, h, d, s, t, p, port),
        "protocol": lambda: _protocol(F.col("scheme"), h, d, t),
        "diversity": lambda: _diversity(u, h),
        "obfuscation": lambda: _obfuscation(u, q, t, F.col("_redirect_tld")),
    }
    columns = [
        F.when(ok, value.cast("double")).alias(name)
        for family in FAMILIES if family in wanted
        for name, value in zip(FAMILIES[family], build[family](), strict=True)
    ]
    return out.select(*keep, "feature_error", *columns)
