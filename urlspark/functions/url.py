"""URL decomposition and query-parameter expressions (generic RFC 3986 split).

The built-in ``parse_url`` is not used: it raises on URLs Java cannot parse and drops
user info and port from the host.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlspark import constants as K

_SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def _ipv6_pattern() -> str:
    """Eight groups, or fewer around one '::'; the last two may be an IPv4 address; an optional scope follows '%'."""
    group, octet = "[0-9a-fA-F]{1,4}", "(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    v4 = rf"{octet}(?:\.{octet}){{3}}"
    forms = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{v4}"]
    for before in range(8):
        head = f"{group}(?::{group}){{{before - 1}}}" if before else ""
        after = 7 - before
        tails = ["" if after == 0 else f"(?:{group}(?::{group}){{0,{after - 1}}})?"]
        if after >= 2:
            tails.append(f"(?:{group}:){{0,{after - 2}}}{v4}")
        forms += [f"{head}::{tail}" for tail in tails]
    return f"(?:{'|'.join(forms)})(?:%[^%]+)?"


# what may stand between brackets: an IPv6 address or 'v', a version, a dot and more
BRACKETED_HOST = rf"^(?:{_ipv6_pattern()}|v[0-9a-fA-F]+\..+)$"


def clean(url: Column) -> Column:
    """Drop leading control characters and spaces, and tabs and line breaks anywhere."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def part(cleaned: Column, group: int) -> Column:
    """Group 1 scheme, 2 network location, 3 path with parameters, 4 query."""
    return F.regexp_extract(cleaned, _SPLIT, group)


def path_without_params(path: Column, scheme: Column) -> Column:
    return F.when(scheme.isin(K.PARAM_SCHEMES), F.regexp_replace(path, r"(?s);[^/]*\z", "")).otherwise(path)


def port_text(netloc: Column) -> Column:
    """Text after the host's colon: after the closing bracket when the host is bracketed."""
    after_user = F.regexp_extract(netloc, r"(?s)([^@]*)\z", 1)
    bracketed = F.regexp_extract(after_user, r"(?s)^[^\[]*\[[^\]]*\][^:]*:(.*)\z", 1)
    plain = F.regexp_extract(after_user, r"(?s)^[^:]*:(.*)\z", 1)
    return F.when(after_user.contains("["), bracketed).otherwise(plain)


def port_number(port: Column) -> Column:
    """INT port, NULL when absent or invalid."""
    number = F.regexp_extract(port, r"^0*([0-9]{1,5})\z", 1).try_cast("int")
    return F.when(number <= 65535, number)


def url_error(url: Column, netloc: Column, port: Column) -> Column:
    """Reason why a URL cannot be decomposed; NULL when it can."""
    return (
        F.when(url.isNull(), F.lit("null_url"))
        .when(netloc.contains("[") != netloc.contains("]"), F.lit("unbalanced_bracket"))
        .when(netloc.contains("[") & ~F.regexp_extract(netloc, r"(?s)^[^\[]*\[([^\]]*)", 1).rlike(BRACKETED_HOST),
              F.lit("bad_bracketed_host"))
        .when(netloc.rlike(f"[{K.HOST_BREAKING_CHARS}]"), F.lit("netloc_normalization"))
        .when((port != "") & port_number(port).isNull(), F.lit("bad_port"))
    )


def lookup_host(url: Column) -> Column:
    """Lower-cased host for the registrable-domain split.

    Works on scheme-less URLs too (text up to the first slash), without user info, port
    and trailing dots; a bracketed IPv6 host keeps its brackets.
    """
    rest = F.regexp_replace(url, r"^(?:[a-zA-Z0-9+.\-]+:)?//", "")
    authority = F.regexp_extract(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), r"(?s)([^@]*)\z", 1)
    host = F.when(authority.rlike(r"^\[[^\]]*\]"), F.regexp_extract(authority, r"^\[[^\]]*\]", 0)).otherwise(
        F.regexp_replace(F.regexp_extract(authority, r"(?s)^[^:]*", 0), r"(?U)^\s+|\s+\z", "")
    )
    return F.lower(F.translate(F.regexp_replace(host, r"[.。．｡]+\z", ""), "。．｡", "..."))


def decode_component(text: Column) -> Column:
    """Form decoding: plus is a space, valid %XX is decoded, a stray % stays as it is."""
    safe = F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25")
    return F.try_url_decode(safe)


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> of decoded parameters in order; pairs with a blank value are dropped."""
    pieces = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)=."))
    return F.transform(
        pieces,
        lambda p: F.struct(
            decode_component(F.regexp_extract(p, "(?s)^[^=]*", 0)).alias("k"),
            decode_component(F.regexp_extract(p, "(?s)^[^=]*=(.*)", 1)).alias("v"),
        ),
    )


def session_values(pairs: Column) -> Column:
    """All values of session-like keys, joined."""
    hits = F.filter(pairs, lambda p: F.lower(p["k"]).isin(K.SESSION_KEYS))
    return F.array_join(F.transform(hits, lambda p: p["v"]), "")


def redirect_target(pairs: Column) -> Column:
    """First redirect-like parameter whose first value looks like a URL, else NULL."""
    # "first value" of a key: no earlier pair has the same key
    hits = F.filter(
        pairs,
        lambda p, i: F.lower(p["k"]).isin(K.REDIRECT_KEYS)
        & p["v"].contains("//")
        & (F.array_position(F.transform(pairs, lambda o: o["k"]), p["k"]) == i + 1),
    )
    return F.try_element_at(hits, F.lit(1))["v"]
