"""Registrable-domain split (subdomain, domain, public suffix).

The suffix rules are a table argument ``(suffix, is_wildcard, is_exception)``; a default of
common suffixes is built in. Up to a checked number of rules they travel inside the plan as
hash sets, so the split is a plain projection: no join, no shuffle, usable on streams.
A larger table is broadcast up to a second limit. Beyond that it is neither grouped, kept nor copied as a whole: the tails
of the different hosts pick the rules that some host needs, and URLs get their host's suffix; streams are joined label by
label.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.functions.url import lookup_host
from urlspark.session import BROADCAST_ROWS, cut_lineage, fits_broadcast, frequent_join, salted_join

MAX_INLINE_RULES = 20_000
CLEARLY_MORE = 1.2  # twenty deviations of the estimated count
_OCTET = r"(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
RULE_SCHEMA = "suffix string, is_wildcard boolean, is_exception boolean"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}\z"


@dataclass
class SuffixRules:
    depth: int  # labels of the longest suffix a rule can give
    plain: list[str] | None = None
    wildcard: list[str] | None = None
    exception: list[str] | None = None
    table: DataFrame | None = None  # set only when there are too many rules to inline
    broadcast: bool = False  # whether that table was found small enough to be sent to every executor
    listed: DataFrame | None = None  # the rows behind a table that is not, a suffix as often as it was given

    @staticmethod
    def default() -> "SuffixRules":
        plain = [*K.GENERIC_SUFFIXES, *K.COUNTRY_SUFFIXES, *K.SECOND_LEVEL_SUFFIXES]
        return SuffixRules(_depth(plain, K.WILDCARD_SUFFIXES), plain, K.WILDCARD_SUFFIXES, K.EXCEPTION_SUFFIXES)

    @staticmethod
    def from_table(rules: DataFrame, max_inline: int = MAX_INLINE_RULES, max_broadcast: int = BROADCAST_ROWS) -> "SuffixRules":
        listed = rules.select(F.lower("suffix").alias("suffix"), "is_wildcard", "is_exception")
        flags = _flags(listed)
        labels = F.size(F.split("suffix", r"\.")) + F.coalesce(F.col("is_wildcard").cast("int"), F.lit(0))
        # One scan and no shuffle of rows; beyond CLEARLY_MORE times the limit no exact count is needed.
        about, depth = listed.agg(F.approx_count_distinct("suffix", 0.01), F.max(labels)).first()
        if about > CLEARLY_MORE * max(max_inline, max_broadcast):
            return SuffixRules(depth, table=flags, listed=listed)
        if fits_broadcast(flags, max_inline):
            rows = flags.collect()  # at most max_inline rows
            plain = [r.suffix for r in rows if r.is_plain]
            wildcard = [r.suffix for r in rows if r.is_wildcard]
            return SuffixRules(_depth(plain, wildcard), plain, wildcard,
                               [r.suffix for r in rows if r.is_exception])
        if not fits_broadcast(flags, max_broadcast):
            return SuffixRules(depth, table=flags, listed=listed)
        # Read once per rule set: the split asks it once per label of a host.
        return SuffixRules(depth, table=flags.persist(), broadcast=True)

    def as_table(self, spark: SparkSession) -> DataFrame:
        """The rules in the form that ``from_table`` takes."""
        if self.table is None:
            kinds = ((self.plain, False, False), (self.wildcard, True, False), (self.exception, False, True))
            return spark.createDataFrame([(s, *kind) for names, *kind in kinds for s in names or []], RULE_SCHEMA)
        return self.table.select("suffix", F.explode(F.array(*[
            F.when(F.col(flag), F.struct(F.lit(w).alias("is_wildcard"), F.lit(e).alias("is_exception")))
            for flag, w, e in (("is_plain", False, False), ("is_wildcard", True, False), ("is_exception", False, True))
        ])).alias("kind")).filter("kind IS NOT NULL").select("suffix", "kind.*")


def read_suffix_list(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """(suffix, is_wildcard, is_exception) from a file in the published list's format.

    One rule per line up to the first white space, '//' comments, '*.' for wildcards and '!' for exceptions. The private
    section, which ends the file, is left out unless asked for. Names with other than ASCII letters are given in both
    spellings. Repeated rules are listed once, an empty file has none.
    """
    whole = spark.read.text(path, wholetext=True)  # the order of lines matters for the section
    public = whole if private else whole.select(F.substring_index("value", "===BEGIN PRIVATE DOMAINS===", 1).alias("value"))
    lines = public.select(F.explode(F.split("value", r"\r\n|\r|\n")).alias("line"))
    rules = lines.select(F.regexp_extract("line", r"^\s*(\S*)", 1).alias("rule")).filter("rule <> '' AND NOT startswith(rule, '//')")

    @F.pandas_udf("string")
    def ascii_form(names: pd.Series) -> pd.Series:
        def one(label: str) -> str:
            return label if label.isascii() else "xn--" + label.encode("punycode").decode()

        return names.map(lambda name: ".".join(map(one, name.split("."))))

    named = rules.select(
        F.lower(F.regexp_replace("rule", r"^(?:!|\*\.)", "")).alias("suffix"),
        F.startswith("rule", F.lit("*.")).alias("is_wildcard"), F.startswith("rule", F.lit("!")).alias("is_exception"),
    )
    return named.unionByName(named.withColumn("suffix", ascii_form("suffix"))).distinct()


def default_rules_table(spark: SparkSession) -> DataFrame:
    return SuffixRules.default().as_table(spark)


def _flags(listed: DataFrame) -> DataFrame:
    """One row per suffix: which kinds of rules it has."""
    return listed.groupBy("suffix").agg(
        F.bool_or(~F.col("is_wildcard") & ~F.col("is_exception")).alias("is_plain"),
        F.bool_or("is_wildcard").alias("is_wildcard"),
        F.bool_or("is_exception").alias("is_exception"),
    )


def _depth(plain: list[str], wildcard: list[str]) -> int:
    return max([s.count(".") + 1 for s in plain] + [s.count(".") + 2 for s in wildcard])


def _choose(host: Column, tails: dict[int, Column], plain, wildcard, exception) -> Column:
    """Longest matching suffix; an exception rule gives the suffix one label shorter."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    out = F.when(host.rlike(IPV4) | host.startswith("["), F.lit(""))
    for k in sorted((k for k in tails if k), reverse=True):
        out = out.when((labels >= k) & exception(k), tails[k - 1])
        hit = plain(k) if k == 1 else plain(k) | wildcard(k - 1)
        out = out.when((labels >= k) & hit, tails[k])
    return out.when(host.isNotNull(), F.lit(""))


def _host_suffixes(hosts: DataFrame, host: str, rules: SuffixRules, out: str) -> DataFrame:
    """``hosts`` (unique) with the longest suffix that a rule gives, null without one: one join of their tails.

    Only rules of a suffix that is some host's tail are grouped and joined, so what is moved goes by the hosts. Where their
    tails can be sent to every executor the rules are read where they are.
    """
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    named = hosts.where(~(F.col(host).rlike(IPV4) | F.startswith(host, F.lit("[")))).select(host, labels.alias("_labels"))
    tails = named.select("*", F.explode(F.sequence(F.lit(1), F.least("_labels", F.lit(rules.depth + 1)))).alias("_k"))
    tails = tails.withColumn("suffix", F.expr(f"substring_index(`{host}`, '.', -_k)"))
    k = F.col("_k")

    def gives(flag: str, at: Column, exception: int, length: Column) -> Column:
        fits = F.col(flag) & (F.col("_labels") >= at)
        return F.when(fits, F.struct(at.alias("at"), F.lit(exception).alias("exception"), length.alias("length")))

    best = F.greatest(gives("is_plain", k, 0, k), gives("is_wildcard", k + 1, 0, k + 1), gives("is_exception", k, 1, k - 1))
    wanted = cut_lineage(tails.groupBy("suffix").agg(F.count("*").alias("_tails")))
    asked = rules.listed.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, "suffix", "left_semi")
    needed = cut_lineage(_flags(asked).join(wanted, "suffix"))
    if fits_broadcast(needed):
        hits = tails.join(F.broadcast(needed.drop("_tails")), "suffix")
    else:
        hits = frequent_join(tails, needed, "suffix", "_tails").where("is_plain IS NOT NULL")
    chosen = hits.groupBy(host).agg(F.max(best).alias("_best"))
    given = chosen.select(host, F.expr(f"substring_index(`{host}`, '.', -_best.length)").alias(out))
    return hosts.join(given, host, "left")


def with_suffix(df: DataFrame, host: str, out: str, rules: SuffixRules) -> DataFrame:
    """Add column ``out``: the public suffix of ``host`` ('' when unknown or an IP address)."""
    depth = rules.depth + 1  # an exception name is one label longer than its suffix
    tails = {0: F.lit("")} | {k: F.substring_index(F.col(host), ".", -k) for k in range(1, depth + 1)}
    if rules.table is None:
        def among(names: list[str]):
            return lambda k: tails[k].isin(names) if names else F.lit(False)

        return df.withColumn(
            out, _choose(F.col(host), tails, among(rules.plain), among(rules.wildcard), among(rules.exception))
        )
    if not rules.broadcast and not df.isStreaming:
        hosts = df.groupBy(F.col(host).alias(host)).agg(F.count("*").alias("_rows"))
        found = frequent_join(df, _host_suffixes(hosts, host, rules, "_suffix"), host, "_rows")
        found = found.withColumn(out, F.when(F.col(host).isNotNull(), F.coalesce("_suffix", F.lit(""))))
        return found.select(*dict.fromkeys([*df.columns, out]))
    joined, table = df, rules.table.persist()  # a stream asks it in every batch
    for k in range(1, depth + 1):
        flags = table.select(
            F.col("suffix").alias(f"_tail{k}"),
            *[F.col(c).alias(f"_{c}{k}") for c in ("is_plain", "is_wildcard", "is_exception")],
        )
        tailed = joined.withColumn(f"_tail{k}", tails[k])
        if rules.broadcast:
            joined = tailed.join(F.broadcast(flags), f"_tail{k}", "left")  # checked when the rules were read
        else:
            joined = salted_join(tailed, flags, [f"_tail{k}"])

    def flag(name: str):
        return lambda k: F.coalesce(F.col(f"_is_{name}{k}"), F.lit(False))

    chosen = _choose(F.col(host), tails, flag("plain"), flag("wildcard"), flag("exception"))
    return joined.withColumn(out, chosen).select(*df.columns, out)


def split_registrable(df: DataFrame, url: str = "url", rules: SuffixRules | None = None, known: str | None = None) -> DataFrame:
    """Add subdomain, domain and tld of the URL's host (lower-cased), and as ``known`` whether a rule gave the tld.

    ``known`` is false for IP addresses and unknown suffixes, null for null URLs.
    """
    rules = rules or SuffixRules.default()
    out = with_suffix(df.withColumn("_host", lookup_host(F.col(url))), "_host", "tld", rules)
    host, tld = F.col("_host"), F.col("tld")
    if known:
        out = out.withColumn(known, tld != "")
    whole = host.rlike(IPV4) | host.startswith("[")
    out = out.withColumn(
        "_rest",
        F.when(tld == "", host).when(host == tld, F.lit("")).otherwise(F.left(host, F.length(host) - F.length(tld) - 1)),
    )
    rest = F.col("_rest")
    out = out.withColumn("domain", F.when(whole, host).otherwise(F.substring_index(rest, ".", -1)))
    return out.withColumn(
        "subdomain",
        F.when(F.length(rest) > F.length("domain"), F.left(rest, F.length(rest) - F.length("domain") - 1))
        .when(rest.isNotNull(), F.lit("")),
    ).drop("_host", "_rest")
