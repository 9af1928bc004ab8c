"""Suffix tables beyond memory: only what some host needs is grouped, kept or copied."""

from pyspark.sql import functions as F

from urlspark.operators import suffix
from urlspark.operators.suffix import SuffixRules, default_rules_table, split_registrable


def many_rules(spark, n=4_000):
    own = spark.range(n).select(F.concat(F.lit("q"), F.col("id") % (n // 2), F.lit(".test")).alias("suffix"),
                                F.lit(False).alias("is_wildcard"), F.lit(False).alias("is_exception"))
    return default_rules_table(spark).unionByName(own)


def rows(split):
    return sorted((r.url, r.subdomain, r.domain, r.tld) for r in split.collect())


def test_big_table_is_neither_kept_nor_copied(spark, monkeypatch):
    def copied(*_):
        raise AssertionError("all rules are copied per salt")

    monkeypatch.setattr(suffix, "salted_join", copied)
    rules = SuffixRules.from_table(many_rules(spark), max_inline=10, max_broadcast=100)
    assert not rules.broadcast and not rules.table.is_cached and rules.depth == 3
    urls = ["http://a.b.co.uk/", "http://x.city.kawasaki.jp", "http://a.b.q7.test", "http://www.ck", "http://a.b.ck", "1.2.3.4"]
    df = spark.createDataFrame([(u,) for u in urls * 3], "url string")
    got = rows(split_registrable(df, rules=rules))
    assert ("http://a.b.q7.test", "a", "b", "q7.test") in got and len(got) == 18
    assert got == rows(split_registrable(df, rules=SuffixRules.from_table(many_rules(spark), max_inline=10_000)))
    monkeypatch.setattr(suffix, "fits_broadcast", lambda *_: False)  # as with tails beyond memory
    assert rows(split_registrable(df, rules=rules)) == got
