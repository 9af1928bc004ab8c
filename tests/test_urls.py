import math
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark import session
from urlspark.functions import text as X
from urlspark.operators import suffix
from urlspark.operators.features import FEATURES, feature_table, url_features
from urlspark.operators.parse import parse_urls, quarantine
from urlspark.operators.suffix import SuffixRules, default_rules_table, read_suffix_list, split_registrable
from workload import data

EDGE = {
    "http://1.2.3.4/a": {"ip_as_hostname": 1, "hex_encoded_ip": 1, "domain_hierarchy": 4, "tld_domain_mismatch": 1,
                         "tld_length": 0},
    "http://1.2.3.4:80/": {"ip_as_hostname": 0, "port_number": 80, "port_mismatch": 0},
    "https://a-b.paypal.example.com:8443/x//y?url=http://evil.tk/z": {
        "non_http_scheme": 1, "port_mismatch": 1, "redirect_in_path": 1, "redirect_keywords": 1,
        "redirect_chain_count": 2, "redirect_tld_disparity": 1, "hyphen_in_hostname": 1},
    "h.com/path": {"hostname_length": 0, "url_shortener": 1, "non_http_scheme": 1, "path_length": 10},
    "": {"domain_to_url_ratio": 0, "query_to_path_ratio": 0, "url_shortener": 1, "non_http_scheme": 1,
         "tld_domain_mismatch": 0, "port_number": -1, "redirect_chain_count": 0},
    "abcde": {"rolling_entropy_range": 0, "pattern_density": 0},
    "http://x.com/%41%2f%20": {"encoding_bypass_ratio": 1 / 22, "obfuscation_chars": 1, "url_shortener": 1},
    "http://h.com/a;b?c=1": {"path_length": 2, "query_length": 3},
    "http://x.education/": {"tld_risk_score": 0},
    "http://foo.xyz/": {"tld_risk_score": 0.9, "tld_domain_mismatch": 1},
    "http://h.com/?sid=aab&SID=b&sid=": {"cookie_param_entropy": 1.0},
    "http://h.com:0/": {"port_number": 0, "has_port": 1, "port_mismatch": 0},
    "https://www.com/": {"non_http_scheme": 1, "www_prefix": 1},
}
REJECTED = {"http://h.com:ab/": "bad_port", "http://h.com:99999/": "bad_port", "http://[::1": "unbalanced_bracket",
            None: "null_url", "http://a℀b.com/": "netloc_normalization"}


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "row_id long, url string")


def test_edge_urls(spark):
    got = {r.url: r for r in url_features(frame(spark, EDGE)).collect()}
    for url, wanted in EDGE.items():
        for name, value in wanted.items():
            assert got[url][name] == pytest.approx(value), (url, name)


def test_rejected_urls_keep_their_row(spark):
    rows = url_features(frame(spark, REJECTED)).collect()
    assert {r.url: r.feature_error for r in rows} == REJECTED
    assert all(r[c] is None for r in rows for c in FEATURES)
    good, bad = quarantine(parse_urls(frame(spark, [*REJECTED, "http://a.com"])))
    assert good.count() == 1 and bad.count() == len(REJECTED)


def test_feature_dimension(spark):
    assert len(FEATURES) == len(set(FEATURES)) == 86
    assert feature_table(spark).count() == 86


def test_parse_agrees_with_the_standard_library(spark, sf):
    rows = parse_urls(data.url_variants(spark, sf)).collect()
    for r in rows:
        try:
            p = urllib.parse.urlparse(r.url if r.url is not None else 1 / 0)
            wanted = (p.scheme.lower(), p.netloc.lower(), p.path, p.query, p.port)
        except (ValueError, ZeroDivisionError):
            assert r.feature_error, r.url
            continue
        assert (r.scheme, r.hostname, r.path, r.query, r.port) == wanted, r.url


def test_bracketed_hosts_as_in_the_standard_library(spark):
    hosts = """:: ::1 1:: 1::2 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 1::3:4:5:6:7:8 1:2:3:4:5:6:7:8:9 1:::2 1::2::3 :1 1:
        1:2:3:4:5:6:7 12345::1 g::1 1.2.3.4 ::1.2.3.4 ::ffff:1.2.3.4 1:2:3:4:5:6:1.2.3.4 1:2:3:4:5:6:7:1.2.3.4 ::1.2.3.04 ::256.1.1.1
        ::1.2.3 1:2:3:4:5::1.2.3.4 1:2:3:4:5:6::1.2.3.4 fe80::1%eth0 fe80::1% fe80::1%a%b v1.x v1. v.x vg.x V1.x abc FE80::A""".split()
    urls = [f"http://{u}[{h}]{p}/x" for h in [*hosts, ""] for u in ("", "u@", "a") for p in ("", ":80")]
    for r in parse_urls(frame(spark, urls)).collect():
        try:
            urllib.parse.urlsplit(r.url)
        except ValueError:
            assert r.feature_error, r.url
        else:
            assert r.feature_error is None, r.url


def entropy(items):
    n = len(items)
    return -sum(c / n * math.log2(c / n) for c in Counter(items).values()) if n else 0.0


TEXTS = ["", "a", "aaaaaa", "abcabc", "http://www.a.com//x", "aabbccddee", "abab" * 5, "😀😀a😀b😀cc", "aaabbcdeaab", "é²½é²½xx",
         "aabbz", "xaaaay", "aaabbb", "abcdeabcde", "zzyzzyzzy"]


def test_entropies_and_windows_match_brute_force(spark):
    t = F.col("url")
    out = frame(spark, TEXTS).select(
        "url", X.char_entropy(t).alias("h1"), X.gram_entropy(t, 2).alias("h2"), X.gram_entropy(t, 3).alias("h3"),
        X.window_entropy_range(t).alias("span"), X.window_distinct_mean(t).alias("mean"),
    ).collect()
    for r in out:
        u = r.url
        windows = [u[i:i + 5] for i in range(len(u) - 5)]
        hs = [entropy(w) for w in windows]
        assert r.h1 == pytest.approx(entropy(u), abs=1e-9)
        for k, h in ((2, r.h2), (3, r.h3)):
            assert h == pytest.approx(entropy([u[i:i + k] for i in range(len(u) - k + 1)]), abs=1e-9)
        assert r.span == pytest.approx(max(hs) - min(hs) if hs else 0, abs=1e-9), u
        assert r["mean"] == pytest.approx(sum(len(set(w)) for w in windows) / len(windows) if windows else 0), u


def test_every_window_shape(spark):
    """All ways seven characters over a small alphabet can coincide."""
    import itertools

    texts = ["".join(c) for c in itertools.product("abc", repeat=7)] + ["abcdefg", "abcdeab", "aabcdef"]
    t = F.col("url")
    for r in frame(spark, texts).select("url", X.window_entropy_range(t).alias("s"), X.window_distinct_mean(t).alias("m")).collect():
        windows = [r.url[i:i + 5] for i in range(2)]
        hs = [entropy(w) for w in windows]
        assert r.s == pytest.approx(max(hs) - min(hs), abs=1e-9), r.url
        assert r.m == pytest.approx(sum(len(set(w)) for w in windows) / 2), r.url


def test_suffix_rules(spark):
    hosts = {
        "http://a.b.co.uk/": ("a", "b", "co.uk"), "http://co.uk/": ("", "", "co.uk"), "http://x.github.io": ("x", "github", "io"),
        "http://foo.ck": ("", "", "foo.ck"), "http://a.foo.ck": ("", "a", "foo.ck"), "http://www.ck": ("", "www", "ck"),
        "http://x.city.kawasaki.jp": ("x", "city", "kawasaki.jp"), "http://u@h.unknownsuffix:80": ("h", "unknownsuffix", ""),
        "1.2.3.4/x": ("", "1.2.3.4", ""), "http://[::1]:80/": ("", "[::1]", ""), "HTTP://WWW.A.COM./": ("www", "a", "com"),
    }
    df = frame(spark, hosts)
    table = suffix.default_rules_table(spark)
    for rules in (None, suffix.SuffixRules.from_table(table), suffix.SuffixRules.from_table(table, max_inline=3),
                  suffix.SuffixRules.from_table(table, max_inline=3, max_broadcast=3)):
        rows = suffix.split_registrable(df, rules=rules).collect()
        assert {r.url: (r.subdomain, r.domain, r.tld) for r in rows} == hosts


def test_rule_table_beyond_memory_joins_hosts_once(spark):
    rules = SuffixRules.from_table(default_rules_table(spark), max_inline=3, max_broadcast=3)
    assert not rules.broadcast
    urls = ["http://a.com"] * 50 + ["http://b.co.uk", None, None, "1.2.3.4", "http://x.unknownsuffix", "http://[::1]/", ""]
    df = frame(spark, urls).withColumn("tld", F.lit("of the input"))
    split = split_registrable(df, rules=rules, known="known")
    rows = split.collect()
    assert split.columns == [*df.columns, "known", "domain", "subdomain"]
    assert Counter((r.tld, r.known) for r in rows) == {("com", True): 50, ("co.uk", True): 1, (None, None): 2, ("", False): 4}
    assert split_registrable(df.limit(0), rules=rules).count() == 0
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    asked = [line for line in plan.splitlines() if "Join" in line and "suffix#" in line]
    assert len(asked) == 1 and "Cartesian" not in plan  # the rules meet the different hosts once


def test_frequent_keys_are_dealt_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(session, "FREQUENT", 2)
    keys = ["hot"] * 500 + [f"k{i % 50}" for i in range(300)] + [None] * 200
    left = spark.createDataFrame(list(enumerate(keys)), "id int, key string")
    right = left.groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.upper("key"))
    got = session.frequent_join(left, right, "key", "n")
    assert got.columns == ["key", "id", "value"]
    assert sorted((r.id, r.key, r.value) for r in got.collect()) == [(i, k, k and k.upper()) for i, k in enumerate(keys)]


def test_term_lists_have_the_expected_sizes():
    assert len(K.SUSPICIOUS_TERMS) == len(set(K.SUSPICIOUS_TERMS)) == 130
    assert len(K.RARE_TLDS) == len(set(K.RARE_TLDS)) == 35


def test_features_need_no_shuffle(spark):
    plan = url_features(spark.range(10).select(F.col("id").alias("row_id"), F.lit("http://a.com").alias("url")))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_suffix_list_file(spark, tmp_path):
    path = tmp_path / "list.dat"
    path.write_text("// c\n\ncom\ncom.ar  // note\r\n*.ck\n!www.ck\nрф\ncom\n// ===BEGIN PRIVATE DOMAINS===\nblogspot.com\n", "utf-8")
    plain = {("com", False, False), ("com.ar", False, False), ("ck", True, False), ("www.ck", False, True), ("рф", False, False),
             ("xn--p1ai", False, False)}
    rules = read_suffix_list(spark, str(path))
    assert sorted(map(tuple, rules.collect())) == sorted(plain)
    everything = read_suffix_list(spark, str(path), private=True)
    assert {tuple(r) for r in everything.collect()} == plain | {("blogspot.com", False, False)}
    urls = ["http://a.x.com.ar/", "http://b.blogspot.com", "http://www.ck", "http://a.b.ck", "http://й.рф", "http://q.xn--p1ai"]
    wanted = [("a", "x", "com.ar"), ("b", "blogspot", "com"), ("", "www", "ck"), ("", "a", "b.ck"), ("", "й", "рф"),
              ("", "q", "xn--p1ai")]
    for limit in (100, 0):
        inline = SuffixRules.from_table(rules, limit)
        again = SuffixRules.from_table(inline.as_table(spark), limit)
        for found in (inline, again):
            got = {r.url: (r.subdomain, r.domain, r.tld) for r in split_registrable(frame(spark, urls), rules=found).collect()}
            assert [got[u] for u in urls] == wanted


def test_big_suffix_table_does_not_shuffle_urls(spark, sf):
    rules = SuffixRules.from_table(default_rules_table(spark), max_inline=0)
    assert rules.broadcast
    plan = split_registrable(data.table(spark, sf, "pages").select("url"), rules=rules)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
