import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlspark.functions import text as X
from urlspark.operators.features import FAMILIES, url_features

TEXTS = ["/aab//abc/é😀é/x", "", "/", "abc", None, "//aa/ab" * 40, "😀😀/😀a", "a/b", "aabb/abab/"]


def entropy(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def variance(text):
    h = [entropy(p) for p in text.split("/") if p]
    return sum(x * x for x in h) / len(h) - (sum(h) / len(h)) ** 2 if len(h) > 1 else 0.0


@pytest.mark.parametrize("limit", [X.CHARS_AT_ONCE, 5])
def test_entropies_of_pieces(spark, monkeypatch, limit):
    monkeypatch.setattr(X, "CHARS_AT_ONCE", limit)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").coalesce(1)
    got = rows.select("i", X.piece_entropy_variance(F.col("t")).alias("v"), X.char_entropy(F.col("t")).alias("h")).collect()
    for r in got:
        text = TEXTS[r.i]
        assert (r.v, r.h) == ((None, None) if text is None else pytest.approx((variance(text), entropy(text)), abs=1e-9))


def test_all_entropies_of_urls_go_to_python_together(spark):
    """No sorting, joining and matching of characters row by row in the JVM, and one hand-over for the whole family."""
    urls = spark.createDataFrame([(1, "http://a.b.com/x/y?sid=1")], "row_id long, url string")
    plan = url_features(urls, families=["entropy"]).select(*FAMILIES["entropy"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "sort_array" not in plan
