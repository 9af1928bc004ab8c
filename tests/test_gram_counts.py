import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlspark.operators import ngrams

TEXTS = ["Ab  ab\n\n x", "aaaa", "", "z", None, "😀😀😀é", "tab\there   end", "aa", "ÀÉ\u0001x" * 40]
LABELS = [0, 1, 1, 0, 1, None, 0, 1, 1]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(zip(range(9), TEXTS, LABELS)), "row_id long, url string, label int").repartition(2)


def grams(text, k):
    return Counter(text[i:i + k] for i in range(len(text) - k + 1))


@pytest.fixture(params=[(1, 1), (ngrams.CHARS_AT_ONCE, ngrams.OUT_BYTES)])
def bounds(request, monkeypatch):
    """Everything at once, or a text and a gram at a time."""
    monkeypatch.setattr(ngrams, "CHARS_AT_ONCE", request.param[0])
    monkeypatch.setattr(ngrams, "OUT_BYTES", request.param[1])


def test_counts(rows, bounds):
    got = [(r.row_id, r.url, r.gram, r.tf) for r in ngrams.ngram_counts(rows, keep=("row_id", "url")).collect()]
    lower = [re.sub(r"\s\s+", " ", (t or "").lower()) for t in TEXTS]
    want = [(i, TEXTS[i], g, n) for i, t in enumerate(lower) for k in (2, 3) for g, n in grams(t, k).items()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_cells_are_the_contingency_of_the_counts(rows, bounds):
    want = ngrams.contingency(ngrams.ngram_counts(rows, keep=("row_id", "label")), "label", [0, 1])
    assert sorted(ngrams.gram_cells(rows, label="label", classes=[0, 1]).collect()) == sorted(want.collect())
    want = ngrams.contingency(ngrams.ngram_counts(rows))
    assert sorted(ngrams.gram_cells(rows).collect()) == sorted(want.collect())


def test_few_rows_are_shuffled(spark):
    """A gram's rows of equal count leave a slice of texts as one."""
    same = spark.range(0, 5_000, 1, 1).select(F.lit("abcabc").alias("url"))
    cells = ngrams.gram_cells(same)
    assert {(r.gram, r.tf, r.n) for r in cells.collect()} == {
        (g, t, 5_000) for g, t in {"ab": 2, "bc": 2, "ca": 1, "abc": 2, "bca": 1, "cab": 1}.items()}


def test_entropies(rows, bounds):
    def entropy(text, k):
        counts = grams(text, k)
        n = sum(counts.values())
        return -sum(c / n * math.log2(c / n) for c in counts.values())

    got = {r.row_id: r for r in ngrams.text_entropies(rows, "url").collect()}
    for i, text in enumerate(TEXTS):
        want = [None] * 3 if text is None else [entropy(text, k) for k in (1, 2, 3)]
        assert [got[i][f"h{k}"] for k in (1, 2, 3)] == pytest.approx(want, abs=1e-9)
