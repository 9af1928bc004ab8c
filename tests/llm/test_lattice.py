import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.cases import odd_docs, odd_texts, sentence
from urlspark.llm import lattice as L
from urlspark.llm.bpe import vocabulary
from urlspark.llm.common import held_out

MODEL = vocabulary(P.path("piece_bpe_32k.model"))


def pieces():
    size = L.Pieces(MODEL).size
    scores = -np.abs(np.random.default_rng(0).normal(8, 2, size))
    return L.Pieces(MODEL, scores)


def all_ways(p, text):
    """Probability by listing every cut of the text."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        bounds = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        logs = []
        for a, b in zip(bounds, bounds[1:]):
            part = text[a:b]
            if part in p.number:
                logs.append(p.score[part])
            elif len(part) == 1:
                logs.append(sum(p.scores[p.bytes[x]] for x in part.encode()))
            else:
                logs.append(-math.inf)
        total += math.exp(sum(logs))
    return total


@pytest.mark.parametrize("word", ["a", "thing", "erening", "é漢x", "😀", "..!!"])
def test_all_segmentations(word):
    p = pieces()
    assert p.log_probability(word) == pytest.approx(math.log(all_ways(p, L.START + word)), abs=1e-9)
    counts = np.zeros(p.size)
    p.add_expected(word, counts)
    spelled = sum(len(x) * counts[i] for x, i in p.number.items())
    outside = sum(c not in p.number for c in word)  # spelled in bytes
    assert spelled == pytest.approx(len(word) + 1 - outside)


def test_very_long_word():
    assert math.isfinite(pieces().log_probability("ab" * 5000))


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_WORDS", 200)
    rng = random.Random(1)
    docs = odd_docs(spark, odd_texts() + [sentence(rng, 80) for _ in range(20)])
    got = L.score_documents(docs, MODEL, held_out("doc_id", 7, 2)).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t))
    away = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(r["doc_id"], split(r["text"])) for r in docs.collect()]
    c = Counter(w for i, ws in rows if not away(i) for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), away(i), len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), 6)) for i, ws in rows)
    assert sorted((str(r[0]), *r[1:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    # the probability of all words and the end, whole words and pieces, is at most one
    ends = [r["score"] for r in got if r["n_tokens"] == 1]
    assert len(set(ends)) == 1
    assert L.score_documents(docs.limit(0), MODEL, held_out("doc_id", 7, 2)).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = L.score_documents(docs, MODEL, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
