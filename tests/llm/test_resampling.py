import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import odd_docs, odd_texts, rows, sentence
from urlspark.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(small)
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, min_words=20, percent=5):
    """(key, n_features, weight, score, rank); keys must differ."""
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x)[1]) for texts in ([x for _, x in docs], target))
    every, wanted = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        n_words, found = plain_features(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (every + 10_000) / ((s[b] + 1) * (wanted + 10_000))))
            for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(found), weight, score, n_words >= min_words))
    fit = sorted((r for r in out if r[-1]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted((*r[:-1], rank.get(id(r))) for r in out if r[0] is not None)


def test_crc_of_spans():
    rng = random.Random(0)
    data = np.frombuffer(rng.randbytes(300_000), np.uint8)
    sizes = [1, 2, 3, 5, 17, R.DEPTH - 1, R.DEPTH, R.DEPTH + 1, 2 * R.DEPTH, 2 * R.DEPTH + 1, 5_000]
    starts = np.array([rng.randrange(100_000) for _ in range(800)] + [0])
    lengths = np.array([rng.choice(sizes) for _ in range(800)] + [len(data)])
    want = [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, lengths)]
    assert R.span_crcs(data, starts, lengths).tolist() == want


@pytest.mark.parametrize("text_bytes", [40, 1 << 18])
def test_features(monkeypatch, text_bytes):
    monkeypatch.setattr(R, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(R, "SPAN_BYTES", 256)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB c é.1\n-漢Z") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["", "abc", "abc", "def ", " x", "a", *[t or "" for t in odd_texts() if len(t or "") < 10_000]]
    got = [[] for _ in texts]
    for _, at, found in R.features(pa.array(texts)):
        for i, b in zip(at.tolist(), found.tolist()):
            got[i].append(b)
    for t, found in zip(texts, got):
        assert sorted(found) == sorted(zlib.crc32(f.encode()) % 10_000 for f in plain_features(t)[1])


def test_against_brute_force(spark):
    rng = random.Random(2)
    docs = list(enumerate([*odd_texts(), *(sentence(rng, rng.randint(1, 60)) for _ in range(300))]))
    target = [sentence(rng, 30) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = R.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(rows(got)) == brute(docs, target)
    assert got.where("rank is not null").count() > 5


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = R.resample(docs, docs.select("text").limit(0), percent=100)
    assert got.count() == docs.count()
    drawn = sorted(r.rank for r in got.where("rank is not null").collect())
    assert drawn == list(range(1, len(drawn) + 1))  # repeated rows and null keys each have their own rank
    twice = got.where("doc_id = 5").collect()
    assert len(twice) == 2 and twice[0].score == twice[1].score and abs(twice[0].rank - twice[1].rank) == 1
    none = [r for r in got.collect() if r.n_features == 0]
    assert none and all(r.weight == 0 for r in none)
    assert R.resample(docs.limit(0), docs).count() == 0


def test_one_key_held_by_a_third(spark):
    """Rows equal in everything are spread over the sorted ranges and still get each rank once."""
    text = sentence(random.Random(3), 30)
    docs = spark.range(300).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", f"'{text}' AS text")
    got = R.resample(docs, docs, percent=50).where("rank is not null").collect()
    assert sorted(r.rank for r in got) == list(range(1, 151))
    assert [r.score for r in sorted(got, key=lambda r: r.rank)] == sorted((r.score for r in got), reverse=True)
