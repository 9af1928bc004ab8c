import random
import re

import pytest
import xxhash

from tests.llm.cases import odd_docs, odd_texts, rows, sentence
from urlspark.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    parent = list(range(len(marks)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(marks):
        for j in range(i):
            if bin(a ^ marks[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(S, "SHINGLES_AT_ONCE", 7)
    for t in odd_texts():
        assert S.fingerprint(t or "") == plain_fingerprint(t)


def near_marks():
    rng = random.Random(2)
    marks = {0, 1, 3, (1 << 64) - 1}
    for _ in range(60):
        m = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            marks.add(m)
            for _ in range(rng.choice([1, 2, 3])):
                m ^= 1 << rng.randrange(64)
    return sorted(marks)


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_lose_no_component(spark, bucket):
    marks = near_marks()
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    edges = S.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket)
    for u, v in rows(edges):
        assert bin((u ^ v) & (1 << 64) - 1).count("1") <= 2
    root = dict(rows(S.components(edges)))
    got, want = [root.get(s, s) for s in signed], brute_components(marks)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
    assert all(root.get(s, s) == min(x for x, w in zip(signed, want) if w == want[i]) for i, s in enumerate(signed))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "u long, v long")
    assert sorted(rows(S.components(edges))) == [(i, 0) for i in range(1, 301)]


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    texts = odd_texts()
    for _ in range(12):
        words = sentence(rng, 300).split()
        for _ in range(4):
            texts.append(" ".join(words))
            words[rng.randrange(300)] = "other"
    docs = odd_docs(spark, texts)
    ids = [(r["doc_id"], r["text"]) for r in docs.collect()]
    marks = [plain_fingerprint(t) for _, t in ids]
    group = brute_components(marks)
    want = sorted(
        ((i, f"{m:016x}", min((j for (j, _), g2 in zip(ids, group) if g2 == g and j is not None), default=None))
         for (i, _), m, g in zip(ids, marks, group)), key=str)
    assert sorted(rows(S.near_duplicates(docs)), key=str) == want
    kept = S.keep_one(docs)
    assert kept.schema == docs.schema and kept.count() == len(set(group))
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0
