import hashlib
import random
import re

import pytest

from tests.llm.cases import odd_docs, odd_texts, rows, sentence
from urlspark.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[k:k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, bool(hit)


@pytest.mark.parametrize("block_bytes", [2_000_000, 600])
def test_brute_force(spark, block_bytes):
    rng = random.Random(6)
    long = [sentence(rng, 30) for _ in range(6)]
    items = [(i, t) for i, t in enumerate(long + ["Short One", "short one", None, "", "...", "x", long[0]])]
    texts = odd_texts()[:4] + [sentence(rng, 40) for _ in range(4)]
    for t in long[:4]:
        w = t.split()
        texts += [f"{sentence(rng, 5)} {t.upper()}! {sentence(rng, 5)}", ", ".join(w[3:17]) + " " + ";".join(w[20:29])]
    texts += ["a short-one", "a shortone", "x"]
    docs = odd_docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination_report(docs, bench, block_bytes=block_bytes)
    want = [(r["doc_id"], *brute(r["text"], items)) for r in docs.collect()]
    assert sorted(rows(got.drop("spans")), key=str) == sorted(want, key=str)
    clean = D.drop_contaminated(docs, bench, block_bytes=block_bytes)
    assert clean.schema == docs.schema and clean.count() == sum(not w[-1] for w in want)
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        found = [w for b, e in spans for w in words(by_id[r["doc_id"]][int(b):int(e)])]
        assert r["doc_id"] is None or len(found) == r["n_hit"]


def test_empty_tables(spark):
    docs, bench = odd_docs(spark), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contamination_report(docs.limit(0), bench).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_items_without_id(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "d e f a b c"), (3, "z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (None, "B c"), ("i", "d e f")], "item_id string, text string")
    for block_bytes in (D.BLOCK_BYTES, 6):
        got = {r.doc_id: r for r in D.contamination_report(docs, items, block_bytes=block_bytes).collect()}
        assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (1, 2, 3)] == [(3, 1, True), (6, 2, True), (0, 0, False)]
        assert got[1].items_sha256 == D.sha256_hex(b"") and got[2].items_sha256 == D.sha256_hex(b"i")
        assert [r.doc_id for r in D.drop_contaminated(docs, items, block_bytes=block_bytes).collect()] == [3]
