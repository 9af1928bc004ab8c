import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import odd_docs, odd_texts, rows, sentence
from urlspark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, min_docs=30, top=50):
    """Sorted result rows for (text, lang, source) rows."""
    docs = [tuple(x or "" for x in d) for d in docs]
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        found = terms_of(text)
        held[lang].update(set(found))
        count[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found)
                        if part == "pair" or i < top]
    return sorted(out)


def test_sorted_pointers():
    rng = random.Random(0)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 30))).encode() for _ in range(3_000)]
    words += [b"abcdefgh", b"abcdefghi", b"abcdefg", b"abcdefgh", b"x" * 16, b"x" * 17, b"x" * 16, b"x" * 3_000] * 3
    data = np.frombuffer(b" ".join(words) + b"\x00" * 8, np.uint8)
    sizes = np.array([len(w) for w in words])
    begins = np.cumsum(sizes + 1) - sizes - 1
    order, head = D.sort_pointers(data, begins, sizes)
    want = sorted(range(len(words)), key=lambda i: (words[i], i))
    assert order.tolist() == want
    assert head.tolist() == [i == 0 or words[want[i]] != words[want[i - 1]] for i in range(len(want))]


def test_shard_terms():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB c é.1\n-漢Z") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["", "abc", "abc", "def ", " x", "a", *[t or "" for t in odd_texts() if len(t or "") < 10_000]]
    group = np.array([rng.randrange(4) for _ in texts])
    got = D.shard_terms(pa.array(["zz zz", *texts]).slice(1), group, 4)
    seen, n = Counter(), Counter()
    for t, g in zip(texts, group.tolist()):
        n.update((w, g) for w in terms_of(t))
        seen.update((w, g) for w in set(terms_of(t)))
    assert {(w, g): (d, k) for w, g, d, k in zip(*(x.tolist() for x in got))} == {k: (seen[k], n[k]) for k in n}


@pytest.mark.parametrize("held", [1, 1_024])
def test_against_brute_force(spark, monkeypatch, held):
    """Also with sums handed on batch by batch, small shards and few shares at once."""
    monkeypatch.setattr(D, "SOURCES_HELD", held)
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    monkeypatch.setattr(D, "CELLS", 10)
    rng = random.Random(3)
    docs = [(t, rng.choice(["en", None, "x"]), rng.choice(["a", "é", "Z", "", None, "zz"]))
            for t in [*odd_texts(), *(sentence(rng, rng.randint(0, 40)) for _ in range(200))] if len(t or "") < 10_000]
    docs += [("only once", "alone", "s"), (None, "none", "s"), ("", "none", "t")]
    frame = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    got = D.audit(frame, min_docs=8, top=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(docs, 8, 6)
    assert sorted(rows(got)) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    plain = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(rows(D.audit(docs, min_docs=2))) == brute(plain, 2)
    assert D.audit(docs.limit(0)).count() == 0
    other = docs.select("text", "n_words", docs.lang.alias("term"), docs.source.alias("n"))
    assert sorted(rows(D.audit(other, lang="term", source="n", min_docs=2))) == brute(plain, 2)


def test_large_counts(spark):
    """Shares of counts beyond what 64 bits hold as thousands of millions."""
    got = spark.range(1).selectExpr("90000000000000L AS n", "800000000000000L AS total", "1000L AS terms").select(
        D._share("n", "total", "terms")).first()[0]
    assert got == 1 + 10**9 * (90_000_000_000_000 + 5) // (800_000_000_000_000 + 5_000)
