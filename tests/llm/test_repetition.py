import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import odd_docs, odd_texts
from urlspark.llm import repetition as R


def brute(text, least=12):
    words = R.words(pa.array([text]))[0].to_pylist()
    n = len(words)

    def inside(k):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(words[i:i + k]), []).append(i)
        return {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}

    longest = 0
    for k in range(least, n):
        if not inside(k):
            break
        longest = k
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside(3)),
            "covered_words": len(inside(least)), "longest_repeat": longest}


def made_texts():
    rng = random.Random(1)
    out = [t or "" for t in odd_texts() if t is None or len(t) < 10_000]
    for _ in range(80):
        words = [rng.choice("a b c d #e|".split()) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.5 and words:
            words += words[:rng.randint(1, len(words))]
        out.append("".join(w + rng.choice([" ", "\n", "  "]) for w in words))
    return out


def test_brute_force():
    texts = made_texts()
    found = R.repetition_figures(pa.array(texts))
    for i, text in enumerate(texts):
        assert {k: int(found[k][i]) for k in brute("")} == brute(text), text[:80]


def test_walk_equals_doubling(monkeypatch):
    rng = np.random.default_rng(0)
    word = rng.integers(0, 2, 600)
    owner = np.repeat([0, 1, 2], 200)
    first = R.WordSuffixes(word, owner).repeats(8)
    monkeypatch.setattr(R, "LEVEL_WORDS", 10)
    assert (R.WordSuffixes(word, owner).repeats(8) == first).all()


def test_batches_do_not_matter(monkeypatch):
    texts = pa.array(made_texts())
    whole = R.repetition_figures(texts)
    monkeypatch.setattr(R, "BATCH_WORDS", 1)
    apart = R.repetition_figures(texts)
    assert all((whole[k] == apart[k]).all() for k in whole)


@pytest.mark.parametrize("longest, kept", [(90, True), (110, False)])
def test_limit_on_the_longest_repeat(longest, kept):
    rng = random.Random(3)
    words = [f"w{rng.random()}" for _ in range(1000)]
    text = " ".join(words + words[:longest])
    assert R.repetition_figures(pa.array([text]))["kept"][0] == kept


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = R.repetition_report(docs).collect()
    assert len(got) == docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    kept = R.keep_clean(docs)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r["kept"] for r in got)
    assert R.repetition_report(docs.limit(0)).count() == 0 and R.keep_clean(docs.limit(0)).count() == 0
