import random

import numpy as np
import public_tokenizers as P
import tiktoken

from tests.llm.cases import odd_docs, odd_texts, rows
from urlspark.llm import bpe as B

RANKS = B.vocabulary(P.path("byte_bpe_50k.tiktoken"))


def library(bpe):
    ranks = {v: k for k, v in bpe.bytes.items()}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(monkeypatch):
    bpe = B.encoder(RANKS, P.PATTERN)
    want = library(bpe)
    rng = random.Random(3)
    letters = "aeinrst hl\n'.0123éß漢😀\x1c\x85  ABC  "
    texts = [t or "" for t in odd_texts()] + ["a" * 3000, "ab" * 2000, " " * 700 + "x", "=-" * 400, "  a b", "a b ", "it's"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for limit in (B.WHOLE_LIST, 10):
        monkeypatch.setattr(B, "WHOLE_LIST", limit)
        for t in texts:
            ids = bpe.encode(t)
            assert ids.tolist() == want.encode_ordinary(t)
            assert bpe.decode(ids) == t.encode()


def test_other_vocabulary():
    bpe = B.encoder(B.vocabulary(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    for t in odd_texts():
        assert bpe.encode(t or "").tolist() == library(bpe).encode_ordinary(t or "")


def test_memo_is_bounded():
    memo = B._Memo(3, str.encode)
    assert [memo[c] for c in "abcdabcd"] == [c.encode() for c in "abcdabcd"] and len(memo) <= 3


def test_documents(spark):
    docs = odd_docs(spark)
    coded = B.encode_documents(docs, RANKS, P.PATTERN)
    back = B.decode_ids(coded, RANKS, P.PATTERN)
    assert sorted((bytes(r["decoded"]) for r in back.collect())) == sorted((r["text"] or "").encode() for r in docs.collect())
    digests = B.round_trip(docs, RANKS, P.PATTERN, with_ids=True).collect()
    for r in digests:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["n_tokens"] and B.sha256_hex(bytes(r["ids"])) == r["ids_sha256"]
    assert rows(B.round_trip(docs.limit(0), RANKS, P.PATTERN)) == []
