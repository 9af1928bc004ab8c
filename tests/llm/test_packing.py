import random
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import odd_docs, odd_texts
from urlspark.llm import packing as K

SETTINGS = K.tokenizer_text(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 33, (1 << 64) - 1])
def test_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    if n > 100:
        ids[50:120], ids[7] = 0, 1 << 63
    page = K.make_page(np.array([-5]), np.array([n]), ids)
    keys, lengths, back = K.read_page(page)
    assert (back == ids).all() and lengths.tolist() == [n] and keys.tolist() == [-5]
    for b in range(-(-n // K.BLOCK)):
        assert (K.read_block(page, b) == ids[b * K.BLOCK:(b + 1) * K.BLOCK]).all()


def library_ids(text):
    tokenizer = Tokenizer.from_str(SETTINGS)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_the_library():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCéÉßøñüÜİſÀ×÷ªµ'.,!#0 1-\u0301σΣ\n\t\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [t or "" for t in odd_texts()] + ["<|endoftext|> x <|startoftext|>y", "ΑΣ ΣΑΣ σΣ"]
    ids, lengths = K.WordTokenizer(SETTINGS).encode(pa.array(texts), 2)
    tokenizer = Tokenizer.from_str(SETTINGS)
    tokenizer.encode_special_tokens = True
    for text, end, n in zip(texts, np.cumsum(lengths), lengths):
        assert ids[end - n:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2], text


@pytest.mark.parametrize("page_ids", [K.PAGE_IDS, 500])
def test_files(spark, tmp_path, monkeypatch, page_ids):
    monkeypatch.setattr(K, "PAGE_IDS", page_ids)
    docs = odd_docs(spark)
    K.write_tokens(docs, SETTINGS, f"{tmp_path}/t", end_id=2, parts=4)
    got = K.read_tokens(spark.read.parquet(f"{tmp_path}/t"), with_ids=True).collect()
    want = {(r["doc_id"], tuple(library_ids(r["text"]) + [2])) for r in docs.collect()}
    read = [(r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in got]
    assert set(read) == want and len(got) == docs.count()
    in_order = sorted(got, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    total = 0
    for r in in_order:
        assert r["start"] == total and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        total += r["n_tokens"]


def test_no_rows(spark, tmp_path):
    K.write_tokens(odd_docs(spark).limit(0), SETTINGS, f"{tmp_path}/t", end_id=2)
    assert K.read_tokens(spark.read.parquet(f"{tmp_path}/t")).count() == 0


def test_words_are_chosen_for_all_blocks_at_once():
    """The choice of words is the greedy one of each block, and its calls do not grow with the words of a page."""
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.geometric(0.001, 1 << 18), 49_000).astype(np.uint64)
    ids[rng.random(len(ids)) < 0.3] = 1
    ids[[5, 2_000]] = 1 << 61
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event == "c_call"

    sys.setprofile(count)
    try:
        words, offsets, exceptions = K.pack(ids)
    finally:
        sys.setprofile(None)
    assert calls[0] < 10_000 < len(words)
    sizes = []
    for begin in range(0, 8 * K.BLOCK, K.BLOCK):
        block, at, n = ids[begin:begin + K.BLOCK].tolist(), 0, 0
        while at < len(block):
            fits = [c for c, w in zip(K.COUNTS[:-1].tolist(), K.WIDTHS.tolist()) if max(block[at:at + c]) < 1 << w]
            at, n = at + (fits[0] if fits else 1), n + 1
        sizes.append(n)
    assert np.diff(offsets)[:8].tolist() == sizes
    assert exceptions.tolist() == [1 << 61] * 2
    assert np.array_equal(K.unpack(words, len(ids), exceptions, offsets), ids)
