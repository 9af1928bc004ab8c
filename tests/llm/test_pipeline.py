import random

import corpus_pipeline
import public_tokenizers as P

from tests.llm.cases import odd_docs, odd_texts, rows, sentence
from tests.llm.test_bpe import RANKS, library
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute_groups, plain_set
from tests.llm.test_repetition import brute as repetition
from urlspark.llm import bpe, pii


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    item = sentence(rng, 25)
    texts = odd_texts()
    for _ in range(6):
        t = sentence(rng, 150)
        texts += [t, t, t + " end", f"{t} {rng.randint(10, 99)}@mail.example.org"]
    texts += [sentence(rng, 60) + " " + item, sentence(rng, 60) + " " + item.upper()]
    docs = odd_docs(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = []
    for r in docs.collect():
        f = repetition((r["text"] or ""))if len(r["text"] or "") < 10_000 else None
        clean = f is None or not (
            f["n_words"] < 50 or 2 * f["n_repeat_words"] > f["n_words"] or f["covered_words"] > 0.3 * f["n_words"]
            or f["longest_repeat"] > 100)
        if clean:
            kept.append((r["doc_id"], r["text"]))
    groups = {}
    for row, g in zip(kept, brute_groups([plain_set(t) for _, t in kept])):
        groups.setdefault(g, []).append(row)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    kept = [(i, t) for i, t in kept if not contaminated(t, [(1, item)])[-1]]
    encoder = library(bpe.encoder(RANKS, P.PATTERN))
    want = []
    for i, t in kept:
        masked = pii.mask(t, pii.find_personal_data(t))
        want.append((i, len(encoder.encode_ordinary(masked)), bpe.sha256_hex(masked.encode())))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "decoded_sha256")
    assert sorted(rows(got), key=str) == sorted(want, key=str)
    assert len(want) > 5


def test_stages_keep_columns_and_take_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_docs(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0 and (i == 4 or out.schema == docs.schema)
