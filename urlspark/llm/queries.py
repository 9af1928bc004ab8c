"""One query per corpus operator, with production parameters, over whole tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

import public_tokenizers

from urlspark.llm import (
    bpe, decontaminate, divergence, lattice, packing, pii, quality, repetition, resampling, secrets, simhash, toxicity, urltree,
)
from urlspark.llm.common import held_out, table
from urlspark.session import checkpoint_dir


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality(spark, sf_dir):
    docs, away = documents(spark, sf_dir), held_out("doc_id", 3, 1)
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels"), "quality", away), away)


def op2_toxicity(spark, sf_dir):
    docs, away = documents(spark, sf_dir), held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", away)
    return toxicity.score_documents(docs, model, away).drop("matches")


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_repetition(spark, sf_dir):
    return repetition.repetition_report(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "covered_words",
    )


def op5_decontamination(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contamination_report(documents(spark, sf_dir), items).drop("spans")


def op6_byte_bpe(spark, sf_dir, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken")):
    return bpe.round_trip(documents(spark, sf_dir), bpe.vocabulary(ranks), public_tokenizers.PATTERN)


def op7_token_file(spark, sf_dir, tokenizer=public_tokenizers.path("word_bpe_49k.json")):
    path = f"{checkpoint_dir(spark).rstrip('/')}/urlspark-llm/tokens-{uuid.uuid4().hex}"
    packing.write_tokens(documents(spark, sf_dir), packing.tokenizer_text(tokenizer), path, end_id=2)
    return packing.read_tokens(spark.read.parquet(path))


def op8_lattice_lm(spark, sf_dir, pieces=public_tokenizers.path("piece_bpe_32k.model")):
    return lattice.score_documents(documents(spark, sf_dir), bpe.vocabulary(pieces), held_out("doc_id", 7, 2))


def op9_pii(spark, sf_dir):
    return pii.personal_data_report(documents(spark, sf_dir))


def op10_url_templates(spark, sf_dir):
    return urltree.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("template", "elsewhere")


def op11_importance_resampling(spark, sf_dir):
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("text"))


def op12_secrets(spark, sf_dir):
    return secrets.secrets_report(documents(spark, sf_dir))


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_toxicity, op3_simhash, op4_repetition, op5_decontamination, op6_byte_bpe, op7_token_file,
              op8_lattice_lm, op9_pii, op10_url_templates, op11_importance_resampling, op12_secrets,
              op13_source_divergence)
}
