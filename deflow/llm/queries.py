"""The registered queries of this package; each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deflow.llm import (chat, decontam, fingerprints, langid, merkle, mixing, oracles, phrases, quality, secrets, setjoin, spans, tokenfile,
                        urls)
from deflow.llm.common import table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "draws", "shards")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = langid.held_out("doc_id", 3, 1)
    model = quality.fit(docs, labels.where(~held))
    out = quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = written(chat.format_turns(turns.unionByName(more), TOKENIZER), "chat")
    return chat.summaries(formatted, TOKENIZER)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, keep=["doc_id"])
    return out.select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "lang_ok")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents only: one row per document and item it contains."""
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences only: which ones, and the documents where they stay."""
    return spans.removals(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, keep=["doc_id"])
    return out.select("doc_id", *[secrets.count_of("spans", k).alias(f"n_{k}") for k in secrets.KINDS],
                      F.sha2(secrets.listed("spans", True).cast("binary"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_mix, op3_quality, op4_token_files, op5_jaccard_join, op6_chat, op7_language,
                                 op8_fingerprints, op9_decontamination, op10_sentence_spans, op11_collocations,
                                 op12_merkle_manifest, op13_secrets)}
ORACLES: dict[str, str] = {"op1_url_filter": oracles.url_filter(), "op5_jaccard_join": oracles.jaccard(), "op6_chat": oracles.chat(),
                           "op11_collocations": oracles.collocations(), "op12_merkle_manifest": oracles.manifest()}
