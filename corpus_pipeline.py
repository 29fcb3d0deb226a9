"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir) that calls one operator of ``deflow.llm``; its result is
written as Parquet in the shared folder and read again as the next stage's ``docs``. All but the last return
the columns of ``docs``:

1. language ID: documents whose language is not clear go;
2. n-gram Jaccard join: of each group of near duplicates the document with the smallest key stays;
3. benchmark decontamination: documents that contain a benchmark item go;
4. mixing: a document comes as often as the mix takes it, shard by shard in shuffled order;
5. token files: the mix as token ids, read back from the files, with a digest of each document's ids.

Null and empty texts go in stage 1, as they have no language; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deflow.llm import decontam, langid, mixing, setjoin, tokenfile
from deflow.llm.common import table, written
from deflow.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.assemble(mixing.mix(docs), docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination),
          ("mixture", mixture), ("token_files", token_files)]

# The compression classifier of stage 1 and the hashes of stage 4 have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
