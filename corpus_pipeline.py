"""From raw documents to token ids: toxicity, near-duplicates, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Documents predicted to be toxic go; one document of each group of near-duplicates stays; documents that hold a
benchmark passage go; secrets in the texts of the rest are replaced by a mark; what is left is encoded.

Null texts count as empty and are kept by every filtering stage, as are empty ones; the secrets stage writes them as empty
texts. Rows without a doc_id are documents of their own and are never dropped as near-duplicates. In the near-duplicate
stage different texts that share a doc_id are documents of their own, and of rows with the same doc_id and text one
stays; the other stages treat each row for itself. Very long texts are taken whole. Extra columns pass through up to the encoding, whatever their
names. An empty table gives an empty table.

A stage is called when the result of the one before it has been written and read again; it first deletes the scratch
tables of the earlier stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, phrases, secrets, setsketch, toxicity
from tidemark.llm.common import release, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return toxicity.ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return setsketch.one_of_each(docs, percent=80, every_text=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return phrases.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    new = secrets.redact(docs, secrets.train(secrets.samples(docs)))
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]

#: Toxicity models, SetSketch registers and BPE merges have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name, scratch=False)
    return docs
