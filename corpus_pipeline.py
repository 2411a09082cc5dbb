"""The corpus pipeline: five operators of lexweave.llm, one after the other, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the rows for the next; all but the last return the columns of `documents`.

All stages take null ids and texts, empty and very long texts, repeated rows, rows that repeat an id with other texts, empty tables, and
further columns of any name, which stay as they are up to the last stage. What each makes of them is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bottomk, bpe_codec, importance, mixing, queries, secrets
from lexweave.llm.common import remove, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws stay. Null and empty texts have no evidence against them and mostly stay; rows with a null id share one draw; repeated rows stay or go together."""
    return importance.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least id. Rows without words or without an id stay; repeated rows of the document that stays stay too."""
    return bottomk.drop_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and weak parts linked to them, are replaced by a mark; n_chars follows. Cuts follow from the text alone, whatever the id; a null text stays null."""
    return secrets.redact(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says. Null and empty texts weigh nothing, so their rates only follow the others'; repeated rows are copied alike."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"), queries.domain(), queries.TARGET, queries.HOLD)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, ids_sha256, decoded_sha256 and round_trip of each row; none are left out. A null text is encoded as an empty one."""
    return bpe_codec.encode_checked(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("importance resampling", quality), ("near-duplicates", near_dedup), ("secrets", redact_secrets), ("mixing", mix), ("byte-level BPE", encode)]
#: SQL can express neither the models nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written to the shared folder and read again, and goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
