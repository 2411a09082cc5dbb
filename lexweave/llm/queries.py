"""The registered queries of this subpackage: thin, each over its whole table through its operator."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import alignment, bottomk, bpe_codec, divergence, importance, ledger, mixing, oracles, pii, piece_count, secrets, sharding, telephony, url_filter
from lexweave.llm.common import scratch, table


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.store(table(spark, sf_dir, "documents"), pcm=True)
    return telephony.describe(stored, pcm_col="pcm").drop("media", "pcm")


def op3_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.word_counts(pages, "html")).drop("score")


def op4_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents"))).drop("n_linked")


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_heap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def domain():
    """The domain of a row of `labels`."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


#: Weights of the domains in the mixture.
TARGET = {"clean": 0.92, "toxic": 0.06, "low": 0.02}
#: Clean tokens in the mixture, as a multiple of those there are.
HOLD = ("clean", 1.03)


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), domain(), TARGET, hold=HOLD)[0]


ARRIVALS = 6


def op8_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in six parts; the store lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, scratch(spark, "shards"))
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.expire()
    return sharding.ledger(store)


def op9_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ledger.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.describe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"))).drop("n_added")


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is written once; every policy's ablations are then read from its bits."""
    path = scratch(spark, "ledger")
    ledger.ledger(table(spark, sf_dir, "documents")).write.parquet(path)
    book = spark.read.parquet(path)
    return functools.reduce(DataFrame.unionByName, (ledger.ablations(book, v) for v in ledger.POLICIES))


def queries() -> dict:
    return {f.__name__: f for f in (op1_importance, op2_telephony, op3_url_words, op4_linked_secrets, op5_tree_bpe, op6_heap_counts, op7_soft_mixing, op8_tiered_shards, op9_bottomk_dedup, op10_rule_ledger, op11_divergence, op12_token_alignment, op13_weak_pii, ledger_ablations)}


def oracle_sql() -> dict:
    return oracles.SQL
