"""Reports over measured runs and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latency(runs: DataFrame, seconds: str = "seconds", by: tuple[str, ...] = (), tokens: str | None = None) -> DataFrame:
    """mean, deviation (of a sample; 0 for one run), least and number of timed runs, and tokens a second where runs say what they made."""
    more = [] if tokens is None else [F.avg(tokens).alias("mean_tokens"), (F.avg(tokens) / F.nullif(F.avg(seconds), F.lit(0.0))).alias("tokens_per_sec")]
    spread = F.when(F.count(seconds) > 1, F.stddev_samp(seconds)).otherwise(0.0)
    return runs.groupBy(*by).agg(F.avg(seconds).alias("mean_latency_s"), spread.alias("std_latency_s"), F.min(seconds).alias("min_latency_s"), F.count(seconds).alias("runs"), *more)


def compare(full: DataFrame, quantized: DataFrame, full_bytes: int, quantized_bytes: int, seconds: str = "seconds") -> DataFrame:
    """One row: mean latencies of two sets of runs, their ratio, and the ratio of sizes (0 where there is none)."""
    one, two = latency(full, seconds).select(F.col("mean_latency_s").alias("full_precision")), latency(quantized, seconds).select(F.col("mean_latency_s").alias("quantized"))
    both = one.withColumn("_k", F.lit(1)).join(two.withColumn("_k", F.lit(1)), "_k").drop("_k")
    ratio = quantized_bytes / full_bytes if full_bytes > 0 else 0.0
    return both.withColumns({"speedup": F.col("full_precision") / F.nullif(F.col("quantized"), F.lit(0.0)), "size_reduction_ratio": F.lit(ratio)})


def rolled_up(df: DataFrame, by: tuple[str, ...], **sums: Column) -> DataFrame:
    """Counts and sums for each prefix of the columns, the whole table included; `level` is how many of the columns a row is of."""
    level = F.lit(len(by)) - sum((F.grouping(c).cast("int") for c in by), F.lit(0))
    return df.rollup(*by).agg(level.alias("level"), F.count("*").alias("n"), *(c.alias(n) for n, c in sums.items()))
