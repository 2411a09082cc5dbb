"""Learning-rate schedules and checkpoint retention, as relational expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def multiplier(step: Column, warmup: int, total: int, kind: str = "cosine", floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine or a line down to the floor."""
    if total <= 0 or not 0 <= warmup <= total or not 0 <= floor <= 1 or kind not in ("cosine", "linear"):
        raise ValueError("bad schedule")
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(1, total - warmup))))
    shape = 0.5 * (1 + F.cos(F.lit(math.pi) * done)) if kind == "cosine" else 1 - done
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(floor + (1 - floor) * shape)


def schedule(spark: SparkSession, warmup: int, total: int, base: float = 1.0, **more) -> DataFrame:
    """step, lr."""
    return spark.range(total).select(F.col("id").alias("step"), (base * multiplier(F.col("id"), warmup, total, **more)).alias("lr"))


def with_step(checkpoints: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows whose file name is checkpoint_step<number>.pt, with the number; others are left out."""
    step = F.regexp_extract(path_col, r"(?:^|/)checkpoint_step(\d+)\.pt$", 1)
    return checkpoints.withColumn("step", F.when(step != "", step.cast("long"))).where("step IS NOT NULL")


def to_prune(checkpoints: DataFrame, keep: int, run_col: str = "run") -> DataFrame:
    """All but the newest `keep` of each run."""
    if keep <= 0:
        raise ValueError("keep must be positive")
    newest = Window.partitionBy(run_col).orderBy(F.desc("step"), F.desc("path"))
    return with_step(checkpoints).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") > keep).drop("_n")


def latest(checkpoints: DataFrame, run_col: str = "run") -> DataFrame:
    return with_step(checkpoints).groupBy(run_col).agg(F.max_by("path", F.struct("step", "path")).alias("path"), F.max("step").alias("step"))
