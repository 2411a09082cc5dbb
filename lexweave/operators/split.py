"""Deterministic train, validation and test splits."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.prefix import running

SPLITS = ("train", "validation", "test")


def check_ratios(train: float, validation: float, test: float) -> None:
    if min(train, validation, test) < 0:
        raise ValueError("ratios must not be negative")
    if abs(train + validation + test - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")


def cut_points(n: int, train: float, validation: float) -> tuple[int, int]:
    """Rows before the validation and before the test split; halves round to even."""
    first = round(n * train)
    return first, first + round(n * validation)


def _chosen(rank, n: int, train: float, validation: float):
    first, second = cut_points(n, train, validation)
    return F.when(rank < first, SPLITS[0]).when(rank < second, SPLITS[1]).otherwise(SPLITS[2])


def split(df: DataFrame, train: float = 0.98, validation: float = 0.01, test: float = 0.01, seed: int = 42, order_col: str = "pos", mode: str = "exact") -> DataFrame:
    """df with `split`.

    exact: as many rows as the ratios say, by rank of a seeded hash. The rank comes from counts of ranges of the hash, so no task
    sorts all rows. parity: the permutation that Python's seeded shuffle gives the rows in order_col's order; its size is the
    number of rows, on the driver, so it is for small tables. scalable: by thresholds of the hash, without any shuffle; counts are approximate.
    """
    check_ratios(train, validation, test)
    if mode == "scalable":
        u = seeded_hash(seed, order_col) / float(1 << 48)
        return df.withColumn("split", F.when(u < train, SPLITS[0]).when(u < train + validation, SPLITS[1]).otherwise(SPLITS[2]))
    n = df.count()
    if not n:
        raise ValueError("nothing to split")
    # df is read again below, next to its order columns alone: costly steps before it should be stored
    if mode == "parity":
        order = list(range(n))
        random.Random(seed).shuffle(order)
        where = df.sparkSession.createDataFrame([(place, rank) for rank, place in enumerate(order)], "_place long, _rank long")
        return running(df.withColumn("_one", F.lit(1)), [order_col], "_one", "_place").drop("_one").join(where, "_place").withColumn("split", _chosen(F.col("_rank"), n, train, validation)).drop("_place", "_rank")
    if mode != "exact":
        raise ValueError(f"unknown mode {mode}")
    hashed = df.withColumns({"_hash": seeded_hash(seed, order_col), "_one": F.lit(1)})
    return running(hashed, ["_hash", order_col], "_one", "_rank").withColumn("split", _chosen(F.col("_rank"), n, train, validation)).drop("_hash", "_one", "_rank")


def seeded_hash(seed: int, order_col: str):
    """48 bits of an MD5, which any SQL engine computes alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), order_col)), 1, 12), 16, 10).cast("long")
