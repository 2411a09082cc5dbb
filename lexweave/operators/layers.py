"""Layers of a decoder as array functions: a row holds a vector, so a batch of any size is a projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def rms_norm(x: Column, weight: Column | None = None, eps: float = 1e-6) -> Column:
    """x over the root of its mean square, times a learned weight."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    root = F.sqrt(_sum(F.transform(x, lambda v: v.cast("double") * v.cast("double"))) / F.size(x) + eps)
    return F.transform(x, lambda v: v.cast("double") / root) if weight is None else F.zip_with(x, weight, lambda v, w: v.cast("double") / root * w.cast("double"))


def silu(x: Column) -> Column:
    """v times its logistic function."""
    return F.transform(x, lambda v: v.cast("double") / (1.0 + F.exp(-v.cast("double"))))


def gated(gate: Column, up: Column) -> Column:
    """The inner product of a SwiGLU layer: silu of one projection times the other, place by place."""
    return F.zip_with(silu(gate), up, lambda a, b: a * b.cast("double"))


def linear(x: Column, rows: Column, bias: Column | None = None) -> Column:
    """A matrix, given as an array of its rows, times a vector."""
    out = F.transform(rows, lambda r: dot(r, x))
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b.cast("double"))


def swiglu(x: Column, gate: Column, up: Column, down: Column) -> Column:
    return linear(gated(linear(x, gate), linear(x, up)), down)


def rope(x: Column, position: Column, size: int, base: float = 10000.0) -> Column:
    """A vector of even size turned by its position: the k-th place of either half by position / base^(2k/size)."""
    if size <= 0 or size % 2:
        raise ValueError("the size must be positive and even")
    half = size // 2

    def turned(_: Column, i: Column) -> Column:
        angle = position / F.pow(F.lit(base), 2.0 * F.pmod(i, F.lit(half)) / float(size))
        other = F.when(i < half, -F.get(x, i + half)).otherwise(F.get(x, i - half))
        return F.get(x, i).cast("double") * F.cos(angle) + other.cast("double") * F.sin(angle)

    return F.transform(x, turned)


def cache_append(cache: Column, new: Column, keep: int | None = None) -> Column:
    """A cache of past keys or values with new ones at its end; keep: only so many of the latest stay. A null cache is an empty one."""
    out = F.when(cache.isNull(), new).otherwise(F.concat(cache, new))
    return out if keep is None else cache_crop(out, keep)


def cache_crop(cache: Column, keep: int) -> Column:
    """The latest `keep` entries."""
    if keep <= 0:
        raise ValueError("at least one entry must stay")
    return F.when(F.size(cache) > keep, F.slice(cache, -keep, keep)).otherwise(cache)


def attention(df: DataFrame, seq: str = "seq", pos: str = "pos", query: str = "q", key: str = "k", value: str = "v", window: int | None = None) -> DataFrame:
    """seq, pos, out: causal attention of one head over rows (seq, pos, q, k, v); window: how many of the latest places a place sees.

    A place meets those before it in its own sequence: the work is the square of a sequence's length, or length times window.
    """
    size = F.size(query).cast("double")
    one = df.select(F.col(seq).alias("s"), F.col(pos).alias("p"), F.col(query).alias("q"), F.sqrt(size).alias("d"))
    two = df.select(F.col(seq).alias("s"), F.col(pos).alias("o"), F.col(key).alias("k"), F.col(value).alias("v"))
    seen = F.col("o") <= F.col("p") if window is None else (F.col("o") <= F.col("p")) & (F.col("o") > F.col("p") - window)
    met = one.join(two, "s").where(seen).select("s", "p", "o", (dot(F.col("q"), F.col("k")) / F.col("d")).alias("x"), "v")
    listed = met.groupBy("s", "p").agg(F.array_sort(F.collect_list(F.struct("o", "x", "v"))).alias("m"))
    top = F.array_max(F.transform("m", lambda e: e["x"]))
    weighed = listed.select("s", "p", F.transform("m", lambda e: F.struct(F.exp(e["x"] - top).alias("w"), e["v"].alias("v"))).alias("m"))
    total = _sum(F.transform("m", lambda e: e["w"]))
    out = F.transform(F.get("m", F.lit(0))["v"], lambda _, i: _sum(F.transform("m", lambda e: e["w"] * F.get(e["v"], i).cast("double"))) / total)
    return weighed.select(F.col("s").alias(seq), F.col("p").alias(pos), out.alias("out"))
