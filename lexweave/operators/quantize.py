"""Symmetric whole-number quantisation of weight rows, and the bookkeeping of exported weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.prefix import placed
from lexweave.functions.stored import stored


def scale(row: Column, bits: int = 8) -> Column:
    """The step of a row: its largest magnitude, at least 1e-8, over the largest code."""
    if not 2 <= bits <= 8:
        raise ValueError("bits must be from 2 to 8")
    return F.greatest(F.array_max(F.transform(row, lambda x: F.abs(x.cast("double")))), F.lit(1e-8)) / float((1 << (bits - 1)) - 1)


def quantize(row: Column, step: Column, bits: int = 8) -> Column:
    """Codes, rounded half to even."""
    top = (1 << (bits - 1)) - 1
    return F.transform(row, lambda x: F.greatest(F.lit(float(-top - 1)), F.least(F.lit(float(top)), F.rint(x.cast("double") / step))).cast("tinyint"))


def dequantize(codes: Column, step: Column) -> Column:
    return F.transform(codes, lambda q: q.cast("double") * step)


def linear(codes: Column, step: Column, x: Column, bias: Column | None = None) -> Column:
    """The dot product of a dequantised row with a vector."""
    out = F.aggregate(F.zip_with(codes, x, lambda q, v: q.cast("double") * step * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return out if bias is None else out + bias


def quantize_layers(weights: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """weights (layer, row, weight) with codes and scale; layers whose name holds an excluded part keep null ones."""
    kept = F.lit(False)
    for part in exclude:
        kept = kept | F.col("layer").contains(part)
    return weights.withColumn("scale", F.when(~kept, scale(F.col("weight")))).withColumn("codes", F.when(~kept, quantize(F.col("weight"), F.col("scale"))))


def size_bytes(weights: DataFrame, column: str, width: int) -> DataFrame:
    return weights.agg((F.sum(F.size(column).cast("long")) * width).alias("bytes"))


#: Digests that one digest of the next level is made of.
FAN_IN = 4096


def checksum(parts: DataFrame, fan_in: int = FAN_IN, levels: int | None = None) -> DataFrame:
    """A digest over (key, bytes), whose keys are unique, in levels: SHA-256 of each key with the digest of its bytes, then of each `fan_in` such digests in the order of the keys, a line each, until one is left.

    No task holds more than `fan_in` digests. levels: so many whatever the number of keys, the last one over all digests that the one before it left (65 bytes for each `fan_in` keys at two
    levels). Without rows it is the digest of nothing.
    """
    if levels is not None and levels < 1:
        raise ValueError("levels must be positive")
    each = parts.select("key", F.sha2(F.concat_ws(":", "key", F.sha2("bytes", 256)), 256).alias("digest"))
    each = stored(each)
    level = each.join(placed(each, ["key"], None, "at"), "key").select("at", "digest")
    n, done = each.count(), 0
    while True:
        done += 1
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "\n")
        group = F.lit(0).cast("long") if done == levels else F.floor(F.col("at") / fan_in)
        level = level.groupBy(group.alias("at")).agg(F.sha2(joined, 256).alias("digest"))
        n = 1 if done == levels else -(-n // fan_in)
        if done == levels or (levels is None and n <= 1):
            return level.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("checksum"))


def optimizer_groups(params: DataFrame, weight_decay: float) -> DataFrame:
    """params (name, shape) with decay: none for vectors, norms and biases."""
    plain = (F.size("shape") < 2) | F.lower("name").contains("norm") | F.lower("name").endswith(".bias")
    return params.withColumn("weight_decay", F.when(plain, 0.0).otherwise(weight_decay))


def parameter_count(params: DataFrame) -> DataFrame:
    return params.agg(F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)).alias("n_params"))


def swiglu_width(hidden: int, multiple: int = 64) -> int:
    """Two thirds of four times the hidden size, up to a multiple."""
    return -(-(8 * hidden // 3) // multiple) * multiple


def parameter_catalogue(spark, vocab: int = 32000, hidden: int = 768, layers: int = 12) -> DataFrame:
    """(name, shape) of a decoder with tied embeddings, two norms a layer, four attention and three feed-forward matrices, and a last norm."""
    width = swiglu_width(hidden)
    rows = [("embedding", [vocab, hidden]), ("norm", [hidden])]
    for i in range(layers):
        rows += [(f"layers.{i}.attention.{n}", [hidden, hidden]) for n in ("q", "k", "v", "o")]
        rows += [(f"layers.{i}.ffn.gate", [width, hidden]), (f"layers.{i}.ffn.up", [width, hidden]), (f"layers.{i}.ffn.down", [hidden, width])]
        rows += [(f"layers.{i}.attention_norm", [hidden]), (f"layers.{i}.ffn_norm", [hidden])]
    return spark.createDataFrame(rows, "name string, shape array<bigint>")
