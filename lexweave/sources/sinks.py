"""Writing documents, splits and token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources import token_shards


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, nulls included; the committer puts all files in place or none."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.write.option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """A folder of JSON lines for each split that has rows."""
    if df.isEmpty():
        raise ValueError("all splits are empty")
    df.write.option("ignoreNullFields", False).partitionBy("split").json(path)


def write_shards(shards: DataFrame, path: str, dtype: str = "uint16", prefix: str = "shard") -> dict:
    """Writes rows of (shard, start_offset, tokens) as a token store (sources.token_shards): a raw file each, and a manifest, which it returns; all or nothing."""
    token_shards.register(shards.sparkSession)
    kind = ((c.split(" ")) for c in token_shards.SCHEMA.split(", "))
    rows = shards.select(*(F.col(n).cast(t).alias(n) for n, t in kind))
    rows.write.format("token_shards").option("dtype", dtype).option("prefix", prefix).mode("append").save(path)
    return token_shards.load_manifest(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a folder or file; ValueError if keys are missing or a shard isn't there."""
    path = path.removesuffix("/manifest.json")
    manifest = token_shards.load_manifest(path)
    if gone := token_shards.missing(path, manifest):
        raise ValueError(f"missing shards: {gone}")
    return manifest


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, start_offset, tokens of a token store."""
    token_shards.register(spark)
    return spark.read.format("token_shards").load(path)


def export_manifest(weights: DataFrame, path: str) -> str:
    """Writes (key, bytes) as Parquet with their checksum beside; returns the checksum."""
    from lexweave.operators.quantize import checksum

    weights.write.parquet(f"{path}/weights")
    digest = checksum(weights).first()[0]
    weights.sparkSession.createDataFrame([(digest, weights.count())], "checksum string, n long").coalesce(1).write.json(f"{path}/manifest")
    return digest


def import_weights(spark: SparkSession, path: str) -> DataFrame:
    """The weights; ValueError if their checksum isn't the manifest's."""
    from lexweave.operators.quantize import checksum

    weights = spark.read.parquet(f"{path}/weights")
    if checksum(weights).first()[0] != spark.read.json(f"{path}/manifest").first()["checksum"]:
        raise ValueError("the weights' checksum differs from the manifest's")
    return weights


def read_slice(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """shard, start_offset, tokens of the files that overlap [start, stop); no other file is opened."""
    size = token_shards.load_manifest(path)["shard_size"]
    return read_shards(spark, path).where((F.col("start_offset") > start - size) & (F.col("start_offset") < stop)).where(F.col("start_offset") + F.size("tokens") > start)


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """One JSON document with the rows of each named result; results are metrics, a few rows each."""
    rows = None
    for name, df in results.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name)).withColumn("_k", F.lit(1))
        rows = one if rows is None else rows.join(one, "_k")
    if rows is None:
        raise ValueError("no results")
    rows.drop("_k").coalesce(1).write.option("ignoreNullFields", False).json(path)
