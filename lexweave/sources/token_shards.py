"""Token shards as a data source: raw files of fixed-width ids beside a manifest, in any file system that Arrow knows.

    spark.dataSource.register(TokenShards)
    shards.write.format("token_shards").option("dtype", "uint16").mode("append").save(path)
    spark.read.format("token_shards").load(path).where("start_offset < 5000000")

A write is seen whole or not at all. Tasks put their files in a folder of the job's own; once all have ended, the driver moves the files that
committed tasks name to their places and writes the manifest last. A reader goes by the manifest alone, so the files of a job that fails,
or of a task that ran twice, are never read; they are deleted when the job ends. A folder that has a manifest is not written to unless in mode
overwrite, which takes the old manifest away first.

A read makes a partition of each shard, of which nothing is opened before it is read. Conditions on shard and start_offset leave
partitions out, where the session lets them reach Python sources (`spark.sql.python.filterPushdown.enabled`); Spark checks them again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from lexweave.functions.batches import bound_batches
from lexweave.functions.stored import stored

SCHEMA = "shard int, start_offset long, tokens array<long>"
WIDTHS = ("uint16", "uint32")
KEYS = ("dtype", "total_tokens", "shard_size", "num_shards", "shards")


def file_system(path: str):
    """(Arrow's file system, the path in it) of a path or URI."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file:").removeprefix("//").rstrip("/")
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def load_manifest(path: str) -> dict:
    """The manifest of a folder; ValueError if keys are missing, FileNotFoundError if there is none."""
    fs, inner = file_system(path)
    with fs.open_input_stream(f"{inner}/manifest.json") as f:
        manifest = json.loads(f.read())
    if missing := [k for k in KEYS if k not in manifest]:
        raise ValueError(f"manifest lacks {missing}")
    return manifest


def missing(path: str, manifest: dict) -> list[str]:
    """The files that the manifest names and the folder doesn't hold."""
    from pyarrow.fs import FileSelector

    fs, inner = file_system(path)
    there = {f.base_name for f in fs.get_file_info(FileSelector(inner))}
    return [s["file"] for s in manifest["shards"] if s["file"] not in there]


@dataclass
class Shard(InputPartition):
    shard: int
    file: str
    start_offset: int
    num_tokens: int


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []
        self.manifest = load_manifest(path)

    def pushFilters(self, filters):
        compare = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
        for f in filters:
            if type(f) in compare and f.attribute in (("shard",), ("start_offset",)):
                self.filters.append((f.attribute[0], compare[type(f)], f.value))
            yield f  # Spark checks them all again

    def partitions(self):
        shards = [Shard(k, s["file"], s["start_offset"], s["num_tokens"]) for k, s in enumerate(self.manifest["shards"])]
        return [s for s in shards if all(getattr(getattr(s, name), op)(value) for name, op, value in self.filters)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, inner = file_system(self.path)
        with fs.open_input_stream(f"{inner}/{partition.file}") as f:
            ids = np.frombuffer(f.read(), dtype=np.dtype(self.manifest["dtype"]).newbyteorder("<"))
        if len(ids) != partition.num_tokens:
            raise ValueError(f"{partition.file} has {len(ids)} tokens, the manifest says {partition.num_tokens}")
        tokens = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([partition.shard], pa.int32()), pa.array([partition.start_offset], pa.int64()), tokens], ["shard", "start_offset", "tokens"])


class Writer(DataSourceWriter):
    def __init__(self, path: str, dtype: str, prefix: str, overwrite: bool):
        if dtype not in WIDTHS:
            raise ValueError(f"unknown dtype {dtype}; there are {WIDTHS}")
        self.path, self.dtype, self.prefix, self.overwrite = path, dtype, prefix, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        fs, inner = file_system(self.path)
        fs.create_dir(f"{inner}/{self.staging}", recursive=True)
        out, most = [], np.iinfo(self.dtype).max
        for row in iterator:
            ids = np.asarray(row.tokens, dtype=np.int64)
            if len(ids) and not 0 <= ids.min() <= ids.max() <= most:
                raise ValueError(f"shard {row.shard} holds ids that {self.dtype} doesn't")
            draft = uuid.uuid4().hex
            with fs.open_output_stream(f"{inner}/{self.staging}/{draft}") as f:
                f.write(ids.astype(np.dtype(self.dtype).newbyteorder("<")).tobytes())
            out.append({"shard": row.shard, "start_offset": row.start_offset, "num_tokens": len(ids), "draft": draft})
        return Written(out)

    def commit(self, messages) -> None:
        fs, inner = file_system(self.path)
        found = sorted((s for m in messages if m is not None for s in m.shards), key=lambda s: s["start_offset"])
        try:
            if not found:
                raise ValueError("no tokens")
            if [s["shard"] for s in found] != list(range(len(found))) or any(a["start_offset"] + a["num_tokens"] != b["start_offset"] for a, b in zip(found, found[1:])):
                raise ValueError("shards aren't numbered from 0, or have gaps")
            if self._there(fs, f"{inner}/manifest.json"):
                if not self.overwrite:
                    raise FileExistsError(f"{self.path} has a manifest")
                fs.delete_file(f"{inner}/manifest.json")
            entries = []
            for s in found:
                name = f"{self.prefix}_{s['shard']:05d}.bin"
                fs.move(f"{inner}/{self.staging}/{s['draft']}", f"{inner}/{name}")
                entries.append({"file": name, "num_tokens": s["num_tokens"], "start_offset": s["start_offset"]})
            manifest = {"dtype": self.dtype, "total_tokens": sum(s["num_tokens"] for s in found), "shard_size": found[0]["num_tokens"], "num_shards": len(found), "shards": entries}
            with fs.open_output_stream(f"{inner}/{self.staging}/manifest") as f:
                f.write(json.dumps(manifest).encode())
            fs.move(f"{inner}/{self.staging}/manifest", f"{inner}/manifest.json")
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        fs, inner = file_system(self.path)
        if self._there(fs, f"{inner}/{self.staging}"):
            fs.delete_dir(f"{inner}/{self.staging}")

    @staticmethod
    def _there(fs, path: str) -> bool:
        from pyarrow.fs import FileType

        return fs.get_file_info(path).type != FileType.NotFound


class TokenShards(DataSource):
    """Options: path; for writing dtype (uint16 or uint32) and prefix (of the files' names)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("dtype", "uint16"), self.options.get("prefix", "shard"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, lets conditions reach it, and bounds the batches in which shards go to its writer."""
    bound_batches(spark)
    spark.dataSource.register(TokenShards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def slices(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """The rows of ranges (start and stop of each, and any other columns) with `tokens`, those from start up to stop of the packed array, in one job.

    All shards but the last are of one size, so a range knows which it overlaps; ranges meet shards by their number, and a range's pieces are joined in
    their order. Ranges beyond the array are cut to it, and empty ones have no tokens. Equal ranges are read one by one.
    """
    register(spark)
    manifest = load_manifest(path)
    size, total, last = manifest["shard_size"], manifest["total_tokens"], manifest["num_shards"] - 1
    row, shard = "_range", "_shard"
    numbered = ranges.withColumn(row, F.monotonically_increasing_id())
    low, high = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("stop"), F.lit(total))
    numbered = stored(numbered)
    wanted = numbered.where(low < high).select(row, low.alias("_low"), high.alias("_high")).withColumn(shard, F.explode(F.sequence(F.floor(F.col("_low") / size), F.least(F.lit(last).cast("long"), F.floor((F.col("_high") - 1) / size)))))
    read = spark.read.format("token_shards").load(path)
    met = wanted.join(read, F.col(shard) == F.col("shard"))
    begin, end = F.greatest("_low", "start_offset"), F.least(F.col("_high"), F.col("start_offset") + F.size("tokens"))
    piece = F.slice("tokens", (begin - F.col("start_offset") + 1).cast("int"), (end - begin).cast("int"))
    pieces = met.select(row, "start_offset", piece.alias("_piece")).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("start_offset", "_piece"))).alias("_pieces"))
    tokens = F.flatten(F.transform(F.coalesce("_pieces", F.array()), lambda x: x["_piece"]))
    return numbered.join(pieces, row, "left").select(*ranges.columns, tokens.cast("array<long>").alias("tokens"))
