"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and of versioned manifests. Arrivals are appended as they come, as small
shards. Compaction takes the shards of a tier, those of similar size, once there are FANOUT of them, and merges them into
files of the target size, without a shuffle. Every append and every compaction ends with one manifest, put in place by
a rename that fails if another writer has taken the version; readers see a version whole or not at all, and shards that no
manifest names are waste that expire() removes. A lost executor costs its tasks; a lost driver leaves the last version.

A manifest names lists of shards, immutable files too. A commit writes a list of what it adds, not of what there is; shards that
may still be merged stand in lists apart from those of full size, so compaction never reads the latter. Lists are joined
when a newer one has grown to the size of the one before it, which leaves a logarithm of lists.

A writer that loses the race for a version tries the next: an append always can; a compaction if all shards that it
has merged are still named, and else its output is waste.

Any columns are stored, null, empty and very long values and repeated rows as they are. Arrivals may have other columns than
those before: the store has all columns ever stored, null where an arrival lacks them; one name with two types is an error.
An empty arrival adds a version without shards. Sizes are of files as written.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from lexweave.llm.common import fresh, quoted, require

TARGET = 64 << 20
SMALLEST = 1 << 20
FANOUT = 4
ATTEMPTS = 50  #: at a version, before a writer gives up


@dataclass(frozen=True)
class Shard:
    file: str  #: below the store's folder
    size: int
    rows: int


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def merged_schema(one: str | None, two: str | None) -> str | None:
    """All columns of two schemas, those of the first first; ValueError where a name has two types, or two names differ by case alone."""
    if one is None or two is None:
        return one or two
    fields = {f.name.lower(): f for f in StructType.fromJson(json.loads(one))}
    for f in StructType.fromJson(json.loads(two)):
        known = fields.setdefault(f.name.lower(), f)
        if known.name != f.name or known.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"the store has {known.simpleString()}, the arrival {f.simpleString()}")
    return StructType([T.StructField(f.name, f.dataType) for f in fields.values()]).json()


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, smallest: int = SMALLEST, fanout: int = FANOUT):
        if not (0 < smallest <= target and fanout >= 2):
            raise ValueError("sizes must be positive, the smallest at most the target, and the fan-out 2 or more")
        self.spark, self.path, self.target, self.smallest, self.fanout = spark, path.rstrip("/"), target, smallest, fanout
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list:
        at = self._path(name)
        return list(self.fs.listStatus(at)) if self.fs.exists(at) else []

    # manifests

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        found = [s.getPath().getName() for s in self._list("manifests")]
        return max((int(n[1:-5]) for n in found if n.startswith("v") and n.endswith(".json")), default=0)

    def _load(self, name: str):
        stream = self.fs.open(self._path(f"manifests/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, name: str, content) -> None:
        out = self.fs.create(self._path(f"manifests/{name}"), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        """version, action, schema, and lists: file, shards (how many) and whether they are full, of each, in the order of commits."""
        version = self.version() if version is None else version
        return self._load(f"v{version:010d}.json") if version else {"version": 0, "action": "new", "schema": None, "lists": []}

    def _shards(self, lists: Iterable[dict]) -> list[Shard]:
        return [Shard(**s) for x in lists for s in self._load(x["file"])]

    def shards(self, version: int | None = None) -> list[Shard]:
        """All shards of a version in the order of commits: full ones, then those that may still be merged."""
        return self._shards(sorted(self.manifest(version)["lists"], key=lambda x: not x["full"]))

    def _listed(self, shards: list[Shard], full: bool) -> list[dict]:
        if not shards:
            return []
        name = f"list-{uuid.uuid4().hex}.json"
        self._save(name, [asdict(s) for s in shards])
        return [{"file": name, "shards": len(shards), "full": full}]

    def _joined(self, lists: list[dict]) -> list[dict]:
        """The same shards in fewer lists: while the last is as long as the one before it, they become one."""
        while len(lists) > 1 and lists[-1]["shards"] >= lists[-2]["shards"]:
            lists = lists[:-2] + self._listed(self._shards(lists[-2:]), lists[-1]["full"])
        return lists

    def commit(self, base: dict, action: str, schema: str | None, new: list[Shard], gone: Iterable[str] = ()) -> int:
        """Puts the version after a manifest in place, whole, or raises Conflict. gone: files of shards that the version no longer names."""
        version, gone = base["version"] + 1, set(gone)
        full, rest = ([x for x in base["lists"] if x["full"] is k] for k in (True, False))
        if gone:
            kept = [s for s in self._shards(rest) if s.file not in gone]
            if len(kept) + len(gone) != sum(x["shards"] for x in rest):
                raise Conflict("shards that were to be replaced are no longer named")
            rest = self._listed(kept, False)
        full = self._joined(full + self._listed([s for s in new if self.tier(s.size) < 0], True))
        rest = self._joined(rest + self._listed([s for s in new if self.tier(s.size) >= 0], False))
        draft, final = f".draft-{uuid.uuid4().hex}", self._path(f"manifests/v{version:010d}.json")
        self._save(draft, {"version": version, "action": action, "schema": schema, "lists": full + rest})
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(f"manifests/{draft}"), final, options)
        except Exception as e:
            self.fs.delete(self._path(f"manifests/{draft}"), False)
            if self.fs.exists(final):
                raise Conflict(f"version {version} is taken") from e
            raise
        return version

    def _added(self, schema: str | None, new: list[Shard]) -> int:
        """Commits an append on the newest version, again if another writer is faster."""
        for _ in range(ATTEMPTS):
            base = self.manifest()
            try:
                return self.commit(base, "append", merged_schema(base["schema"], schema), new)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} versions were taken by others")

    # writing

    def _written(self, folder: str) -> list[Shard]:
        """The shards of a folder that a job has written. Rows come from the files' footers."""
        files = {s.getPath().getName(): s.getLen() for s in self._list(folder) if s.getPath().getName().endswith(".parquet")}
        if not files:
            return []
        rows = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        count = {r.f: r["count"] for r in rows}
        return [Shard(f"{folder}/{n}", size, count.get(n, 0)) for n, size in sorted(files.items())]

    def _write(self, df: DataFrame, folder: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")

    def append(self, df: DataFrame) -> int:
        """Adds one arrival; its shards are those of df's partitions."""
        schema, folder = df.schema.json(), f"data/{uuid.uuid4().hex}"
        merged_schema(self.manifest()["schema"], schema)  # fails before anything is written
        self._write(df, folder)
        return self._added(schema, [s for s in self._written(folder) if s.rows])

    def append_each(self, df: DataFrame, arrival) -> int:
        """Adds an arrival for each value of a column function, in the values' order (nulls first), a version each; all are written by one job."""
        schema, folder, (name,) = df.schema.json(), f"data/{uuid.uuid4().hex}", fresh(df, "arrival")
        merged_schema(self.manifest()["schema"], schema)
        dealt = df.withColumn(name, arrival)
        dealt.write.option("compression", "zstd").partitionBy(name).parquet(f"{self.path}/{folder}")
        numeric = isinstance(dealt.schema[name].dataType, T.NumericType)

        def order(part: str):
            value = unquote(part.partition("=")[2])
            null = value == "__HIVE_DEFAULT_PARTITION__"
            return (not null, 0 if null else float(value) if numeric else value)

        parts = sorted((s.getPath().getName() for s in self._list(folder) if s.getPath().getName().startswith(name)), key=order)
        for part in parts:
            version = self._added(schema, self._written(f"{folder}/{part}"))
        return version if parts else self._added(schema, [])

    # compaction

    def tier(self, size: int) -> int:
        """0 for sizes up to the smallest; each next tier holds sizes up to `fanout` times larger; -1 for shards of near the target size."""
        if size * 2 > self.target:
            return -1
        return max(0, math.ceil(math.log(size / self.smallest, self.fanout))) if size > self.smallest else 0

    def plan(self, base: dict | None = None) -> list[list[Shard]]:
        """The groups of a version's shards that a compaction merges, the smallest tier first."""
        tiers: dict[int, list[Shard]] = {}
        for s in self._shards(x for x in (base or self.manifest())["lists"] if not x["full"]):
            tiers.setdefault(self.tier(s.size), []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout]

    def compact(self) -> int:
        """Merges until no tier has enough shards; each group merged is a version. Returns the version then current."""
        for _ in range(ATTEMPTS):
            base = self.manifest()
            group = next(iter(self.plan(base)), [])
            files = max(1, round(sum(s.size for s in group) / self.target))
            if files >= len(group):
                return self.version()
            folder = f"data/{uuid.uuid4().hex}"
            self._write(self._read(group, base["schema"]).coalesce(files), folder)
            new = self._written(folder)
            if sum(s.rows for s in new) != sum(s.rows for s in group):
                raise RuntimeError("a compaction changed the number of rows")
            self._replaced(base, group, new)
        raise Conflict(f"{ATTEMPTS} compactions in a row")

    def _replaced(self, base: dict, group: list[Shard], new: list[Shard]) -> bool:
        """Commits a merged group. After a lost race the newest version takes it if that still names the whole group and has no more columns."""
        schema = base["schema"]
        for _ in range(ATTEMPTS):
            try:
                self.commit(base, "compact", schema, new, {s.file for s in group})
                return True
            except Conflict:
                base = self.manifest()
                named = {s.file for s in self._shards(x for x in base["lists"] if not x["full"])}
                if base["schema"] != schema or not all(s.file in named for s in group):
                    return False
        return False

    def expire(self) -> int:
        """Deletes files that the current version doesn't name: shards, lists and older manifests. Not while others read or write. Returns how many went."""
        current = self.version()
        manifest, gone = self.manifest(current), 0
        kept = {x["file"] for x in manifest["lists"]} | {f"v{current:010d}.json"}
        for s in self._list("manifests"):
            if s.getPath().getName() not in kept:
                gone += bool(self.fs.delete(s.getPath(), False))
        named = {s.file for s in self.shards(current)}
        top = self.fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        for folder in self._list("data"):
            stack, some = [folder.getPath()], False
            while stack:
                for s in self.fs.listStatus(stack.pop()):
                    if s.isDirectory():
                        stack.append(s.getPath())
                    elif s.getPath().toUri().getPath().removeprefix(top) in named:
                        some = True
                    else:
                        gone += bool(self.fs.delete(s.getPath(), False))
            if not some:
                self.fs.delete(folder.getPath(), True)
        return gone

    # reading

    def _read(self, shards: list[Shard], schema: str | None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType([])
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{s.file}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the column `_metadata` of file sources."""
        version = self.version() if version is None else version
        return self._read(self.shards(version), self.manifest(version)["schema"])


def ledger(store: ShardStore, id_col: str = "doc_id", text_col: str = "text", version: int | None = None) -> DataFrame:
    """id_col, shard, shard_bytes, shard_rows, text_sha256 of each stored row, as read back from a version. Shards are numbered in the order of commits."""
    version = store.version() if version is None else version
    shards, stored = store.shards(version), store.read(version)
    require(stored, id_col, text_col)
    # base names repeat among the arrivals of one job, paths below the store's data folder don't
    below = [(store._path(s.file).toUri().toString().rsplit("/data/", 1)[-1], k, s.size, s.rows) for k, s in enumerate(shards)]
    entries = store.spark.createDataFrame(below, "_file string, shard long, shard_bytes long, shard_rows long")
    file = F.substring_index(F.col("_metadata.file_path"), "/data/", -1) if shards else F.lit(None).cast("string")
    rows = stored.select(quoted(id_col).alias("_id"), file.alias("_file"), F.sha2(F.coalesce(quoted(text_col), F.lit("")), 256).alias("text_sha256"))
    return rows.join(entries, "_file").select(F.col("_id").alias(id_col), "shard", "shard_bytes", "shard_rows", "text_sha256")
