import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.sources import token_shards


@pytest.fixture
def written(spark, tmp_path):
    token_shards.register(spark)
    rows = [(k, k * 20, list(range(k * 20, min(50, k * 20 + 20)))) for k in range(3)]
    df = spark.createDataFrame(rows, token_shards.SCHEMA).repartition(3)
    df.write.format("token_shards").mode("append").save(str(tmp_path / "bin"))
    return str(tmp_path / "bin"), df


def test_written_and_read_back(spark, written):
    path, df = written
    back = spark.read.format("token_shards").load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert token_shards.load_manifest(path) == {"dtype": "uint16", "total_tokens": 50, "shard_size": 20, "num_shards": 3, "shards": [{"file": f"shard_{k:05d}.bin", "num_tokens": min(20, 50 - k * 20), "start_offset": k * 20} for k in range(3)]}
    assert np.fromfile(f"{path}/shard_00001.bin", dtype="<u2").tolist() == list(range(20, 40))
    some = back.where("start_offset >= 20 AND shard < 2")
    assert [r.shard for r in some.collect()] == [1] and some.rdd.getNumPartitions() == 1
    assert back.where("shard = 7").collect() == []


def test_a_failed_write_leaves_nothing(spark, written, tmp_path):
    path, df = written
    files = lambda p: sorted(x.name for x in p.iterdir()) if p.exists() else []
    before = files(tmp_path / "bin")
    with pytest.raises(Exception, match="has a manifest"):
        df.write.format("token_shards").mode("append").save(path)
    assert files(tmp_path / "bin") == before and spark.read.format("token_shards").load(path).count() == 3
    wide = df.withColumn("tokens", F.array(F.lit(70_000)))
    with pytest.raises(Exception, match="uint16"):
        wide.write.format("token_shards").mode("append").save(str(tmp_path / "wide"))
    with pytest.raises(Exception, match="gaps"):
        df.where("shard <> 1").write.format("token_shards").mode("append").save(str(tmp_path / "gaps"))
    with pytest.raises(Exception, match="no tokens"):
        df.limit(0).write.format("token_shards").mode("append").save(str(tmp_path / "none"))
    assert [files(tmp_path / n) for n in ("wide", "gaps", "none")] == [[], [], []]
    with pytest.raises(Exception, match="unknown dtype"):
        df.write.format("token_shards").option("dtype", "int8").mode("append").save(str(tmp_path / "x"))


def test_overwrite_and_damage(spark, written, tmp_path):
    path, df = written
    df.where("shard < 2").write.format("token_shards").option("dtype", "uint32").mode("overwrite").save(path)
    assert token_shards.load_manifest(path)["total_tokens"] == 40 and spark.read.format("token_shards").load(path).count() == 2
    (tmp_path / "bin" / "shard_00001.bin").write_bytes(b"\0\0\0\0")
    with pytest.raises(Exception, match="the manifest says"):
        spark.read.format("token_shards").load(path).collect()
    (tmp_path / "bin" / "manifest.json").write_text(json.dumps({"dtype": "uint16"}))
    with pytest.raises(Exception, match="manifest lacks"):
        spark.read.format("token_shards").load(path).collect()


def test_many_ranges_in_one_job(spark, written):
    path, _ = written
    ranges = [(k, a, b, "x") for k, (a, b) in enumerate([(0, 50), (19, 21), (5, 5), (40, 90), (-3, 2), (49, 50), (60, 70), (19, 21), (0, 20), (39, 41)])]
    df = spark.createDataFrame(ranges, "k int, start long, stop long, shard string")
    out = token_shards.slices(spark, path, df)
    assert out.columns == ["k", "start", "stop", "shard", "tokens"]
    assert sorted((r.k, r.tokens) for r in out.collect()) == [(k, list(range(max(0, a), min(50, b)))) for k, a, b, _ in ranges]
