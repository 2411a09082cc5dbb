import hashlib

import pytest
from pyspark.sql import functions as F

from lexweave.llm import sharding
from lexweave.llm.common import scratch, table
from tests.llm.cases import empty, frame, key


def rows(df):
    return key(tuple(r) for r in df.collect())


def test_append_compact_read(spark, sf):
    docs = table(spark, sf, "documents")
    store = sharding.ShardStore(spark, scratch(spark, "store"), target=1 << 20, smallest=1 << 14)
    version = store.append_each(docs.repartition(4), F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    assert version == 5 and rows(store.read()) == rows(docs)
    before = store.shards()
    assert len(before) == 20 and sum(s.rows for s in before) == docs.count()
    old = rows(store.read(2))
    last = store.compact()
    after = store.shards()
    assert last > version and len(after) < len(before) and rows(store.read()) == rows(docs)
    assert all(len([s for s in after if store.tier(s.size) == t]) < store.fanout for t in range(10))
    assert rows(store.read(2)) == old  # older versions stand until they expire
    assert store.expire() > 0 and rows(store.read()) == rows(docs) and store.version() == last
    store.append(docs.limit(7))
    assert store.read().count() == docs.count() + 7
    got = sharding.ledger(store).collect()
    by = store.shards()
    assert len(got) == docs.count() + 7 and all(r.shard_rows == by[r.shard].rows and r.shard_bytes == by[r.shard].size for r in got)
    assert {k: sum(r.shard == k for r in got) for k in range(len(by))} == {k: s.rows for k, s in enumerate(by)}
    assert key((r.doc_id, r.text_sha256) for r in got) == key((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in [*docs.collect(), *docs.limit(7).collect()])


def test_ledger_of_arrivals_not_compacted(spark, sf):
    """A task's files have one base name in all arrivals of append_each."""
    docs = table(spark, sf, "documents")
    store = sharding.ShardStore(spark, scratch(spark, "store"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    store.append_each(docs.repartition(2), F.concat(F.lit("a b:%"), part))
    names = [s.file.rsplit("/", 1)[-1] for s in store.shards()]
    assert len(names) == 6 and len(set(names)) == 2
    files = store.shards()
    want = {r.doc_id: r.sha for r in docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).collect()}
    got = sharding.ledger(store).collect()
    assert len(got) == docs.count() and {r.doc_id: r.text_sha256 for r in got} == want
    arrival = {r.doc_id: r.p for r in docs.select("doc_id", part.alias("p")).collect()}
    for r in got:
        assert files[r.shard].file.rsplit("/", 2)[-2].endswith(str(arrival[r.doc_id])) and (r.shard_bytes, r.shard_rows) == (files[r.shard].size, files[r.shard].rows)


def test_edge_rows(spark):
    store = sharding.ShardStore(spark, scratch(spark, "store"), smallest=100, target=1000)
    df = frame(spark)
    store.append(df)
    store.append(empty(spark))
    store.append_each(empty(spark), F.lit(1))
    store.compact()
    assert rows(store.read()) == rows(df)
    fresh = sharding.ShardStore(spark, scratch(spark, "store"))
    assert fresh.read().collect() == [] and fresh.compact() == 0
    fresh.append(empty(spark))
    assert fresh.read().columns == df.columns and sharding.ledger(fresh).count() == 0


def test_two_writers(spark):
    store = sharding.ShardStore(spark, scratch(spark, "store"))
    store.append(spark.range(5))
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(0), "append", None, [])
    assert store.read().count() == 5
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, "x", fanout=1)


def test_tiers_merge_similar_sizes(spark):
    store = sharding.ShardStore(spark, scratch(spark, "store"), target=1000, smallest=10, fanout=3)
    assert [store.tier(s) for s in (1, 10, 11, 30, 31, 90, 91, 270, 500, 501, 5000)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, -1, -1]


def small(spark, name="store"):
    return sharding.ShardStore(spark, scratch(spark, name), target=1 << 20, smallest=1 << 14, fanout=2)


def test_a_commit_between_plan_and_merge(spark, monkeypatch):
    """Another writer compacts, or appends, while a compaction writes: no row is lost or doubled."""
    for other, left in ((lambda s: s.compact(), 4), (lambda s: s.append(spark.range(4, 6)), 6)):
        store = small(spark)
        for k in range(4):
            store.append(spark.range(k, k + 1).coalesce(1))
        write, busy = sharding.ShardStore._write, []

        def slow(self, df, folder):
            write(self, df, folder)
            if not busy:
                busy.append(1)
                other(sharding.ShardStore(spark, store.path, store.target, store.smallest, store.fanout))

        monkeypatch.setattr(sharding.ShardStore, "_write", slow)
        store.compact()
        monkeypatch.setattr(sharding.ShardStore, "_write", write)
        assert sorted(r.id for r in store.read().collect()) == list(range(left))
        assert sum(s.rows for s in store.shards()) == left


def test_appends_retry(spark, monkeypatch):
    store, versions = small(spark), []
    commit = sharding.ShardStore.commit

    def raced(self, base, *args):
        if not versions:
            versions.append(1)
            commit(self, base, "append", None, [])
        return commit(self, base, *args)

    monkeypatch.setattr(sharding.ShardStore, "commit", raced)
    assert store.append(spark.range(3)) == 2 and store.read().count() == 3


def test_columns_of_all_arrivals_stay(spark):
    store = small(spark)
    store.append(spark.createDataFrame([(0, "kept")], "id long, extra string").coalesce(1))
    for k in range(1, 4):
        store.append(spark.range(k, k + 1).coalesce(1))
    store.compact(), store.expire()
    assert rows(store.read()) == [(0, "kept"), (1, None), (2, None), (3, None)] and len(store.shards()) == 1
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "id string"))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1,)], "ID long"))


def test_arrivals_in_the_order_of_their_values(spark):
    store = small(spark)
    df = spark.range(12).select("id", F.lit("u").alias("_arrival"))
    store.append_each(df, F.when(F.col("id") > 0, F.col("id")))
    assert [r[0] for v in range(1, 13) for r in store.read(v).exceptAll(store.read(v - 1) if v > 1 else df.limit(0)).collect()] == list(range(12))
    assert store.read().columns == ["id", "_arrival"] and {r._arrival for r in store.read().collect()} == {"u"}


def test_lists_stay_few(spark, monkeypatch):
    """Lists of a store with many commits; shards of full size are not read by compaction."""
    store = small(spark)
    monkeypatch.setattr(store, "_read", None)
    for k in range(40):
        base = store.manifest()
        store.commit(base, "append", None, [sharding.Shard(f"data/{k}-{full}.parquet", 1 << 20 if full else 100, 1) for full in (0, 1)])
    lists = store.manifest()["lists"]
    assert len(lists) <= 12 and len(store.shards()) == 80
    assert [s.file for s in store.shards()] == [f"data/{k}-{full}.parquet" for full in (1, 0) for k in range(40)]
    seen = []
    load = store._load
    monkeypatch.setattr(store, "_load", lambda name: seen.append(name) or load(name))
    assert sum(map(len, store.plan())) == 40 and not set(seen) & {x["file"] for x in lists if x["full"]}
