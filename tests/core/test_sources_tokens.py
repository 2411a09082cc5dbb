import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexweave.operators import pack, tokenizer
from lexweave.plans import corpus
from lexweave.sources import collect, sinks


def test_collect_directory(spark, tmp_path):
    (tmp_path / "b.txt").write_text("  second\r\nline ")
    (tmp_path / "a.txt").write_text("   ")
    (tmp_path / "c.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "d.md").write_text("no")
    rows = collect.collect_directory(spark, str(tmp_path), source_name="my data").orderBy("pos").collect()
    assert [(r.pos, r.text) for r in rows] == [(1, "second\nline"), (2, "café")]
    assert rows[0].id == "my_data-00000001-" + hashlib.sha256(b"second\nline").hexdigest()[:16]
    with pytest.raises(NotADirectoryError):
        collect.collect_directory(spark, str(tmp_path / "absent"))


def test_collect_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"body": " one "}\n\n{"body": ""}\n{"body": null}\n{"body": "two", "more": 1}\n')
    path = str(tmp_path / "x.jsonl")
    assert [(r.pos, r.text) for r in collect.collect_jsonl(spark, path, "body").orderBy("pos").collect()] == [(0, "one"), (3, "two")]
    assert collect.collect_jsonl(spark, path, "body", null_text=True).where("text = 'None'").count() == 1
    with pytest.raises(KeyError):
        collect.collect_jsonl(spark, path, "text").count()
    (tmp_path / "bad.jsonl").write_text('{"body": 1}\nnot json\n')
    with pytest.raises(ValueError):
        collect.collect_jsonl(spark, str(tmp_path / "bad.jsonl"), "body").count()
    (tmp_path / "x.tsv").write_text('title\tbody\na\t"x ""q""\ny"\nb\t\n')
    assert [r.text for r in collect.collect_csv(spark, str(tmp_path / "x.tsv"), "body", "\t").collect()] == ['x "q"\ny']
    with pytest.raises(ValueError):
        collect.collect_csv(spark, str(tmp_path / "x.tsv"), "absent", "\t")


def test_pairs_and_prepared(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt": "a", "response": "b"}\n')
    (tmp_path / "q.jsonl").write_text('{"prompt": "a", "response": " "}\n')
    assert collect.read_pairs(spark, str(tmp_path / "p.jsonl")).count() == 1
    with pytest.raises(ValueError):
        collect.read_pairs(spark, str(tmp_path / "q.jsonl"))
    (tmp_path / "r.jsonl").write_text('{"input_ids": [1, 2], "labels": [1]}\n')
    with pytest.raises(ValueError):
        collect.read_prepared(spark, str(tmp_path / "r.jsonl"))


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("1", "é", None), ("2", "b", "s")], "id string, text string, source string")
    sinks.write_jsonl(d, str(tmp_path / "out"))
    assert sorted(json.loads(x)["text"] for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()) == ["b", "é"]
    with pytest.raises(ValueError):
        sinks.write_jsonl(d.limit(0), str(tmp_path / "none"))
    sinks.write_splits(d.withColumn("split", F.lit("train")), str(tmp_path / "splits"))
    assert [p.name for p in (tmp_path / "splits").glob("split=*")] == ["split=train"]
    w = spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, bytes binary")
    sinks.export_manifest(w, str(tmp_path / "w"))
    assert sinks.import_weights(spark, str(tmp_path / "w")).count() == 2


def test_shards_and_blocks(spark, tmp_path):
    lengths = [7, 0, 30, 1, 12]
    data, at = [], 0
    for i, n in enumerate(lengths):
        data.append((i, list(range(at, at + n))))
        at += n
    d = spark.createDataFrame(data, "pos long, tokens array<int>")
    shards = pack.shards(d, 20)
    assert [(r.shard, r.start_offset, r.tokens) for r in shards.orderBy("shard").collect()] == [(0, 0, list(range(20))), (1, 20, list(range(20, 40))), (2, 40, list(range(40, 50)))]
    assert [r.num_tokens for r in pack.manifest(d, 20).orderBy("start_offset").collect()] == [20, 20, 10]
    for size, stride in ((10, 10), (4, 3), (50, 1), (7, 20)):
        got = pack.blocks(d, size, stride).orderBy("block").collect()
        assert [r.input_ids for r in got] == [list(range(s, s + size)) for s in range(0, 50 - size + 1, stride)] and all(r.labels == r.input_ids for r in got)
    for bad in ((51, None), (0, None), (5, 0)):
        with pytest.raises(ValueError):
            pack.blocks(d, *bad)
    assert pack.read_range(shards, 15, 45).first().tokens == list(range(15, 45))
    made = sinks.write_shards(shards, str(tmp_path / "bin"))
    assert made["total_tokens"] == 50 and sinks.load_manifest(spark, str(tmp_path / "bin"))["num_shards"] == 3
    assert sum((r.tokens for r in sinks.read_shards(spark, str(tmp_path / "bin")).orderBy("start_offset").collect()), []) == list(range(50))
    (tmp_path / "bin" / "shard_00001.bin").unlink()
    with pytest.raises(ValueError):
        sinks.load_manifest(spark, str(tmp_path / "bin"))
    assert (pack.token_width(1 << 16), pack.token_width((1 << 16) + 1)) == ("uint16", "uint32")


@pytest.fixture(scope="module")
def spec(spark):
    lines = ["The quick brown fox jumps over the lazy dog.", "Numbers 123 and symbols !?", "日本語 and émoji 😀"] * 20
    return tokenizer.train(spark.createDataFrame([(x,) for x in lines], "text string"), 320)


def test_tokenizer(spark, spec, tmp_path):
    from tokenizers import Tokenizer

    assert tokenizer.validate(spec) <= 320
    some = ["The quick fox", "unseen ünïcode 漢字 \n\t", "", None, "it's 42"]
    d = spark.createDataFrame(list(enumerate(some)), "pos long, text string")
    out = d.select("pos", "text", tokenizer.encode(F.col("text"), spec).alias("ids")).withColumn("back", tokenizer.decode(F.col("ids"), spec)).orderBy("pos").collect()
    library = Tokenizer.from_str(spec)
    for r in out:
        assert r.ids == (None if r.text is None else library.encode(r.text).ids) and r.back == r.text
    ends = d.select(tokenizer.encode(F.col("text"), spec, bos=True, eos=True).alias("ids")).where("ids IS NOT NULL").first().ids
    assert ends[0] == tokenizer.BOS and ends[-1] == tokenizer.EOS
    tokenizer.artefacts(spec, str(tmp_path))
    assert (tmp_path / "merges.txt").read_text().startswith("#version") and tokenizer.vocabulary(spark, spec).count() == tokenizer.validate(spec)
    broken = json.loads(spec)
    broken["model"]["vocab"]["<pad>"] = 9
    with pytest.raises(ValueError):
        tokenizer.validate(json.dumps(broken))


def test_pretokens_equal_the_library(spark, sf):
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False)
    letters = {c: b for b, c in enumerate(tokenizer.byte_letters())}
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(40).select("text", tokenizer.pretokens(F.col("text")).alias("p")).collect()
    for r in rows:
        assert r.p == [bytes(letters[c] for c in x).decode() for x, _ in split.pre_tokenize_str(r.text)]


def test_corpus_end_to_end(spark, spec, tmp_path):
    for i, t in enumerate(["alpha", "beta", "gamma", "alpha", "delta"]):
        (tmp_path / f"{i}.txt").write_text(f"Document {t} has a number of plain words that make it long enough to keep here.")
    config = corpus.CorpusConfig.of({"collect": {"input_path": str(tmp_path)}, "deduplicate": {"run_near_dedup": False}, "split": {"train": 0.5, "validation": 0.25, "test": 0.25, "seed": 3}})
    out = corpus.prepare(corpus.collected(spark, config.collect), config)
    rows = out.collect()
    assert len(rows) == 4 and sorted(r.split for r in rows) == ["test", "train", "train", "validation"]
    made = corpus.tokenize_and_shard(out, spec, str(tmp_path / "shards"), corpus.TokenOptions(shard_size=10))
    assert set(made) == {"train", "validation", "test"} and all(m["num_shards"] > 1 for m in made.values())
    with pytest.raises(ValueError):
        corpus.CorpusConfig.of({"clean": {"nonsense": 1}})
    with pytest.raises(ValueError):
        corpus.prepare(out, config, ("polish",))
    (tmp_path / "c.json").write_text("{}")
    assert corpus.main(["prepare", "--config", str(tmp_path / "c.json"), "--output", "x", "--dry-run"]) == 0
