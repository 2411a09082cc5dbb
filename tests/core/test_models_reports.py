import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import stored as st
from lexweave.functions.register import register
from lexweave.operators import evaluate, generate, layers, pack, report, sampling, sft, tokenizer
from lexweave.plans import evaluation, settings
from lexweave.sources import checkpoints, collect, sinks
from lexweave.streaming import text_streams


def test_layers_equal_numpy(spark):
    r = np.random.default_rng(1)
    x, rows, bias, weight = r.normal(size=8), r.normal(size=(3, 8)), r.normal(size=3), r.normal(size=8)
    df = spark.createDataFrame([(x.tolist(), rows.tolist(), bias.tolist(), weight.tolist(), 5)], "x array<double>, m array<array<double>>, b array<double>, w array<double>, p int")
    got = df.select(layers.rms_norm(F.col("x"), F.col("w")), layers.silu(F.col("x")), layers.linear(F.col("x"), F.col("m"), F.col("b")), layers.rope(F.col("x"), F.col("p"), 8), layers.swiglu(F.col("x"), F.col("m"), F.col("m"), F.array(*(F.array(*map(F.lit, v)) for v in np.eye(3).tolist())))).first()
    silu = lambda v: v / (1 + np.exp(-v))
    angle = 5 / 10000 ** (2 * (np.arange(8) % 4) / 8)
    turned = x * np.cos(angle) + np.concatenate((-x[4:], x[:4])) * np.sin(angle)
    want = [x / np.sqrt((x * x).mean() + 1e-6) * weight, silu(x), rows @ x + bias, turned, silu(rows @ x) * (rows @ x)]
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))
    for bad in (lambda: layers.rms_norm(F.col("x"), eps=0), lambda: layers.rope(F.col("x"), F.col("p"), 7), lambda: layers.cache_crop(F.col("x"), 0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("window", [None, 3])
def test_attention_equals_numpy(spark, window):
    r = np.random.default_rng(2)
    q, k, v = (r.normal(size=(2, 6, 4)) for _ in range(3))
    df = spark.createDataFrame([(s, p, q[s, p].tolist(), k[s, p].tolist(), v[s, p].tolist()) for s in range(2) for p in range(6)], "seq int, pos int, q array<double>, k array<double>, v array<double>")
    for row in layers.attention(df, window=window).collect():
        low = 0 if window is None else max(0, row.pos - window + 1)
        z = k[row.seq, low : row.pos + 1] @ q[row.seq, row.pos] / 2
        w = np.exp(z - z.max())
        assert np.allclose(row.out, w @ v[row.seq, low : row.pos + 1] / w.sum())


def test_cache(spark):
    df = spark.createDataFrame([([1, 2, 3], [4]), (None, [9])], "c array<int>, n array<int>")
    assert [r[0] for r in df.select(layers.cache_append(F.col("c"), F.col("n"), 2)).collect()] == [[3, 4], [9]]


def _chain(rows):
    """Next token: the last one plus one, up to 9."""
    last = F.element_at("tokens", -1)
    return rows.select("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("token_id"), last.alias("l"), F.size("tokens").alias("n")).select("row_id", "token_id", F.when(F.col("token_id") == F.col("l") + 1, 5.0).otherwise(F.col("n") * 0.0).alias("logit"))


def test_generation(spark):
    prompts = spark.createDataFrame([(0, [3]), (1, [1, 7]), (2, [9])], "row_id long, tokens array<long>")
    got = {r.row_id: r.tokens for r in generate.generate(prompts, _chain, 4, eos=8).collect()}
    assert got == {0: [3, 4, 5, 6, 7], 1: [1, 7, 8], 2: [9, 0, 1, 2, 3]}
    said = {r.row_id: r.tokens for r in generate.answers(prompts, generate.generate(prompts, _chain, 4, eos=8), 8).collect()}
    assert said == {0: [4, 5, 6, 7], 1: [], 2: [0, 1, 2, 3]}
    seen = []
    scorer = lambda rows: seen.append(max(r.n for r in rows.select(F.size("tokens").alias("n")).collect())) or _chain(rows)
    generate.generate(prompts, scorer, 3, max_context=2)
    assert seen == [2, 2, 2]
    drawn = generate.generate(prompts, _chain, 3, greedy=False, seed=4, k=1)
    assert {r.row_id: len(r.tokens) for r in drawn.collect()} == {0: 4, 1: 5, 2: 4}
    for bad in (prompts.limit(0), spark.createDataFrame([(0, [])], "row_id long, tokens array<long>")):
        with pytest.raises(ValueError):
            generate.generate(bad, _chain, 3)


def test_chat_turn(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    encode = lambda c: F.transform(F.split(c, ""), lambda x: F.pmod(F.ascii(x), F.lit(10)).cast("long"))
    out = generate.chat_turn(turns, encode, lambda t: F.concat_ws(" ", F.transform(t, lambda x: x.cast("string"))), _chain, 3, eos=0)
    rows = out.orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in rows] == [(0, "user", "hi"), (1, "assistant", "9")]  # the prompt ends in ":", which is 8 here; 0 ends the answer


def test_benchmark_scoring(spark):
    items = spark.createDataFrame([(0, [5, 6, 7, 8], [[1], [2, 3]], 1), (1, [9], [[4], [4]], 1)], "item_id long, question array<int>, choices array<array<int>>, answer_index int")
    seen = {}

    def scorer(rows):
        for r in rows.collect():
            seen[tuple(r.tokens)] = r.row_id
        return rows.select("row_id", F.posexplode("tokens").alias("pos", "t")).select("row_id", "pos", (F.col("t") * 1.0).alias("logprob"))

    each, total = evaluate.run_benchmark(items, scorer, 4)
    assert set(seen) == {(6, 7, 8, 1), (7, 8, 2, 3), (9, 4)}
    assert {r.item_id: (r.predicted, r.correct) for r in each.collect()} == {0: (1, True), 1: (0, False)}
    assert total.first().asDict() == {"accuracy": 0.5, "n_correct": 1, "n_items": 2}
    assert {(r.item_id, r.choice): r.score for r in evaluate.scored_choices(items, scorer, 4).collect()} == {(0, 0): 1.0, (0, 1): 2.5, (1, 0): 4.0, (1, 1): 4.0}
    for choices in ([[1], []], [[1], [1, 2, 3, 4]]):
        bad = spark.createDataFrame([(0, [5], choices, 0)], items.schema)
        with pytest.raises(ValueError):
            evaluate.scored_choices(bad, scorer, 4)


def test_benchmark_reader_and_results(spark, tmp_path):
    good = [{"question": "q", "choices": ["a", "b"], "answer_index": 1}, {"question": "r", "choices": ["c", "d", "e"], "answer_index": 0}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, good)) + "\n\n")
    items = collect.read_benchmark(spark, str(tmp_path / "b.jsonl"))
    assert [(r.item_id, r.question, r.choices, r.answer_index) for r in items.orderBy("item_id").collect()] == [(0, "q", ["a", "b"], 1), (1, "r", ["c", "d", "e"], 0)]
    (tmp_path / "bad.jsonl").write_text(json.dumps({"question": "q", "choices": ["a"], "answer_index": 0}))
    with pytest.raises(ValueError):
        collect.read_benchmark(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"item_id": i, "choice": c, "pos": 0, "logprob": -float(c)}) for i in range(2) for c in range(2)))
    assert evaluation.main(["benchmark", "--items", str(tmp_path / "b.jsonl"), "--logprobs", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "out")]) == 0
    found = spark.read.json(str(tmp_path / "out")).first()
    assert found.benchmark[0].accuracy == 0.5 and len(found["items"]) == 2
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"batch_id": i, "loss": 1.0 + i, "n_tokens": 3 * i}) for i in range(3)))
    assert evaluation.main(["perplexity", "--batches", str(tmp_path / "l.jsonl"), "--tokens-per-byte", "0.5", "--output", str(tmp_path / "o2")]) == 0
    row = spark.read.json(str(tmp_path / "o2")).first().perplexity[0]
    assert row.loss == pytest.approx(24 / 9) and row.bits_per_byte == pytest.approx(math.log2(math.exp(24 / 9)) * 0.5)
    with pytest.raises(ValueError):
        sinks.write_results({}, str(tmp_path / "o3"))


def test_dry_run(capsys):
    assert evaluation.main(["latency", "--runs", "a", "--output", "b", "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out) == {"command": "latency", "runs": "a", "output": "b"}


def test_latency(spark):
    runs = spark.createDataFrame([("a", 1.0, 10), ("a", 3.0, 30), ("b", 2.0, 5)], "kind string, seconds double, tokens long")
    got = {r.kind: r for r in report.latency(runs, by=("kind",), tokens="tokens").collect()}
    assert (got["a"].mean_latency_s, got["a"].min_latency_s, got["a"].runs, got["a"].tokens_per_sec) == (2.0, 1.0, 2, 10.0)
    assert got["a"].std_latency_s == pytest.approx(math.sqrt(2)) and got["b"].std_latency_s == 0
    both = report.compare(runs.where("kind = 'a'"), runs.where("kind = 'b'"), 400, 100).first()
    assert (both.speedup, both.size_reduction_ratio) == (1.0, 0.25)


def test_sft_dataset(spark, tmp_path):
    pairs = spark.createDataFrame([(0, [5, 6], [7]), (1, [5] * 9, [7]), (2, [8], [9, 9])], "pos long, p array<int>, r array<int>")
    rows = pairs.select("pos", *(c.alias(n) for n, c in sft.sft_example(F.col("p"), F.col("r"), 1, 2, 6).items()))
    assert sft.write_dataset(rows, str(tmp_path / "sft")) == {"total": 3, "kept": 2, "skipped": 1}
    back = collect.read_prepared(spark, str(tmp_path / "sft"))
    assert back.count() == 2
    with pytest.raises(ValueError):
        sft.sft_dataset(rows.where("pos = 1"))
    decode = lambda ids: F.concat_ws(" ", F.transform(ids, lambda i: F.when(i > 1, i.cast("string")).otherwise("")))
    assert [(r.pos, r.prompt) for r in sft.sample_prompts(rows.where("input_ids IS NOT NULL"), decode, 1).collect()] == [(0, " 5 6")]
    assert sft.pad_id(None, 2) == (2, True) and sft.pad_id(0, 2) == (0, False)


def test_epoch_order_is_a_permutation(spark):
    df = spark.range(50).select(F.col("id").alias("pos"))
    one, two = ([r.pos for r in sft.epoch_order(df, 1, e).orderBy("place").collect()] for e in (0, 1))
    assert sorted(one) == sorted(two) == list(range(50)) and one != two != list(range(50))


def test_tokenized_counts(spark):
    df = spark.createDataFrame([(0, "a b", [4, 5]), (1, "　 ", [6]), (2, None, None), (3, "x", [])], "pos long, text string, tokens array<int>")
    rows, counts = pack.tokenized(df, 2)
    assert counts == {"num_processed": 1, "num_skipped": 3, "total_tokens": 3} and [r.tokens for r in rows.collect()] == [[4, 5, 2]]
    with pytest.raises(ValueError):
        pack.tokenized(df.where("pos > 0"), 2)
    with pytest.raises(KeyError):
        pack.tokenized(df.drop("text"), 2)


def test_slices_open_only_what_they_need(spark, tmp_path):
    tokens = spark.createDataFrame([(k, k * 10, list(range(k * 10, k * 10 + 10))) for k in range(4)], "shard int, start_offset long, tokens array<int>")
    sinks.write_shards(tokens, str(tmp_path / "s"))
    part = sinks.read_slice(spark, str(tmp_path / "s"), 15, 25)
    for k in (0, 3):  # a shard that was opened would be missed
        (tmp_path / "s" / f"shard_{k:05d}.bin").unlink()
    assert sorted(r.shard for r in part.collect()) == [1, 2]
    assert pack.read_range(part, 15, 25).first()[0] == list(range(15, 25))
    assert sinks.read_slice(spark, str(tmp_path / "s"), 90, 99).count() == 0


def test_checkpoints(spark, tmp_path):
    at = checkpoints.Folder(spark, str(tmp_path / "c"))
    assert at.latest() is None
    for step in (1, 20, 3, 3):
        at.save(step, 0, {"w": b"\x00\xff", "n": [step]}, {"lr": 0.1}, extra_state={"seen": step}, keep_last=2)
    assert [s for s, _ in at.list()] == [3, 20] and at.latest().endswith("step20.pt")
    state = at.load()
    assert state["model_state"] == {"w": b"\x00\xff", "n": [20]} and state["extra_state"] == {"seen": 20} and state["step"] == 20
    (tmp_path / "c" / "checkpoint_step99.pt").write_text("{")
    with pytest.raises(RuntimeError):
        at.load()
    (tmp_path / "c" / "checkpoint_step99.pt").write_text('{"step": 99}')
    with pytest.raises(ValueError):
        at.load()
    with pytest.raises(FileNotFoundError):
        at.load(str(tmp_path / "c" / "none.pt"))
    with pytest.raises(ValueError):
        at.save(-1, 0, {}, {})
    assert not [p for p in (tmp_path / "c").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


def test_settings(tmp_path):
    m = settings.ModelSettings()
    assert m.intermediate_size == 2048 and m.to_dict()["vocab_size"] == 32_000
    for bad in ({"vocab_size": 0}, {"num_heads": 7}, {"pad_token_id": 32_000}, {"intermediate_size": -1}, {"num_kv_heads": 5}):
        with pytest.raises(ValueError):
            settings.ModelSettings(**bad)
    for bad in ({"max_steps": 0}, {"max_steps": 1, "max_grad_norm": 0}, {"max_steps": 1, "gradient_accumulation_steps": 0}, {"max_steps": 1, "label_smoothing": 1.0}, {"max_steps": 5, "warmup_steps": 6}):
        with pytest.raises(ValueError):
            settings.TrainingSettings(**bad)
    (tmp_path / "m.json").write_text('{"hidden_size": 64, "num_heads": 4}')
    assert settings.read(str(tmp_path / "m.json"), settings.ModelSettings).hidden_size == 64
    (tmp_path / "m.json").write_text('{"hiden_size": 64}')
    with pytest.raises(ValueError):
        settings.read(str(tmp_path / "m.json"), settings.ModelSettings)


def test_tokenizer_lookups(spark, tmp_path):
    spec = tokenizer.train(spark.createDataFrame([(0, "low lower lowest low low")], "pos long, text string"), 270)
    tokenizer.artefacts(spec, str(tmp_path))
    assert tokenizer.load(str(tmp_path)) == tokenizer.load(str(tmp_path / "tokenizer.json")) == spec
    assert tokenizer.token_id(spec, "<eos>") == 2 and tokenizer.token_of(spec, 0) == "<pad>" and tokenizer.token_id(spec, "none") is None
    with pytest.raises(FileNotFoundError):
        tokenizer.load(str(tmp_path / "absent"))


def test_sql_functions(spark):
    assert "lex_jaccard" in register(spark)
    row = spark.sql("SELECT lex_strip('\\u3000a b\\u0085') AS s, lex_normalize(' A\\u2003 b\\n') AS n, lex_words(' ') AS w, lex_jaccard(array('a','b'), array('b')) AS j, lex_jaccard(array(), array()) AS e, lex_perplexity(0D) AS p").first()
    assert tuple(row) == ("a b", "a b", [], 0.5, 1.0, 1.0)


def test_draws_follow_the_softmax(spark):
    logits = spark.range(6000).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("token_id")).withColumn("logit", F.col("token_id").cast("double"))
    share = {r.token_id: r["count"] / 6000 for r in sampling.draw(logits, 11).groupBy("token_id").count().collect()}
    want = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert all(share[k] == pytest.approx(want[k], abs=0.02) for k in range(3))


def test_deduplicated_stream(spark, tmp_path):
    for k, rows in enumerate(([("2024-01-01 00:00:01", "A b"), ("2024-01-01 00:00:02", "a  B")], [("2024-01-01 00:00:03", "c"), ("2024-01-01 00:00:04", "a b")])):
        spark.createDataFrame(rows, "at string, text string").selectExpr("cast(at AS timestamp) AS at", "text").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("at timestamp, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = text_streams.deduplicated(stream, "at", "1 hour").writeStream.format("memory").queryName("kept_texts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.text.lower().replace(" ", "") for r in spark.table("kept_texts").collect()) == ["ab", "c"]


def test_shared_folder_on_a_cluster():
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x:1", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(RuntimeError):
        st.shared_dir(Fake)
