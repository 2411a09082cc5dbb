import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.operators import evaluate, quantize, sampling, schedule, sft


def logits(spark, *rows):
    return spark.createDataFrame([(i, k, float(x)) for i, r in enumerate(rows) for k, x in enumerate(r)], "row_id long, token_id long, logit double")


def left(df):
    return sorted((r.row_id, r.token_id) for r in df.collect())


def test_sampling_filters(spark):
    x = logits(spark, [1, 5, 3, 2], [10, -10, -10, -10], [4, 4, 4, 1])
    assert left(sampling.top_k(x, 2)) == [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]
    assert left(sampling.top_k(x, 0)) == left(x) and left(sampling.top_p(x, 1.0)) == left(x)
    assert left(sampling.top_p(x, 0.01)) == [(0, 1), (1, 0), (2, 0)]
    seen = x.where("token_id < 2").select("row_id", "token_id")
    got = {(r.row_id, r.token_id): r.logit for r in sampling.repetition_penalty(x, seen.union(seen), 2.0).collect()}
    assert got[0, 1] == 2.5 and got[1, 1] == -20 and got[0, 2] == 3
    assert {r.row_id: r.token_id for r in sampling.sample(x, is_greedy=True).collect()} == {0: 1, 1: 0, 2: 0}
    for bad in (lambda: sampling.temperature(x, 0), lambda: sampling.repetition_penalty(x, seen, 0)):
        with pytest.raises(ValueError):
            bad()


def test_draws_follow_the_softmax(spark):
    x = spark.range(4000).select(F.col("id").alias("row_id"), F.explode(F.array(F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("l")), F.struct(F.lit(1).alias("t"), F.lit(math.log(3)).alias("l")))).alias("x")).select("row_id", F.col("x.t").cast("long").alias("token_id"), F.col("x.l").alias("logit"))
    n = Counter(r.token_id for r in sampling.draw(x, 5).collect())
    assert 0.72 < n[1] / 4000 < 0.78


def test_losses(spark):
    x = logits(spark, [1, 2, 3], [0, 0, 0], [5, 1, 1])
    labels = spark.createDataFrame([(0, 2), (1, 1), (2, -100)], "row_id long, label long")
    got = {r.row_id: r.loss for r in evaluate.token_losses(x, labels).collect()}
    z = math.log(sum(map(math.exp, [1, 2, 3])))
    assert got[0] == pytest.approx(z - 3) and got[1] == pytest.approx(math.log(3)) and set(got) == {0, 1}
    smooth = {r.row_id: r.loss for r in evaluate.token_losses(x, labels, 0.1).collect()}
    assert smooth[0] == pytest.approx(0.9 * (z - 3) + 0.1 * (z - 2))


def test_corpus_metrics(spark):
    b = spark.createDataFrame([(0, 1.0, 10), (1, 3.0, 30), (2, 99.0, 0)], "batch_id long, loss double, n_tokens long")
    assert evaluate.corpus_perplexity(b).first().loss == pytest.approx(2.5)
    assert evaluate.corpus_perplexity(b, 1).first().perplexity == pytest.approx(math.e)
    assert spark.range(1).select(evaluate.perplexity(F.lit(25.0))).first()[0] == pytest.approx(math.exp(20))
    assert evaluate.bits_per_byte(8, 0.5) == pytest.approx(1.5)
    for bad in (lambda: evaluate.bits_per_byte(0, 1), lambda: evaluate.corpus_perplexity(b, 0)):
        with pytest.raises(ValueError):
            bad()


def test_choices(spark):
    lp = spark.createDataFrame([(0, 0, 0, -1.0), (0, 1, 0, -2.0), (0, 1, 1, 0.0), (1, 0, 0, -3.0), (1, 1, 0, -1.0)], "item_id long, choice long, pos long, logprob double")
    picked = evaluate.choose(evaluate.choice_scores(lp))
    assert {r.item_id: r.predicted for r in picked.collect()} == {0: 0, 1: 1}
    answers = spark.createDataFrame([(0, 1), (1, 1)], "item_id long, answer_index long")
    assert evaluate.accuracy(picked, answers).first().accuracy == 0.5
    items = spark.createDataFrame([("q", ["a", "b"], 1)], "question string, choices array<string>, answer_index int")
    assert evaluate.check_items(items).count() == 1
    with pytest.raises(ValueError):
        evaluate.check_items(items.withColumn("answer_index", F.lit(2)))
    row = spark.range(1).select(evaluate.fit_context(F.array(*map(F.lit, range(10))), F.array(F.lit(1), F.lit(2)), 5).alias("x")).first()
    assert row.x == [7, 8, 9]


def test_sft(spark):
    d = spark.createDataFrame([([5, 6, 7], [8, 9])], "p array<int>, r array<int>")
    one = lambda c: d.select(**c) if False else d.select(*(v.alias(k) for k, v in c.items())).first()
    assert one(sft.sft_example(F.col("p"), F.col("r"), 1, 2, 64)).asDict() == {"input_ids": [1, 5, 6, 7, 8, 9, 2], "labels": [-100] * 4 + [8, 9, 2]}
    assert one(sft.sft_example(F.col("p"), F.col("r"), 1, 2, 5)).labels == [-100] * 4 + [8] and one(sft.sft_example(F.col("p"), F.col("r"), 1, 2, 4)).input_ids is None
    assert one(sft.instruction_example(F.col("p"), F.col("r"), 2, 4)).asDict() == {"input_ids": [5, 6, 7, 8], "labels": [-100] * 3 + [8], "attention_mask": [1] * 4}
    assert one(sft.instruction_example(F.col("p"), F.col("r"), 2, 2)).labels == [-100, -100]
    assert d.select(sft.until_eos(F.col("p"), 6).alias("x"), sft.recovered_prompt(F.col("p"), F.array(F.lit(-100), F.lit(1), F.lit(-100))).alias("y")).first() == ([5], [5, 7])


def test_prompts_and_padding(spark):
    d = spark.createDataFrame([(" do ", None), ("do", " this ")], "i string, x string")
    assert [r[0] for r in d.select(sft.instruction_prompt(F.col("i"), F.col("x"))).collect()] == ["### Instruction:\ndo\n\n### Response:\n", "### Instruction:\ndo\n\n### Input:\nthis\n\n### Response:\n"]
    with pytest.raises(ValueError):
        sft.fill("no place", instruction=F.lit("x"))
    turns = spark.createDataFrame([(1, 1, "assistant", "yo"), (1, 0, "user", "hi"), (1, 2, "system", "s")], "conv_id long, turn long, role string, text string")
    assert sft.chat_transcripts(turns).first().prompt == "User: hi\nAssistant: yo\nAssistant: s\nAssistant:"
    rows = spark.createDataFrame([(i, [1] * n, [1] * n) for i, n in enumerate((3, 1, 2))], "pos long, input_ids array<int>, labels array<int>")
    got = sft.pad_batches(rows, 2).orderBy("pos").collect()
    assert [r.input_ids for r in got] == [[1, 1, 1], [1, 0, 0], [1, 1]] and got[1].labels == [1, -100, -100] and got[1].attention_mask == [1, 0, 0]
    assert sft.pad_batches(rows, 2, drop_last=True).count() == 2


def test_quantize(spark):
    d = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0, 0.0],)], "w array<float>").withColumn("s", quantize.scale(F.col("w"))).withColumn("q", quantize.quantize(F.col("w"), F.col("s")))
    rows = d.withColumn("b", quantize.dequantize(F.col("q"), F.col("s"))).collect()
    assert rows[0].q == [64, -127, 32] and rows[1].q == [0, 0, 0] and max(abs(a - b) for a, b in zip(rows[0].b, rows[0].w, strict=True)) < 0.05
    assert d.select(quantize.linear(F.col("q"), F.col("s"), F.col("w"), F.lit(1.0))).first()[0] == pytest.approx(2.3125, abs=0.01)
    layers = spark.createDataFrame([("a.ffn", 0, [1.0]), ("lm_head", 0, [1.0])], "layer string, row long, weight array<float>")
    assert [r.codes for r in quantize.quantize_layers(layers, ("lm_head",)).orderBy("layer").collect()] == [[127], None]
    assert quantize.parameter_count(quantize.parameter_catalogue(spark)).first()[0] == 109_529_856 and quantize.swiglu_width(768) == 2048


def test_schedule_and_checkpoints(spark):
    lr = [r.lr for r in schedule.schedule(spark, 10, 100).orderBy("step").collect()]
    assert lr[0] == pytest.approx(0.1) and lr[9] == 1 and lr[10] == 1 and lr[99] == pytest.approx(0.1, abs=0.01) and max(lr) == 1
    with pytest.raises(ValueError):
        schedule.multiplier(F.lit(1), 10, 5)
    c = spark.createDataFrame([(1, f"d/checkpoint_step{s}.pt") for s in (5, 10, 100, 20)] + [(1, "d/x.pt")], "run long, path string")
    assert sorted(r.step for r in schedule.to_prune(c, 2).collect()) == [5, 10] and schedule.latest(c).first().path == "d/checkpoint_step100.pt"


def test_digest_in_levels(spark):
    from hashlib import sha256

    rows = [(f"layer{k}", bytes([k % 7]) * k) for k in range(50)]
    df = spark.createDataFrame(rows, "key string, bytes binary").repartition(4)
    for fan_in in (4096, 7, 2):
        level = [sha256(f"{k}:{sha256(b).hexdigest()}".encode()).hexdigest() for k, b in sorted(rows)]
        while True:
            level = [sha256("\n".join(level[i : i + fan_in]).encode()).hexdigest() for i in range(0, len(level), fan_in)]
            if len(level) == 1:
                break
        assert quantize.checksum(df, fan_in).first()[0] == level[0]
    assert quantize.checksum(df.limit(0)).first()[0] == sha256(b"").hexdigest()


def test_synthetic_corpus(spark):
    from lexweave.sources import collect

    sentences = ["one", "two", "three"]
    rows = collect.synthetic_corpus(spark, sentences, 40, seed=9).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(120)) and all(sorted(x.text for x in rows[k * 3 : k * 3 + 3]) == sorted(sentences) for k in range(40))
    assert len({tuple(x.text for x in rows[k * 3 : k * 3 + 3]) for k in range(40)}) > 1
