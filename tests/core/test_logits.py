import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import evaluate, logits, sampling


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    data = [(i, [r.choice([r.uniform(-9, 9), 4.0, -1e9, 0.0]) for _ in range(40)], r.choice([None, -100, r.randrange(40)]), [r.randrange(45) for _ in range(r.randrange(6))]) for i in range(60)]
    return spark.createDataFrame(data, "row_id long, x array<double>, label int, seen array<int>")


def long(rows, column="x"):
    return rows.select("row_id", F.posexplode(column).alias("token_id", "logit")).where("logit IS NOT NULL").withColumn("token_id", F.col("token_id").cast("long"))


def left(df):
    return sorted((r.row_id, r.token_id, r.logit) for r in df.select("row_id", "token_id", "logit").collect())


def same(kernel, rows, want):
    made = rows.select("row_id", kernel.alias("y"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got, want = left(long(made, "y")), left(want)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_filters_equal_those_in_long_form(rows):
    x = long(rows)
    for k in (0, 1, 3, 40, 99):
        same(logits.top_k(F.col("x"), k), rows, sampling.top_k(x, k))
    for p in (0.01, 0.5, 0.95, 1.0):
        same(logits.top_p(F.col("x"), p), rows, sampling.top_p(x, p))
    seen = rows.select("row_id", F.explode("seen").alias("token_id"))
    same(logits.repetition_penalty(F.col("x"), F.col("seen"), 1.7), rows, sampling.repetition_penalty(x, seen, 1.7))
    same(logits.temperature(F.col("x"), 0.3), rows, sampling.temperature(x, 0.3))
    same(logits.top_p(logits.top_k(F.col("x"), 7), 0.6), rows, sampling.top_p(sampling.top_k(x, 7), 0.6))


def test_draws_and_losses_equal_those_in_long_form(rows):
    x, seen = long(rows), rows.select("row_id", F.explode("seen").alias("token_id"))
    options = {"penalty": 1.3, "t": 0.8, "k": 9, "p": 0.9, "seed": 4}
    got = {r.row_id: r.y for r in rows.select("row_id", logits.sample(F.col("x"), F.col("row_id"), F.col("seen"), **options).alias("y")).collect()}
    assert got == {r.row_id: r.token_id for r in sampling.sample(x, seen, **options).collect()}
    got = {r.row_id: r.y for r in rows.select("row_id", logits.sample(F.col("x"), F.col("row_id"), is_greedy=True).alias("y")).collect()}
    assert got == {r.row_id: r.token_id for r in sampling.greedy(x).collect()}
    for smoothing in (0.0, 0.1):
        want = {r.row_id: r.loss for r in evaluate.token_losses(x, rows.select("row_id", "label"), smoothing).collect()}
        got = {r.row_id: r.y for r in rows.select("row_id", logits.loss(F.col("x"), F.col("label"), smoothing).alias("y")).collect() if r.y is not None}
        assert got == pytest.approx(want)
    z = {r.row_id: r.z for r in rows.select("row_id", logits.log_sum_exp(F.col("x")).alias("z")).collect()}
    assert z == pytest.approx({r.row_id: float(np.logaddexp.reduce(r.x)) for r in rows.collect()})


def test_edge_arrays(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [None, None]), (3, [None, 2.0, 2.0]), (4, [1.0])], "row_id int, x array<double>").coalesce(1).orderBy("row_id")
    x, one = F.col("x"), lambda c: [r.y for r in df.select("row_id", c.alias("y")).orderBy("row_id").collect()]
    assert one(logits.top_k(x, 1)) == [None, None, None, [None, 2.0, 2.0], [1.0]]
    assert one(logits.greedy(x)) == [None, None, None, 1, 0]
    assert one(logits.top_p(x, 0.0)) == [None, None, None, [None, 2.0, None], [1.0]]
    assert one(logits.log_sum_exp(x))[:3] == [None] * 3
    for bad in (lambda: logits.temperature(x, 0), lambda: logits.sample(x, F.col("row_id"), t=0), lambda: logits.loss(x, F.lit(0), 1.0), lambda: logits.repetition_penalty(x, F.array(), 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="is no token"):
        df.select(logits.loss(x, F.lit(7))).collect()
