"""Filters and draws over logits in long form: one row (row_id, token_id, logit) for each token that may come next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def temperature(logits: DataFrame, t: float) -> DataFrame:
    if t <= 0:
        raise ValueError("temperature must be positive")
    return logits.withColumn("logit", F.col("logit") / t)


def repetition_penalty(logits: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """seen: (row_id, token_id), repeats allowed. A seen token's logit is divided by the penalty if positive, else multiplied."""
    if penalty <= 0:
        raise ValueError("penalty must be positive")
    marked = logits.join(seen.select("row_id", "token_id").distinct().withColumn("_seen", F.lit(True)), ["row_id", "token_id"], "left")
    changed = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return marked.withColumn("logit", F.when(F.col("_seen"), changed).otherwise(F.col("logit"))).drop("_seen")


def top_k(logits: DataFrame, k: int | None) -> DataFrame:
    """Rows whose logit is among the k largest; all that tie with the k-th stay."""
    if not k or k <= 0:
        return logits
    order = Window.partitionBy("row_id").orderBy(F.desc("logit"))
    return logits.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= k).drop("_r")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """The nucleus: tokens in descending order for as long as the probability before them is at most p."""
    if p >= 1:
        return logits
    row = Window.partitionBy("row_id")
    order = row.orderBy(F.desc("logit"), "token_id")
    weighed = logits.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(row))).withColumn("_q", F.col("_e") / F.sum("_e").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    before = F.coalesce(F.sum("_q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return weighed.withColumn("_b", before).where(F.col("_b") <= p).drop("_e", "_q", "_b")


def greedy(logits: DataFrame) -> DataFrame:
    """row_id and the token of the largest logit; the least id of equals."""
    return logits.groupBy("row_id").agg(F.max_by("token_id", F.struct("logit", -F.col("token_id"))).alias("token_id"))


def draw(logits: DataFrame, seed: int) -> DataFrame:
    """row_id and a token drawn by its softmax probability: the largest of logit plus a Gumbel number fixed by an MD5 of seed, row and token."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "row_id", "token_id")), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    return greedy(logits.withColumn("logit", F.col("logit") - F.log(-F.log(u))))


def sample(logits: DataFrame, seen: DataFrame | None = None, penalty: float = 1.0, t: float = 1.0, k: int | None = None, p: float = 1.0, seed: int = 0, is_greedy: bool = False) -> DataFrame:
    """Penalty, temperature, top-k, top-p, then a draw; greedy bypasses all of them."""
    if is_greedy:
        return greedy(logits)
    if seen is not None and penalty != 1.0:
        logits = repetition_penalty(logits, seen, penalty)
    return draw(top_p(top_k(temperature(logits, t), k), p), seed)
