"""Evaluation metrics over tables of log-probabilities, losses and logits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.sft import IGNORE


def token_losses(logits: DataFrame, labels: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """row_id, loss of each row of (row_id, token_id, logit) against (row_id, label); rows of a masked or null label have none."""
    if not 0 <= smoothing < 1:
        raise ValueError("smoothing must be in [0, 1)")
    wanted = labels.where(F.col("label") != IGNORE)
    top = logits.groupBy("row_id").agg(F.max("logit").alias("m"))
    met = logits.join(top, "row_id").join(wanted, "row_id")
    sums = met.groupBy("row_id").agg(F.log(F.sum(F.exp(F.col("logit") - F.col("m")))).alias("z"), F.max("m").alias("m"), F.avg("logit").alias("mean"), F.max(F.when(F.col("token_id") == F.col("label"), F.col("logit"))).alias("own"))
    whole = F.col("m") + F.col("z")
    return sums.select("row_id", ((1 - smoothing) * (whole - F.col("own")) + smoothing * (whole - F.col("mean"))).alias("loss"))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def corpus_perplexity(batches: DataFrame, max_batches: int | None = None) -> DataFrame:
    """loss, perplexity, n_tokens of (batch_id, loss, n_tokens), weighed by tokens; batches without tokens count for nothing."""
    if max_batches is not None:
        if max_batches <= 0:
            raise ValueError("max_batches must be positive")
        batches = batches.orderBy("batch_id").limit(max_batches)
    loss = F.sum(F.col("loss") * F.col("n_tokens")) / F.sum("n_tokens")
    return batches.where("n_tokens > 0").agg(loss.alias("loss"), F.sum("n_tokens").alias("n_tokens")).withColumn("perplexity", perplexity(F.col("loss")))


def mean_batch_loss(batches: DataFrame) -> DataFrame:
    return batches.agg(F.avg("loss").alias("loss"))


def bits_per_byte(ppl: float, tokens_per_byte: float) -> float:
    if ppl <= 0 or tokens_per_byte <= 0:
        raise ValueError("both must be positive")
    return math.log2(ppl) * tokens_per_byte


def bits_per_byte_column(ppl: Column, tokens_per_byte: Column) -> Column:
    return F.log2(ppl) * tokens_per_byte


def fit_context(question: Column, choice: Column, max_context: int = 512) -> Column:
    """The question's last tokens that fit before the choice."""
    room = F.lit(max_context) - F.size(choice)
    return F.when(room <= 0, F.array().cast("array<int>")).when(F.size(question) > room, F.slice(question, -room, room)).otherwise(question)


def choice_scores(logprobs: DataFrame) -> DataFrame:
    """item_id, choice, score (mean log-probability of the choice's tokens) of (item_id, choice, pos, logprob)."""
    return logprobs.groupBy("item_id", "choice").agg(F.avg("logprob").alias("score"))


def choose(scores: DataFrame) -> DataFrame:
    """item_id, predicted: the choice of the best score, the first of equals."""
    return scores.groupBy("item_id").agg(F.max_by("choice", F.struct("score", -F.col("choice"))).alias("predicted"))


def accuracy(predictions: DataFrame, answers: DataFrame) -> DataFrame:
    """accuracy, n_correct, n_items of (item_id, predicted) against (item_id, answer_index)."""
    met = predictions.join(answers, "item_id").select((F.col("predicted") == F.col("answer_index")).cast("int").alias("ok"))
    return met.agg(F.avg("ok").alias("accuracy"), F.sum("ok").alias("n_correct"), F.count("*").alias("n_items"))


def check_items(items: DataFrame) -> DataFrame:
    """Benchmark items (question, choices, answer_index), or ValueError: two choices at least, the answer among them, one item at least."""
    fine = F.col("question").isNotNull() & (F.size("choices") >= 2) & F.col("answer_index").between(0, F.size("choices") - 1)
    n, bad = items.agg(F.count("*"), F.count_if(~F.coalesce(fine, F.lit(False)))).first()
    if not n or bad:
        raise ValueError(f"{bad} of {n} items are not valid")
    return items


def scored_choices(items: DataFrame, scorer, max_context: int = 512) -> DataFrame:
    """item_id, choice, score of items (item_id, question, choices as token arrays): a choice's mean log-probability after its question.

    The question loses its first tokens where both don't fit, so every token of a choice is scored. scorer: from rows (row_id, tokens) to
    (row_id, pos, logprob), the log-probability of the token at each place from 1 on given those before; places before the choice are left out.
    ValueError where a choice has no tokens, or leaves no room for one of the question.
    """
    each = items.select("item_id", "question", F.posexplode("choices").alias("choice", "tokens"))
    bad = each.where((F.coalesce(F.size("tokens"), F.lit(0)) == 0) | (F.size("tokens") >= max_context)).limit(1).collect()
    if bad:
        raise ValueError(f"item {bad[0].item_id}, choice {bad[0].choice}: {len(bad[0].tokens or [])} tokens in a context of {max_context}")
    from lexweave.functions.stored import stored

    context = fit_context(F.col("question"), F.col("tokens"), max_context)
    rows = stored(each.select("item_id", "choice", F.size(context).alias("start"), F.concat(context, "tokens").alias("tokens")).withColumn("row_id", F.monotonically_increasing_id()))
    scored = scorer(rows.select("row_id", "tokens")).join(rows.drop("tokens"), "row_id").where(F.col("pos") >= F.col("start"))
    return choice_scores(scored.select("item_id", "choice", "pos", "logprob"))


def run_benchmark(items: DataFrame, scorer, max_context: int = 512) -> tuple[DataFrame, DataFrame]:
    """(item_id, predicted, answer_index, correct of each item; accuracy, n_correct, n_items). items also hold answer_index."""
    chosen = choose(scored_choices(items, scorer, max_context))
    each = chosen.join(items.select("item_id", "answer_index"), "item_id").withColumn("correct", F.col("predicted") == F.col("answer_index"))
    return each, accuracy(chosen, items)
