"""Text generation as a loop over steps: each step scores all rows at once and appends a token to those that haven't ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.stored import stored
from lexweave.operators import sampling, sft

#: Rows that are scored in one task; each becomes as many logits as the vocabulary has tokens.
ROWS = 8192

#: From rows (row_id, tokens) to the logits (row_id, token_id, logit) of what comes next.
Scorer = Callable[[DataFrame], DataFrame]


def generate(prompts: DataFrame, scorer: Scorer, max_new_tokens: int, eos: int | None = None, max_context: int | None = None, greedy: bool = True, seed: int = 0, **options) -> DataFrame:
    """row_id, tokens (prompt and what follows) of prompts (row_id, tokens), whose token lists must not be empty.

    A row that has its end token stays as it is. The scorer sees the latest max_context tokens. options: of sampling.sample(), with `penalty` over all
    tokens of a row. Each step deals open rows out anew, ROWS a task on average, so a task holds no more logits in larger tables. Steps are stored, so a lost executor costs one step; the loop ends once no row is open.
    """
    if max_new_tokens <= 0:
        raise ValueError("max_new_tokens must be positive")
    n, empty = prompts.agg(F.count("*"), F.count_if(F.coalesce(F.size("tokens"), F.lit(0)) == 0)).first()
    if not n or empty:
        raise ValueError(f"{empty} of {n} prompts have no tokens")
    rows = stored(prompts.select("row_id", F.transform("tokens", lambda t: t.cast("long")).alias("tokens"), F.lit(False).alias("done")))
    for step in range(max_new_tokens):
        live = rows.where("NOT done").select("row_id", "tokens")
        if not (open_rows := live.count()):
            break
        live = live.repartition(-(-open_rows // ROWS), "row_id")
        context = live if max_context is None else live.withColumn("tokens", F.when(F.size("tokens") > max_context, F.slice("tokens", -max_context, max_context)).otherwise(F.col("tokens")))
        seen = live.select("row_id", F.explode("tokens").alias("token_id"))
        next_ = sampling.sample(scorer(context), seen=seen, seed=seed + step, is_greedy=greedy, **options)
        met = rows.join(next_.withColumnRenamed("token_id", "_next"), "row_id", "left")
        added = ~F.col("done") & F.col("_next").isNotNull()
        ended = F.lit(False) if eos is None else added & (F.col("_next") == eos)
        rows = stored(met.select("row_id", F.when(added, F.array_append("tokens", F.col("_next").cast("long"))).otherwise(F.col("tokens")).alias("tokens"), (F.col("done") | ended | F.col("_next").isNull()).alias("done")))
    return rows.select("row_id", "tokens")


def answers(prompts: DataFrame, generated: DataFrame, eos: int | None = None) -> DataFrame:
    """row_id, tokens: what follows each prompt, up to the end token."""
    sizes = prompts.select("row_id", F.size("tokens").alias("_n"))
    cut = F.slice("tokens", F.col("_n") + 1, F.greatest(F.size("tokens") - F.col("_n"), F.lit(0)))
    return generated.join(sizes, "row_id").select("row_id", (cut if eos is None else sft.until_eos(cut, eos)).alias("tokens"))


def chat_turn(turns: DataFrame, encode: Callable, decode: Callable, scorer: Scorer, max_new_tokens: int, eos: int, **options) -> DataFrame:
    """turns (conv_id, turn, role, text) with the assistant's next turn of each conversation. encode, decode: column functions between texts and tokens."""
    prompts = sft.chat_transcripts(turns).select(F.col("conv_id").alias("row_id"), encode(F.col("prompt")).alias("tokens"))
    said = answers(prompts, generate(prompts, scorer, max_new_tokens, eos, **options), eos)
    after = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    new = said.join(after, said.row_id == after.conv_id).select("conv_id", "turn", F.lit("assistant").alias("role"), F.trim(decode(F.col("tokens"))).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(new)
