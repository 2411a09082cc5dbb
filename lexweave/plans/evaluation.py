"""Evaluation from the command line: metrics of tables that a model's run has written.

python -m lexweave.plans.evaluation perplexity --batches PATH --output PATH
python -m lexweave.plans.evaluation benchmark --items PATH --logprobs PATH --output PATH
python -m lexweave.plans.evaluation sft --examples PATH --losses PATH --tokenizer FILE --samples N --output PATH
python -m lexweave.plans.evaluation latency --runs PATH --output PATH
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import evaluate, report, sft, tokenizer
from lexweave.sources import collect, sinks


def perplexity_results(batches: DataFrame, max_batches: int | None = None, tokens_per_byte: float | None = None) -> dict[str, DataFrame]:
    """batches: batch_id, loss, n_tokens."""
    out = evaluate.corpus_perplexity(batches, max_batches)
    if tokens_per_byte is not None:
        out = out.withColumn("bits_per_byte", evaluate.bits_per_byte_column(F.col("perplexity"), F.lit(tokens_per_byte)))
    return {"perplexity": out}


def benchmark_results(items: DataFrame, logprobs: DataFrame) -> dict[str, DataFrame]:
    """items of read_benchmark; logprobs: item_id, choice, pos, logprob."""
    chosen = evaluate.choose(evaluate.choice_scores(logprobs))
    return {"benchmark": evaluate.accuracy(chosen, items), "items": chosen.join(items.select("item_id", "answer_index"), "item_id")}


def sft_results(examples: DataFrame, losses: DataFrame, spec: str, samples: int) -> dict[str, DataFrame]:
    """examples: pos, input_ids, labels; losses: batch_id, loss."""
    loss = evaluate.mean_batch_loss(losses).withColumn("perplexity", evaluate.perplexity(F.col("loss")))
    return {"loss": loss, "prompts": sft.sample_prompts(examples, lambda ids: tokenizer.decode(ids, spec), samples)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexweave-evaluate")
    sub = parser.add_subparsers(dest="command", required=True)
    kinds = {"perplexity": ("--batches",), "benchmark": ("--items", "--logprobs"), "sft": ("--examples", "--losses", "--tokenizer"), "latency": ("--runs",)}
    for name, inputs in kinds.items():
        p = sub.add_parser(name)
        for i in (*inputs, "--output"):
            p.add_argument(i, required=True)
        p.add_argument("--dry-run", action="store_true")
        if name == "perplexity":
            p.add_argument("--max-batches", type=int)
            p.add_argument("--tokens-per-byte", type=float)
        if name == "sft":
            p.add_argument("--samples", type=int, default=3)
    args = parser.parse_args(argv)
    if args.dry_run:
        print(json.dumps({k: v for k, v in vars(args).items() if k != "dry_run"}))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "perplexity":
        out = perplexity_results(collect.read_jsonl(spark, args.batches, "batch_id long, loss double, n_tokens long"), args.max_batches, args.tokens_per_byte)
    elif args.command == "benchmark":
        out = benchmark_results(collect.read_benchmark(spark, args.items), collect.read_jsonl(spark, args.logprobs, "item_id long, choice int, pos int, logprob double"))
    elif args.command == "sft":
        examples = collect.read_prepared(spark, args.examples).withColumn("pos", F.monotonically_increasing_id())
        out = sft_results(examples, collect.read_jsonl(spark, args.losses, "batch_id long, loss double"), tokenizer.load(args.tokenizer), args.samples)
    else:
        out = {"latency": report.latency(collect.read_jsonl(spark, args.runs, "seconds double"))}
    sinks.write_results(out, args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
