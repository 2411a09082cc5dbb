"""The corpus plan: collect, clean, filter, deduplicate, split, tokenize and shard, from one configuration."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.stored import stored
from lexweave.operators import pack, split, tokenizer
from lexweave.operators.clean import CleanOptions, clean
from lexweave.operators.dedup import component_dedup, exact_dedup, near_dedup
from lexweave.operators.quality import QualityOptions, route
from lexweave.sources import collect, sinks

STEPS = ("collect", "clean", "filter", "deduplicate", "split")


@dataclass(frozen=True)
class CollectOptions:
    source_type: str = "directory"
    input_path: str = ""
    pattern: str = "*.txt"
    text_field: str = "text"
    text_column: str = "text"
    encoding: str = "UTF-8"


@dataclass(frozen=True)
class DedupOptions:
    run_exact_dedup: bool = True
    run_near_dedup: bool = True
    shingle_size: int = 5
    num_perm: int = 64
    num_bands: int = 16
    similarity_threshold: float = 0.8
    whole_components: bool = False  #: keep the first row of each component of similar rows, not what a walk leaves


@dataclass(frozen=True)
class SplitOptions:
    train: float = 0.98
    validation: float = 0.01
    test: float = 0.01
    seed: int = 42


@dataclass(frozen=True)
class TokenOptions:
    eos_token: str = "<eos>"
    shard_size: int = 1_000_000
    shard_prefix: str = "shard"


@dataclass(frozen=True)
class CorpusConfig:
    collect: CollectOptions = field(default_factory=CollectOptions)
    clean: CleanOptions = field(default_factory=CleanOptions)
    filter: QualityOptions = field(default_factory=QualityOptions)
    deduplicate: DedupOptions = field(default_factory=DedupOptions)
    split: SplitOptions = field(default_factory=SplitOptions)
    tokenization: TokenOptions = field(default_factory=TokenOptions)

    @classmethod
    def of(cls, raw: dict) -> CorpusConfig:
        """From nested mappings; ValueError on a name that isn't known."""
        kinds = {f.name: f.default_factory for f in fields(cls)}
        if unknown := set(raw) - set(kinds):
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        made = {}
        for name, values in raw.items():
            known = {f.name for f in fields(kinds[name])}
            if bad := set(values or {}) - known:
                raise ValueError(f"unknown options in {name}: {sorted(bad)}")
            made[name] = kinds[name](**(values or {}))
        return cls(**made)


def collected(spark: SparkSession, o: CollectOptions) -> DataFrame:
    if o.source_type == "directory":
        return collect.collect_directory(spark, o.input_path, o.pattern, encoding=o.encoding)
    if o.source_type == "jsonl":
        return collect.collect_jsonl(spark, o.input_path, o.text_field)
    if o.source_type in ("csv", "tsv"):
        return collect.collect_csv(spark, o.input_path, o.text_column, "," if o.source_type == "csv" else "\t", encoding=o.encoding)
    raise ValueError(f"unknown source type {o.source_type}")


def prepare(docs: DataFrame, config: CorpusConfig = CorpusConfig(), steps: tuple[str, ...] = STEPS[1:]) -> DataFrame:
    """Applies steps in the order given to documents with text and pos.

    Deduplication and splits read their input more than once, so what cleaning and filtering made is stored before them, once.
    """
    made = False
    for step in steps:
        if step in ("deduplicate", "split") and made:
            docs, made = stored(docs), False
        made = made or step in ("clean", "filter", "deduplicate")
        if step == "clean":
            docs = clean(docs, config.clean)
        elif step == "filter":
            docs = route(docs, config.filter)[0]
        elif step == "deduplicate":
            o = config.deduplicate
            if o.run_exact_dedup:
                docs = exact_dedup(docs)
            if o.run_near_dedup:
                docs = stored(docs) if o.run_exact_dedup else docs
                if o.whole_components:
                    docs = component_dedup(docs, shingle_size=o.shingle_size, similarity_threshold=o.similarity_threshold)
                    continue
                docs = near_dedup(docs, shingle_size=o.shingle_size, num_perm=o.num_perm, num_bands=o.num_bands, similarity_threshold=o.similarity_threshold)
        elif step == "split":
            o = config.split
            docs = split.split(docs, o.train, o.validation, o.test, o.seed)
        else:
            raise ValueError(f"unknown step {step}; there are {STEPS}")
    return docs


def tokenize_and_shard(docs: DataFrame, spec: str, path: str, o: TokenOptions = TokenOptions()) -> dict[str, dict]:
    """Encodes each split, packs and writes its shards below path; returns the manifests by split."""
    vocab = json.loads(spec)["model"]["vocab"]
    if o.eos_token not in vocab:
        raise ValueError(f"the tokenizer has no {o.eos_token}")
    tokens = stored(pack.end_of_text(docs.withColumn("tokens", tokenizer.encode(F.col("text"), spec)), vocab[o.eos_token]))
    out = {}
    for name in [r.split for r in tokens.select("split").distinct().collect()]:
        part = tokens.where(F.col("split") == name)
        out[name] = sinks.write_shards(pack.shards(part, o.shard_size), f"{path}/{name}", pack.token_width(len(vocab)), o.shard_prefix)
    return out


def load_config(path: str) -> CorpusConfig:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return CorpusConfig.of(yaml.safe_load(text) or {})
    return CorpusConfig.of(json.loads(text))


def main(argv: list[str] | None = None) -> int:
    """Prepares a corpus, trains or applies a tokenizer, or counts metrics; --dry-run prints what would run."""
    parser = argparse.ArgumentParser(prog="lexweave")
    sub = parser.add_subparsers(dest="command", required=True)
    prepare_ = sub.add_parser("prepare")
    prepare_.add_argument("--steps", nargs="+", default=list(STEPS), choices=STEPS)
    train_ = sub.add_parser("train-tokenizer")
    train_.add_argument("--vocab-size", type=int, default=32_000)
    train_.add_argument("--min-frequency", type=int, default=2)
    tokenize_ = sub.add_parser("tokenize")
    tokenize_.add_argument("--tokenizer", required=True)
    tokenize_.add_argument("--shard-size", type=int)
    tokenize_.add_argument("--splits", nargs="+", default=list(split.SPLITS), choices=split.SPLITS)
    for p in (prepare_, train_, tokenize_):
        p.add_argument("--config", required=True)
        p.add_argument("--input", default=None)
        p.add_argument("--output", required=True)
        p.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    config = load_config(args.config)
    if args.dry_run:
        print(json.dumps({"command": args.command, "options": {k: v for k, v in vars(args).items() if k not in ("command", "dry_run")}}))
        return 0
    spark = SparkSession.builder.getOrCreate()
    source = config.collect if args.input is None else CollectOptions(**{**config.collect.__dict__, "input_path": args.input})
    if args.command == "prepare":
        steps = tuple(s for s in args.steps if s != "collect")
        out = prepare(collected(spark, source), config, steps)
        sinks.write_splits(out, args.output) if "split" in steps else sinks.write_jsonl(out, args.output)
    elif args.command == "train-tokenizer":
        tokenizer.artefacts(tokenizer.train(collected(spark, source), args.vocab_size, args.min_frequency), args.output)
    else:
        docs = spark.read.json(source.input_path).where(F.col("split").isin(args.splits))
        o = config.tokenization if args.shard_size is None else TokenOptions(config.tokenization.eos_token, args.shard_size, config.tokenization.shard_prefix)
        tokenize_and_shard(docs, Path(args.tokenizer).read_text(), args.output, o)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
