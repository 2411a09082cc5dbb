"""Packing token sequences into one long array, cut into shards and training blocks.

Nothing holds the whole array: a document knows its offset, and carries its pieces to the shards or blocks that it overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.prefix import running
from lexweave.functions.stored import stored
from lexweave.functions.text import strip


def token_width(vocab_size: int) -> str:
    """The narrowest unsigned type that holds the ids."""
    if vocab_size <= 1 << 16:
        return "uint16"
    if vocab_size <= 1 << 32:
        return "uint32"
    raise ValueError("vocabulary too large")


def end_of_text(df: DataFrame, eos: int, text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
    """Rows with text and tokens, their tokens ended by eos."""
    return df.where(_has_tokens(text_col, tokens_col)).withColumn(tokens_col, F.array_append(tokens_col, F.lit(eos)))


def _has_tokens(text_col: str, tokens_col: str) -> Column:
    return (strip(F.coalesce(F.col(text_col), F.lit(""))) != "") & (F.coalesce(F.size(tokens_col), F.lit(0)) > 0)


def token_counts(df: DataFrame, text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
    """One row: documents processed, documents skipped (blank, or without tokens) and tokens with an end each; in one aggregation."""
    for c in (text_col, tokens_col):
        if c not in df.columns:
            raise KeyError(c)
    kept = _has_tokens(text_col, tokens_col)
    sums = df.agg(F.count_if(kept).alias("num_processed"), F.count_if(~kept).alias("num_skipped"), F.sum(F.when(kept, F.size(tokens_col).cast("long") + 1)).alias("n"))
    return sums.select("num_processed", "num_skipped", F.coalesce("n", F.lit(0)).cast("long").alias("total_tokens"))


def tokenized(df: DataFrame, eos: int, text_col: str = "text", tokens_col: str = "tokens") -> tuple[DataFrame, dict[str, int]]:
    """(stored rows of end_of_text, counts of token_counts); ValueError if nothing is left to pack."""
    rows = stored(df)
    counts = token_counts(rows, text_col, tokens_col).first().asDict()
    if not counts["num_processed"]:
        raise ValueError(f"no tokens in {counts['num_skipped']} documents")
    return end_of_text(rows, eos, text_col, tokens_col), counts


def offsets(df: DataFrame, tokens_col: str = "tokens", order_col: str = "pos") -> DataFrame:
    """df with n_tokens and the offset of its first token in the packed array. The tokens are evaluated once and stored."""
    return running(stored(df.withColumn("n_tokens", F.size(tokens_col).cast("long"))), [order_col], "n_tokens", "offset")


def _pieces(placed: DataFrame, first: Column, last: Column, start: Column, size: int, name: str, tokens_col: str) -> DataFrame:
    """The parts of documents that fall into windows first..last, joined in order. start: of window `k`."""
    cut = placed.where(F.col("n_tokens") > 0).withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b"))).withColumn("_s", start)
    low = F.greatest(F.col("_s"), F.col("offset"))
    high = F.least(F.col("_s") + size, F.col("offset") + F.col("n_tokens"))
    piece = F.slice(tokens_col, (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    cut = cut.where(high > low).select("k", "_s", F.struct(low.alias("at"), piece.alias("p")).alias("x"))
    joined = cut.groupBy("k", "_s").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"])).alias("tokens"))
    return joined.select(F.col("k").alias(name), F.col("_s").alias("start_offset"), "tokens")


def shards(df: DataFrame, shard_size: int = 1_000_000, tokens_col: str = "tokens", order_col: str = "pos") -> DataFrame:
    """shard, start_offset, tokens: fixed slices of the packed array, the last one shorter."""
    if shard_size <= 0:
        raise ValueError("shard_size must be positive")
    first, last = F.floor(F.col("offset") / shard_size), F.floor((F.col("offset") + F.col("n_tokens") - 1) / shard_size)
    return _pieces(offsets(df, tokens_col, order_col), first, last, F.col("k") * shard_size, shard_size, "shard", tokens_col)


def manifest(df: DataFrame, shard_size: int, prefix: str = "shard", tokens_col: str = "tokens") -> DataFrame:
    """file, num_tokens, start_offset of each shard, from the number of tokens alone."""
    total = df.agg(F.coalesce(F.sum(F.size(tokens_col)), F.lit(0)).cast("long").alias("total"))
    rows = total.where("total > 0").select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / shard_size))).alias("k"))
    start = F.col("k") * shard_size
    return rows.select(F.format_string(f"{prefix}_%05d.bin", "k").alias("file"), F.least(F.lit(shard_size), F.col("total") - start).cast("long").alias("num_tokens"), start.alias("start_offset"))


def blocks(df: DataFrame, block_size: int = 2048, stride: int | None = None, tokens_col: str = "tokens", order_col: str = "pos") -> DataFrame:
    """block, start_offset, input_ids, labels (the same ids): windows of block_size tokens every `stride`; an incomplete last one is dropped."""
    stride = block_size if stride is None else stride
    if block_size <= 0 or stride <= 0:
        raise ValueError("block_size and stride must be positive")
    placed = offsets(df, tokens_col, order_col)
    total = placed.agg(F.sum("n_tokens")).first()[0] or 0
    if total < block_size:
        raise ValueError("fewer tokens than a block")
    count = (total - block_size) // stride + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("offset") - block_size + 1) / stride))
    last = F.least(F.lit(count - 1), F.floor((F.col("offset") + F.col("n_tokens") - 1) / stride))
    out = _pieces(placed, first, last, F.col("k") * stride, block_size, "block", tokens_col)
    return out.select("block", "start_offset", F.col("tokens").alias("input_ids"), F.col("tokens").alias("labels"))


def read_range(sharded: DataFrame, start: int, stop: int) -> DataFrame:
    """One row with the tokens of [start, stop) from shards; only shards that overlap it are read."""
    part = sharded.where((F.col("start_offset") < stop) & (F.col("start_offset") + F.size("tokens") > start))
    low = F.greatest(F.lit(start), F.col("start_offset"))
    high = F.least(F.lit(stop), F.col("start_offset") + F.size("tokens"))
    piece = F.slice("tokens", (low - F.col("start_offset") + 1).cast("int"), (high - low).cast("int"))
    return part.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_offset", piece.alias("p")))), lambda x: x["p"])).alias("tokens"))
