"""A byte-level BPE tokenizer for corpora: words counted and merged by Spark, each distinct word encoded once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.batches import KNOWN, bound_batches, by_word, slices
from lexweave.functions.stored import stored
from lexweave.functions.text import WS, nfkc
from lexweave.operators.merges import Vocabulary, learn, learn_from

SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")
PAD, BOS, EOS, UNK = range(4)
#: The pattern that cuts text before merges: contractions, then letters, digits or other characters with a space before, then white space.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def pretoken_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """pretoken, n over all rows; combined before the shuffle."""
    return df.select(F.explode(pretokens(F.coalesce(F.col(text_col), F.lit("")))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


def byte_letters() -> list[str]:
    """A printable character for each byte: itself if printable, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {}, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


def first_tokens() -> list[str]:
    """The special tokens, then a token for each byte, in the order of their letters."""
    return [*SPECIALS, *sorted(byte_letters())]


def learn_merges(counts: dict[str, int], vocab_size: int, min_frequency: int = 2) -> tuple[list[str], list[tuple[str, str]]]:
    """(vocabulary, merges) from word counts that fit in memory: the most frequent pair of neighbours is merged until the vocabulary is full."""
    vocabulary, letters = Vocabulary(first_tokens()), byte_letters()
    words, found = [[vocabulary.ids[letters[b]] for b in w.encode()] for w in counts], []
    while more := learn(words, list(counts.values()), vocabulary, vocab_size, min_frequency):
        found += more
    return vocabulary.tokens, [(vocabulary.tokens[a], vocabulary.tokens[b]) for a, b, _ in found]


def byte_ids(word: Column) -> Column:
    """The first tokens of a word: one id for each byte."""
    vocabulary = Vocabulary(first_tokens())
    table = np.array([vocabulary.ids[c] for c in byte_letters()], dtype=np.int32)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
            data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), dtype=np.uint8)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))), pa.array(table[data]))

    return run(word)


def train(df: DataFrame, vocab_size: int = 32_000, min_frequency: int = 2, text_col: str = "text") -> str:
    """tokenizer.json. Words are counted and rewritten on the executors; what the driver holds doesn't grow with them (merges.learn_from)."""
    if vocab_size <= len(SPECIALS):
        raise ValueError("vocab_size must exceed the special tokens")
    bound_batches(df.sparkSession)
    counted = stored(pretoken_counts(df.withColumn(text_col, nfkc(F.col(text_col))), text_col))
    if counted.isEmpty():
        raise ValueError("no text to train on")
    vocabulary = Vocabulary(first_tokens())
    found = learn_from(counted.select(byte_ids(F.col("pretoken")).alias("s"), "n"), vocabulary, vocab_size, min_frequency)
    vocab, merges = vocabulary.tokens, [(vocabulary.tokens[a], vocabulary.tokens[b]) for a, b, _ in found]
    added = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, t in enumerate(SPECIALS)]
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": SPECIALS[UNK], "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: i for i, t in enumerate(vocab)}, "merges": [list(m) for m in merges]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": {"type": "NFKC"}, "pre_tokenizer": byte_level, "post_processor": None, "decoder": byte_level, "model": model}, ensure_ascii=False)


def validate(spec: str) -> int:
    """The vocabulary's size; ValueError unless the special tokens have ids 0 to 3."""
    vocab = json.loads(spec)["model"]["vocab"]
    for i, t in enumerate(SPECIALS):
        if vocab.get(t) != i:
            raise ValueError(f"{t} must have id {i}")
    return len(vocab)


def artefacts(spec: str, folder: str) -> None:
    """tokenizer.json, vocab.json and merges.txt in a folder of the driver."""
    from pathlib import Path

    model = json.loads(spec)["model"]
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / "tokenizer.json").write_text(spec, encoding="utf-8")
    (at / "vocab.json").write_text(json.dumps(model["vocab"], ensure_ascii=False), encoding="utf-8")
    (at / "merges.txt").write_text("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in model["merges"]), encoding="utf-8")


def vocabulary(spark, spec: str) -> DataFrame:
    """token, id."""
    return spark.createDataFrame(list(json.loads(spec)["model"]["vocab"].items()), "token string, id int")


def encode(text: Column, spec: str, bos: bool = False, eos: bool = False) -> Column:
    """Ids of a text; null for a null."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        for texts in batches:
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes):  # a token takes some hundred bytes before it is a number alone
                part = texts.slice(a, b - a).to_pylist()
                found = iter(tokenizer.encode_batch([t for t in part if t is not None], add_special_tokens=False))
                yield pa.array([None if t is None else [BOS] * bos + next(found).ids + [EOS] * eos for t in part], pa.list_(pa.int32()))

    return run(text)


#: Words whose ids a worker keeps.
FREQUENT = KNOWN


def word_ids(words: Column, spec: str, known: int = FREQUENT) -> Column:
    """The ids of an array of pretokens, side by side; a worker encodes each of them once, and again only if it has met more than `known` others."""

    made: list = []

    def of(new: list[str]) -> list[list[int]]:
        from tokenizers import Tokenizer

        if not made:
            made.append(Tokenizer.from_str(spec))
        return [e.ids for e in made[0].encode_batch(new, add_special_tokens=False)]

    return by_word(words, of, known)


def encode_distinct(df: DataFrame, spec: str, text_col: str = "text", ids_col: str = "ids", bos: bool = False, eos: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """df with the ids of its texts, null for a null; equal pretokens are encoded once by a worker, which keeps `frequent` of them at most.

    Texts stay where they are: nothing is stored or moved, so a table of any size takes one pass.
    """
    bound_batches(df.sparkSession)
    ends = lambda token, wanted: F.array(F.lit(token)) if wanted else F.array().cast("array<int>")
    ids = F.concat(ends(BOS, bos), word_ids(pretokens(nfkc(F.col(text_col))), spec, frequent), ends(EOS, eos))
    return df.select(*df.columns, ids.alias(ids_col))


def merge_table(spark, spec: str) -> DataFrame:
    """rank, first, second, made: the merges as a relation, by ids."""
    model = json.loads(spec)["model"]
    vocab = model["vocab"]
    rows = [(k, vocab[a], vocab[b], vocab[a + b]) for k, (a, b) in enumerate(model["merges"])]
    return spark.createDataFrame(rows, "rank int, first int, second int, made int")


def decode(ids: Column, spec: str, skip_special: bool = True) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        for arrays in batches:
            for a, b in slices(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)):
                yield pa.array([None if x is None else tokenizer.decode(x, skip_special_tokens=skip_special) for x in arrays.slice(a, b - a).to_pylist()], pa.string())

    return run(ids)


def load(path: str) -> str:
    """The specification of a tokenizer.json, or of a folder that holds one; FileNotFoundError, or ValueError if its special tokens don't stand first."""
    from pathlib import Path

    at = Path(path)
    at = at / "tokenizer.json" if at.is_dir() else at
    if not at.is_file():
        raise FileNotFoundError(path)
    spec = at.read_text(encoding="utf-8")
    validate(spec)
    return spec


def token_id(spec: str, token: str) -> int | None:
    """The id of a token, if there is one."""
    return json.loads(spec)["model"]["vocab"].get(token)


def token_of(spec: str, id_: int) -> str | None:
    """The token of an id, if there is one."""
    return next((t for t, i in json.loads(spec)["model"]["vocab"].items() if i == id_), None)
