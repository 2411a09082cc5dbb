"""Helpers that the operators of this subpackage share: reading tables, shared folders, vectorised word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.stored import shared_dir
from lexweave.functions.stored import stored as checkpoint

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES (and a row). A batch lies outside the heap more than once, in the JVM and in the worker; rows of texts are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # as Spark has it; another value is the user's
        spark.conf.set(key, BATCH_BYTES)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: 64-bit words of the bitmap by which foretold() deals rows; its broadcast is this many rows of 16 bytes at most.
SLOTS = 1 << 18


def foretold(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose id may be among the ids (one column), and rows whose id isn't, which a join need not move.

    A bitmap of fixed size over hashes of the ids tells them apart. With very many ids it tells less, and the first part grows;
    results stay the same.
    """
    at, bits = fresh(df, "slot", "bits")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    slot = lambda h: F.pmod(F.shiftright(h, 6), F.lit(SLOTS))
    h = F.xxhash64(ids.columns[0])
    bitmap = ids.select(slot(h).alias(at), bit(h).alias(bits)).groupBy(at).agg(F.bit_or(bits).alias(bits))
    h = F.xxhash64(id_col)
    marked = df.withColumn(at, slot(h)).join(F.broadcast(bitmap), at, "left")
    maybe = F.coalesce(F.col(bits).bitwiseAND(bit(h)) != 0, F.lit(False))
    return tuple(marked.where(x).select(*map(quoted, df.columns)) for x in (maybe, ~maybe))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that begin like the given ones and that no column of df has, in any case of letters."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any(f"_{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"_{n}{tail}" for n in names]


def quoted(name: str) -> Column:
    """The column of this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_file(path: str) -> bytes:
    """A file that lies beside the library on every machine, such as a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


#: Keys that lookup() takes for hot: those of more than one row in so many. There can be no more of them than that.
HOT = 1000


def lookup(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows joined to the table's one row of their key, where there is one. Rows are read twice, so they should be stored.

    Keys of more than one row in HOT meet their row of the table by a broadcast, of HOT rows at most; the others by a shuffle, in which no key is large.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = checkpoint(sizes.where(F.col("_n") * HOT > total).select(key))
    some = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(some, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def tidy() -> None:
    """Gives memory that a task has freed back to the system; a worker waits for its next task beside others that need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(function):
    """A generator function for Arrow batches that ends with tidy()."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            tidy()

    return run


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}; there are {df.columns}")


#: Parts of one pass of kth_largest, and rows that end it.
PARTS, FEW = 4096, 4096


def kth_largest(scores: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting equal parts of an ever smaller range; no more than FEW values reach the driver."""
    c = F.col(column)
    low, high, n = scores.agg(F.min(c), F.max(c), F.count(c)).first()
    if k <= 0 or n == 0:
        return float("inf")
    k = min(k, n)
    while low < high:
        width = (high - low) / PARTS
        inside = scores.where(c.between(low, high))
        if n <= FEW or width == 0 or low + width == low:
            return sorted((r[0] for r in inside.groupBy(c).count().select(F.explode(F.array_repeat(column, F.col("count").cast("int")))).collect()), reverse=True)[k - 1] if n <= FEW else low
        part = F.least(F.floor((c - low) / width), F.lit(PARTS - 1))
        found = {r[0]: r[1:] for r in inside.groupBy(part.alias("p")).agg(F.count("*"), F.min(c), F.max(c)).collect()}
        for p in sorted(found, reverse=True):
            n, low, high = found[p]
            if k <= n:
                break
            k -= n
    return low


def encoded(texts: pa.Array, rows: int = 512) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a column of texts, from which row on and as bytes; few rows are Python objects at a time. Nulls are empty."""
    for at in range(0, len(texts), rows):
        yield at, [b"" if t is None else t for t in texts.slice(at, rows).cast(pa.binary()).to_pylist()]


def chunks(texts: Iterable[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes together; one longer text stands alone."""
    start, held, k = 0, 0, -1
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, k
            start, held = k, 0
        held += len(t)
    if k >= 0:
        yield start, k + 1


_ODD = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes up to which a word is hashed beside the others; longer ones take a library hash each.
SHORT_WORD = 48


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, in order, and where each text's words start (one more entry than texts).

    The words of all texts are hashed side by side, eight bytes a step, scrambled after each step, so that no
    structure of the bytes carries over as it does in a polynomial; long words are hashed by blake2b.
    """
    joined = np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)
    if lower:
        joined = _LOWER[joined]
    eight = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
    joined = joined[:-8]
    space = _IS_SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(joined) and not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    starts = np.concatenate(([0], np.searchsorted(begin, offsets))).astype(np.int64)
    length = end - begin
    acc = length.astype(np.uint64) * np.uint64(_ODD)
    with np.errstate(over="ignore"):
        live = np.flatnonzero(length <= SHORT_WORD)
        for k in range(0, SHORT_WORD, 8):
            live = live[length[live] > k]
            left = np.minimum(length[live] - k, 8).astype(np.uint64)
            part = eight[begin[live] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
            acc[live] = mix((acc[live] ^ part) * np.uint64(_ODD) + np.uint64(k + 1))
    for i in np.flatnonzero(length > SHORT_WORD).tolist():
        acc[i] = int.from_bytes(hashlib.blake2b(joined[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return acc, starts


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word, none for fewer than n words; the last n-1 of a text run over its end and are for the caller to leave out."""
    count = max(0, len(words) - n + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            acc = mix(acc * np.uint64(_ODD) + words[k : k + count])
        return acc
