"""Arrow batches of bounded bytes, and functions of words that are evaluated once for equal ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch.
BATCH_BYTES = 2 << 20
#: Values (bytes of texts, ids of lists) that are Python objects at one time.
SLICE = 1 << 18
#: Words whose results a worker keeps.
KNOWN = 200_000


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES (and a row): ten thousand rows of texts or tokens are gigabytes as Python objects."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # as Spark has it; another value is the user's
        spark.conf.set(key, BATCH_BYTES)


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold `most` values, or a row more."""
    at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, b
        a = b


def by_word(words: Column, of: Callable[[list[str]], list[list[int]]], known: int = KNOWN) -> Column:
    """The whole numbers of each word of an array, side by side; null for a null. `of` is given the distinct words of a batch that the worker doesn't know yet; nothing is moved between workers."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept: dict[str, list[int]] = {}
        for batch in batches:
            flat = batch.flatten().dictionary_encode()
            names = flat.dictionary.to_pylist()
            new = [w for w in names if w not in kept]
            made = dict(zip(new, of(new), strict=True)) if new else {}
            lists = [kept[w] if w in kept else made[w] for w in names]
            if len(kept) + len(made) > known:
                kept = {}
            if len(made) <= known:
                kept |= made
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            values = np.fromiter((x for found in lists for x in found), np.int32, int(sizes.sum()))
            code = flat.indices.to_numpy(zero_copy_only=False)
            n = sizes[code]
            ends = np.concatenate(([0], np.cumsum(n)))
            start = (np.cumsum(sizes) - sizes)[code]
            at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)
            counts = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[at], pa.int32()), mask=batch.is_null())

    return run(words)
