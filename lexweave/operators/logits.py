"""Losses, filters and draws over arrays of logits: a row holds the logit of every token, at the token's id.

What operators.sampling and operators.evaluate do with a row a token goes here by kernels over a row's array, so nothing is exploded, shuffled or ordered in
windows, and a batch is one pass in Arrow. A null in an array is a token that a filter has left out. Null arrays, and arrays without a token, give null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def _rows(arrays: pa.Array) -> Iterator[np.ndarray | None]:
    """Each array with -inf for null; None for a null array or one without a token."""
    flat = arrays.flatten().fill_null(-np.inf).to_numpy(zero_copy_only=False).astype(np.float64)
    at = 0
    for n, there in zip(arrays.value_lengths().fill_null(0).to_pylist(), arrays.is_valid().to_pylist(), strict=True):
        row = flat[at : at + n]
        at += n
        yield row if there and n and row.max() > -np.inf else None


def _filtered(kernel: Callable[..., np.ndarray], logits: Column, *more: Column) -> Column:
    """Arrays that a kernel makes of arrays (and of other columns' values); -inf becomes null."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for first, *others in batches:
            out = []
            for row, *rest in zip(_rows(first), *(c.to_pylist() for c in others), strict=True):
                made = None if row is None else kernel(row, *rest)
                out.append(None if made is None else pa.array(made, from_pandas=False, mask=np.isneginf(made)))
            offsets = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in out]))).astype(np.int32)
            values = pa.concat_arrays([x for x in out if x is not None]) if any(x is not None for x in out) else pa.array([], pa.float64())
            yield pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in out]))

    return run(logits, *(more or (F.lit(0),)))


def _numbers(kind: str, kernel: Callable[..., float | int | None], logits: Column, *more: Column) -> Column:
    arrow = pa.float64() if kind == "double" else pa.int32()

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for first, *others in batches:
            found = (None if row is None else kernel(row, *rest) for row, *rest in zip(_rows(first), *(c.to_pylist() for c in others), strict=True))
            yield pa.array(list(found), arrow)

    return run(logits, *(more or (F.lit(0),)))


def _lse(row: np.ndarray) -> float:
    top = row.max()
    return float(top + np.log(np.exp(row - top).sum()))


def log_sum_exp(logits: Column) -> Column:
    return _numbers("double", lambda row, _: _lse(row), logits)


def loss(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Cross entropy against a label; null where the label is null or masked."""
    if not 0 <= smoothing < 1:
        raise ValueError("smoothing must be in [0, 1)")

    def kernel(row: np.ndarray, label: int | None) -> float | None:
        if label is None or label == IGNORE:
            return None
        if not 0 <= label < len(row):
            raise ValueError(f"label {label} is no token of {len(row)}")
        whole = _lse(row)
        return (1 - smoothing) * (whole - float(row[label])) + (smoothing * (whole - float(row.mean())) if smoothing else 0.0)

    return _numbers("double", kernel, logits, label)


def temperature(logits: Column, t: float) -> Column:
    if t <= 0:
        raise ValueError("temperature must be positive")
    return F.transform(logits, lambda x: x / t)


def _penalized(row: np.ndarray, seen: list[int] | None, penalty: float) -> np.ndarray:
    out, at = row.copy(), np.unique(np.asarray(seen or [], dtype=np.int64))
    at = at[(at >= 0) & (at < len(row))]
    out[at] = np.where(row[at] > 0, row[at] / penalty, row[at] * penalty)
    return out


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """seen: ids, repeats allowed. A seen token's logit is divided by the penalty if positive, else multiplied."""
    if penalty <= 0:
        raise ValueError("penalty must be positive")
    return _filtered(lambda row, seen: _penalized(row, seen, penalty), logits, seen)


def _top_k(row: np.ndarray, k: int | None) -> np.ndarray:
    if not k or k <= 0 or k >= len(row):
        return row
    return np.where(row >= np.partition(row, len(row) - k)[len(row) - k], row, -np.inf)


def top_k(logits: Column, k: int | None) -> Column:
    """Tokens whose logit is among the k largest; all that tie with the k-th stay."""
    return _filtered(lambda row, _: _top_k(row, k), logits)


def _top_p(row: np.ndarray, p: float) -> np.ndarray:
    if p >= 1:
        return row
    order = np.argsort(-row, kind="stable")
    share = np.exp(row[order] - row[order[0]])
    share /= share.sum()
    before = np.concatenate(([0.0], np.cumsum(share)[:-1]))
    out = np.full(len(row), -np.inf)
    out[order[before <= p]] = row[order[before <= p]]
    return out


def top_p(logits: Column, p: float) -> Column:
    """The nucleus: tokens in descending order for as long as the probability before them is at most p."""
    return _filtered(lambda row, _: _top_p(row, p), logits)


def greedy(logits: Column) -> Column:
    """The token of the largest logit; the least id of equals."""
    return _numbers("int", lambda row, _: int(row.argmax()), logits)


def _drawn(row: np.ndarray, key, seed: int) -> int:
    left = np.flatnonzero(row > -np.inf)
    numbers = np.array([int(hashlib.md5(f"{seed}-{key}-{t}".encode()).hexdigest()[:12], 16) for t in left.tolist()], dtype=np.float64)
    return int(left[(row[left] - np.log(-np.log((numbers + 0.5) / float(1 << 48)))).argmax()])


def sample(logits: Column, key: Column, seen: Column | None = None, penalty: float = 1.0, t: float = 1.0, k: int | None = None, p: float = 1.0, seed: int = 0, is_greedy: bool = False) -> Column:
    """Penalty, temperature, top-k, top-p, then a token drawn by its probability, fixed by an MD5 of seed, key and token; greedy bypasses all of them. One pass over each array."""
    if t <= 0 or penalty <= 0:
        raise ValueError("temperature and penalty must be positive")
    if is_greedy:
        return greedy(logits)

    def kernel(row: np.ndarray, key, seen) -> int:
        row = _penalized(row, seen, penalty) if penalty != 1.0 else row
        return _drawn(_top_p(_top_k(row / t, k), p), key, seed)

    return _numbers("int", kernel, logits, key, F.lit(None).cast("array<int>") if seen is None else seen)
