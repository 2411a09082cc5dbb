"""Hashed n-gram features of whole texts, vectorised over a batch.

Four views, each hashed into a fixed number of buckets:
- bytes: runs of four bytes;
- words: words and pairs of words, lower-cased;
- tokens: single words, lower-cased, in many buckets, so that few share one;
- shapes: runs of three word shapes. A shape tells of capitals, symbols, ends, whether a word equals one of the two before it,
  and whether it stood after the same word earlier in the text.
"""

from __future__ import annotations

import numpy as np

from lexweave.llm.common import _IS_SPACE, chunks, mix, rolling, word_hashes

BUCKETS = {"bytes": 1 << 15, "words": 1 << 15, "shapes": 1 << 12, "tokens": 1 << 18}


def layout(views: tuple[str, ...]) -> tuple[dict[str, slice], int]:
    """Where each view's buckets stand among those of the views in use, and how many there are."""
    starts = np.cumsum([0, *(BUCKETS[v] for v in views)]).tolist()
    return {v: slice(a, b) for v, a, b in zip(views, starts[:-1], starts[1:], strict=True)}, starts[-1]


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-!?()"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_END = np.zeros(256, dtype=np.uint64)
for _k, _cs in enumerate((b".", b",", b"!", b"?;:", b"0123456789"), 1):
    _END[list(_cs)] = _k


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def _shapes(data: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A small number for each word."""
    begin, end = _spans(data)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    symbols = np.add.reduceat(_SYMBOL[data].astype(np.int32), begin) > 0
    upper = np.minimum(np.add.reduceat(_UPPER[data].astype(np.int32), begin), 2)
    length = np.minimum((end - begin) // 4, 4)
    same = np.zeros(len(words), dtype=np.uint64)
    for back in (2, 1):
        same[back:][(words[back:] == words[:-back]) & (doc[back:] == doc[:-back])] = back
    again = np.zeros(len(words), dtype=bool)
    inside = np.flatnonzero(doc[1:] == doc[:-1]) + 1  # words with one before them in the text
    if len(inside):
        pair = rolling(words, 2)[inside - 1] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1))
        order = np.argsort(pair, kind="stable")
        again[inside[order[1:][pair[order[1:]] == pair[order[:-1]]]]] = True
    parts = ((symbols, 2), (upper, 3), (length, 5), (same, 3), (again, 2), (_END[data[end - 1]], 6))
    out = np.zeros(len(words), dtype=np.uint64)
    for value, size in parts:
        out = out * np.uint64(size) + value.astype(np.uint64)
    return out


def _view(grams: np.ndarray, view: str) -> np.ndarray:
    return (grams % np.uint64(BUCKETS[view])).astype(np.int64)


def batches(texts: list[bytes], views: tuple[str, ...] = ("words", "shapes"), most: int = 1 << 19):
    """(range of texts, {view: (buckets by layout(views) in the order of the texts, where each text's begin)}, words of each text), a bounded number of bytes at a time."""
    places, _ = layout(views)
    for a, b in chunks(texts, most):
        part = texts[a:b]
        words, starts = word_hashes(part)
        makers = {"bytes": lambda: _bytes(part), "words": lambda: _words(words, starts), "tokens": lambda: (_view(words, "tokens"), starts), "shapes": lambda: _shape_runs(part, words, starts)}
        out = {}
        for v, at in places.items():
            buckets, begin = makers[v]()
            out[v] = buckets + at.start, begin
        yield (a, b), out, np.diff(starts)


def _bytes(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(t) for t in part), dtype=np.int64, count=len(part))
    data = np.frombuffer(b" ".join(part) + b" " * 4, dtype=np.uint8).astype(np.uint64)
    four = data[:-3] | data[1:-2] << np.uint64(8) | data[2:-1] << np.uint64(16) | data[3:] << np.uint64(24)
    with np.errstate(over="ignore"):
        four = four[: int(sizes.sum()) + len(part)] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return _view(four, "bytes"), np.concatenate(([0], np.cumsum(sizes + 1)))


def _words(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two for each word: itself and the pair it begins; the last word of a text has no pair and counts twice."""
    both = np.repeat(words, 2)
    if len(words) > 1:
        both[1:-1:2] = rolling(words, 2)
    last = starts[1:][np.diff(starts) > 0] - 1
    both[2 * last + 1] = words[last]
    return _view(both, "words"), 2 * starts


def _shape_runs(part: list[bytes], words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = _shapes(np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8), words, starts) + np.uint64(1)
    first = np.zeros(len(code), dtype=bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    second = np.concatenate((np.zeros(1, bool), first))[: len(first)]
    before = np.concatenate((np.zeros(2, np.uint64), code))
    one = np.where(first, np.uint64(0), before[1 : 1 + len(code)])
    two = np.where(first | second, np.uint64(0), before[: len(code)])
    return _view(mix((code * np.uint64(2048) + one) * np.uint64(2048) + two), "shapes"), starts


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, of which some may be empty."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]
