"""Learning byte-pair merges from word counts that stay on the executors.

The greedy rule takes, again and again, the most frequent pair of neighbouring tokens, of equals that of the least ids. It takes many
merges in a row without looking at most words:

- A pair of tokens that exist already only becomes rarer by merges, and a pair that a merge brings in is no more frequent than
  the old pair at its border. So pairs at or below some count can't be taken while more frequent ones are left.
- Each level therefore brings the PAIRS most frequent pairs to the driver. Executors cut their words wherever two neighbours are
  none of these, and send each distinct stretch of two or more tokens once, with its count. On those few stretches the driver runs
  the rule until the next pair would be one that it didn't bring. That is exactly what it would do on all words.
- Where more pairs than that tie at the top, the level takes the first of them, with all words that hold one, uncut.
- The level's merges, at most a vocabulary, then go to the executors, which rewrite the words that hold them. Words of one token are done.
- If a merge spells a token that exists, old pairs may become more frequent after all, so the level ends there.

The driver holds PAIRS pairs and STRETCHES stretches at most, however many words there are; a level that would need more stretches brings
fewer pairs, and of one pair alone it is known without stretches that it is the next.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.stored import stored

#: Pairs of a level, and stretches of words that they may bring to the driver.
PAIRS, STRETCHES = 4096, 200_000
_SHIFT = 32


class Vocabulary:
    """Tokens by id; a merge that spells a token that is there gets its id."""

    def __init__(self, tokens: list[str]):
        self.tokens = list(dict.fromkeys(tokens))
        self.ids = {t: i for i, t in enumerate(self.tokens)}

    def merged(self, a: int, b: int) -> tuple[int, bool]:
        """(id, whether it is new) of the token that two make."""
        token = self.tokens[a] + self.tokens[b]
        new = token not in self.ids
        if new:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token], new


def learn(words: list[list[int]], weights: list[int], vocabulary: Vocabulary, size: int, least: int = 1, only: set[tuple[int, int]] | None = None, before: tuple[int, int, int] | None = None) -> list[tuple[int, int, int]]:
    """Merges (a, b, token) in the order of the rule, applied to the words in place, until the vocabulary has `size` tokens, no pair is as frequent as `least`, or a merge spells a token that was there.

    only: the pairs of old tokens that count (others are not as frequent in these words as they are in all); before: (-count, a, b) that no pair taken reaches.
    """
    known, pairs, where = len(vocabulary.tokens), Counter(), defaultdict(set)
    exact = lambda p: only is None or p in only or p[0] >= known or p[1] >= known
    for k, word in enumerate(words):
        for p in zip(word, word[1:], strict=False):
            if exact(p):
                pairs[p] += weights[k]
                where[p].add(k)
    heap = [(-n, *p) for p, n in pairs.items()]
    heapq.heapify(heap)
    out: list[tuple[int, int, int]] = []
    while heap and len(vocabulary.tokens) < size:
        n, one, two = key = heapq.heappop(heap)
        if pairs.get((one, two), 0) != -n:
            continue
        if -n < least or (before is not None and key >= before):
            break
        made, new = vocabulary.merged(one, two)
        out.append((one, two, made))
        change: dict[tuple[int, int], int] = defaultdict(int)
        for k in where.pop((one, two), ()):
            words[k] = _rewritten(words[k], one, two, made, weights[k], change)
            for p in zip(words[k], words[k][1:], strict=False):
                if made in p and exact(p):
                    where[p].add(k)
        for p, by in change.items():
            if by and exact(p):
                pairs[p] += by
                if pairs[p] > 0 and p != (one, two):
                    heapq.heappush(heap, (-pairs[p], *p))
        if not new:
            break
    return out


def _rewritten(word: list[int], one: int, two: int, made: int, weight: int, change: dict[tuple[int, int], int]) -> list[int]:
    """The word with a pair merged from left to right; only the pairs beside a merge change."""
    new: list[int] = []
    i, last = 0, len(word) - 1
    while i <= last:
        if i == last or word[i] != one or word[i + 1] != two:
            new.append(word[i])
            i += 1
            continue
        change[one, two] -= weight
        if new:
            change[new[-1], one] -= weight
            change[new[-1], made] += weight
        if i + 2 <= last:
            change[two, word[i + 2]] -= weight
            change[made, word[i + 2]] += weight
        new.append(made)
        i += 2
    return new


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens side by side, and where each word starts (one more entry than words)."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    return words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def _joined(tokens: np.ndarray, starts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether each token and the next of its word are one of the pairs."""
    keys = tokens[:-1] << _SHIFT | tokens[1:]
    out = np.isin(keys, pairs)
    ends = starts[1:-1]
    out[ends[(ends > 0) & (ends <= len(out))] - 1] = False
    return np.concatenate((out, [False])) if len(tokens) else np.zeros(0, bool)


def stretches(words: Column, pairs: list[tuple[int, int]], whole: bool = False) -> Column:
    """The stretches of two or more tokens that the pairs join; whole: the word, if it holds a pair."""
    wanted = np.array(sorted(a << _SHIFT | b for a, b in pairs), dtype=np.int64)

    @F.arrow_udf("array<array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            tokens, starts = _flat(batch)
            joined = _joined(tokens, starts, wanted)
            word = np.repeat(np.arange(len(batch)), np.diff(starts))
            if whole:
                hit = np.unique(word[joined])
                found = [[] for _ in range(len(batch))]
                for k in hit.tolist():
                    found[k] = [tokens[starts[k] : starts[k + 1]]]
                yield pa.array(found, pa.list_(pa.list_(pa.int32())))
                continue
            begins = joined & ~np.concatenate(([False], joined[:-1]))
            goes_on = joined | np.concatenate(([False], joined[:-1]))
            of = word[begins]
            outer = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(batch))))).astype(np.int32)
            kept = tokens[goes_on]
            inner = np.concatenate((np.flatnonzero(begins[goes_on]), [len(kept)])).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(kept, pa.int32())))

    return run(words)


def rewrite(words: Column, merges: list[tuple[int, int, int]]) -> Column:
    """The words with merges applied in their order."""
    rank, made = {(a, b): k for k, (a, b, _) in reversed(list(enumerate(merges)))}, [m for *_, m in merges]
    wanted = np.array(sorted({a << _SHIFT | b for a, b, _ in merges}), dtype=np.int64)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none: dict = defaultdict(int)
        for batch in batches:
            tokens, starts = _flat(batch)
            touched = np.unique(np.repeat(np.arange(len(batch)), np.diff(starts))[_joined(tokens, starts, wanted)])
            changed = {}
            for k in touched.tolist():
                word = tokens[starts[k] : starts[k + 1]].tolist()
                while len(word) > 1 and (best := min((rank.get(p, len(made)) for p in zip(word, word[1:], strict=False)), default=len(made))) < len(made):
                    word = _rewritten(word, merges[best][0], merges[best][1], made[best], 0, none)
                changed[k] = word
            if not changed:
                yield batch.cast(pa.list_(pa.int32()))
                continue
            parts = [changed[k] if k in changed else tokens[starts[k] : starts[k + 1]] for k in range(len(batch))]
            yield pa.array(parts, pa.list_(pa.int32()))

    return run(words)


def pair_counts(words: DataFrame) -> DataFrame:
    """a, b, n of all neighbours in the words (s, n)."""
    each = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.get("s", i - 1).alias("a"), F.get("s", i).alias("b")))
    return words.select("n", F.explode(each).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def learn_from(words: DataFrame, vocabulary: Vocabulary, size: int, least: int = 2, pairs: int = PAIRS, most: int = STRETCHES) -> list[tuple[int, int, int]]:
    """The merges that the greedy rule takes on all words (s: token ids, n: how often), and in `vocabulary` their tokens.

    pairs and most bound what a level brings to the driver; the merges are the same with any bounds.
    """
    out: list[tuple[int, int, int]] = []
    words, take = stored(words.where(F.size("s") > 1)), 16  # common pairs stand in most words, so the first levels are small
    while len(vocabulary.tokens) < size:
        top = [(-r.n, r.a, r.b) for r in pair_counts(words).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(pairs + 1).collect()]
        if not top:
            break
        take = min(pairs, take * 4)
        while True:
            before = top[take] if len(top) > take else None
            tied = before is not None and top[0][0] == before[0]
            if before is not None and not tied:
                before = (before[0], -1, -1)  # pairs that are more frequent than the first one left out
            band = [(a, b) for n, a, b in top[:take] if before is None or tied or n < before[0]]
            found = words.select("n", F.explode(stretches(F.col("s"), band, tied)).alias("s")).groupBy("s").agg(F.sum("n").alias("n")).limit(most + 1).collect()
            if len(found) <= most or take == 1:
                break
            take = max(1, take // 4)
        if len(found) <= most:
            merges = learn([list(r.s) for r in found], [r.n for r in found], vocabulary, size, least, set(band), before)
        else:
            merges = [(top[0][1], top[0][2], vocabulary.merged(*top[0][1:])[0])]
        out += merges
        words = stored(words.select(rewrite(F.col("s"), merges).alias("s"), "n").where(F.size("s") > 1))
    return out
