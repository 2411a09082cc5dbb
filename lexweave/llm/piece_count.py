"""Token counts by heap-and-linked-list byte-pair merging over a sentencepiece BPE model; no ids are made.

The pair of neighbours whose piece has the best score is popped from a heap again and again, the leftmost of equals;
stale entries are skipped. The count is that of the first symbols less one for each merge. A character that no piece
stands for counts as its UTF-8 bytes (byte fallback) unless a merge takes it up.

No piece has a space mark after another character, so no merge crosses from such a character to a space mark: the
text is cut there and equal words are counted once. Characters in no longer piece are further borders.

Null and empty texts have 0 tokens and 0 bytes. Texts of any length are counted whole, repeated rows one by one; ids may be null or repeat.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, read_file, require, text_or_empty

MARK = "▁"
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Memo(dict):
    """A dict that computes missing values and keeps the recently used: trim() holds it to `most` entries in two generations."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:  # long keys hardly recur
            self[key] = value
        return value

    def trim(self) -> None:
        if 2 * len(self) > self.most:
            self.old = dict(self)
            self.clear()


class PieceCounter:
    """Counts the tokens of texts. memo: words kept of each table, which bounds a worker's memory."""

    def __init__(self, model: bytes, memo: int = 800_000):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = {s: k for k, s in enumerate(sorted({s for _, s in normal}, reverse=True))}
        self.rank = {p: order[s] for p, s in normal}
        fallback = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        self.first = Memo(lambda c: 1 if c in self.rank or not fallback else len(c.encode()), 50_000)
        merged = {c for p in self.rank if len(p) > 1 for c in p}
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.inert = re.compile("[^" + "".join(map(re.escape, sorted(merged))) + "]")
        self.by_part = Memo(self.merge, memo // 8)
        self.by_word = Memo(lambda word: self.word(MARK + word), memo)

    def merge(self, part: str) -> int:
        """The tokens of a stretch of normalised text."""
        symbol: list[str] = list(part)
        n, rank = len(symbol), self.rank
        weight = [self.first[c] for c in symbol]
        total = sum(weight)
        heap = [(r << 40) | i for i in range(n - 1) if (r := rank.get(symbol[i] + symbol[i + 1])) is not None]
        if not heap:
            return total
        heapq.heapify(heap)
        back, fore = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push, at = heapq.heappop, heapq.heappush, (1 << 40) - 1
        while heap:
            top = pop(heap)
            i = top & at
            if not symbol[i] or (j := fore[i]) >= n:
                continue
            joined = symbol[i] + symbol[j]
            if rank.get(joined) != top >> 40:  # an entry from before one of the two was merged
                continue
            symbol[i], symbol[j] = joined, ""
            total -= weight[i] + weight[j] - 1
            weight[i] = 1
            fore[i] = after = fore[j]
            if after < n:
                back[after] = i
                if (r := rank.get(joined + symbol[after])) is not None:
                    push(heap, (r << 40) | i)
            before = back[i]
            if before >= 0 and (r := rank.get(symbol[before] + joined)) is not None:
                push(heap, (r << 40) | before)
        return total

    def word(self, word: str) -> int:
        """The tokens of a stretch, cut at inert characters."""
        if not self.inert.search(word):
            return self.merge(word)
        total, start = 0, 0
        for m in self.inert.finditer(word):
            if m.start() > start:
                total += self.by_part[word[start : m.start()]]
            total += self.first[m[0]]
            start = m.end()
        return total + (self.by_part[word[start:]] if start < len(word) else 0)

    def count(self, text: str) -> int:
        if not text:
            return 0
        self.by_part.trim(), self.by_word.trim()
        normal: str = self.sp.normalize(text)
        if not self.cuts:
            return self.word(normal)
        if normal[:1] == MARK and MARK * 2 not in normal and normal[-1] != MARK:
            return sum(map(self.by_word.__getitem__, normal[1:].split(MARK)))
        return sum(map(self.word, _RUN.findall(normal)))


@functools.lru_cache(maxsize=2)
def worker_counter(model: bytes) -> PieceCounter:
    """One counter for all tasks of a worker process, so that what it has computed is used again."""
    return PieceCounter(model)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row. Other columns are left out."""
    require(df, id_col, text_col)
    bound_batches(df.sparkSession)
    model = read_file(model_path)

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = worker_counter(model)
        for texts in batches:
            yield pa.array([counter.count(t.as_py() or "") for t in texts], pa.int64())

    text = text_or_empty(text_col)
    return df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
