"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut by the tokenizer's pattern; each match is encoded by itself. Token sequences form a monoid: the
sequence of a concatenation follows from the sequences of its parts, since merges far from the seam don't change.
Each match is halved down to blocks of LEAF bytes, and neighbouring blocks are joined level by level. All matches of
a chunk of texts go up the tree side by side, so that a level is a few numpy steps.

Why the check at a seam is a proof. The encoder always takes the merge of least (rank, position). Restricted to any
stretch whose ends no merge has crossed, it takes the merges that it would take on that stretch alone. So if no
neighbouring tokens x, y of a sequence would merge across their border when x+y is encoded alone, then in the whole
text no merge is the first to cross a border, and the sequence is the encoding. Conversely the encoding has only such
neighbours. Joining two encodings hence needs a window around the seam, encoded anew, that is grown until its first
and last token stand unchanged next to their outer neighbours.

Decoding looks up the bytes of runs of DECODE_LEAF ids and concatenates them up the tree.

Null and empty texts have no tokens; the decoded bytes are then empty. Any text is encoded whole. Repeated rows are encoded
one by one, and ids may be null or repeat: each row's tokens follow from its own text. Other columns are left out.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexweave.llm.common import bound_batches, read_file, require, text_or_empty, tidy

#: Blocks of this many bytes are merged directly.
LEAF = 4
#: Ids that one leaf of the decoding tree joins.
DECODE_LEAF = 256
#: Words of which a worker keeps the tokens, and their characters; pairs of tokens of which it knows whether they stand side by side. All bound its memory.
KNOWN, KNOWN_CHARS, PAIRS = 150_000, 4_000_000, 150_000
#: Characters of texts that go up the tree together.
TOGETHER = 1 << 21
#: Longest window that is merged as a row of a matrix; longer ones take a heap.
WIDEST = 64
#: Fixed value: patterns of which every match begins or ends at a space that a character other than white space follows.
CUT_AT_SPACES = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)
_GAP = re.compile(r" (?:\s|$)")
_CUT = re.compile(r"(?= \S)")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines()) if token}


class Numbered(dict):
    """Numbers its keys in the order in which they are first met."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))


def _spread(flat: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `flat` that an index names, side by side, and how long each is."""
    sizes = starts[index + 1] - starts[index]
    return flat[np.arange(int(sizes.sum())) + np.repeat(starts[index] - _starts(sizes)[:-1], sizes)], sizes


class PairRanks:
    """The rank of the token that two tokens make, by a hash table of fixed size with linear probing. No rank is `none`."""

    def __init__(self, ranks: dict[bytes, int], none: int):
        self.none, get = none, ranks.get
        found = [(a * (none + 1) + b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        keys, values = (np.array(x, dtype=np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, none, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], values[free[first]]
            left = np.setdiff1d(left, free[first], assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * (self.none + 1) + b
        slot = self._slot(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.values[slot], np.int32(self.none))
        flat, keys, slot = out.reshape(-1), keys.reshape(-1), slot.reshape(-1)
        left = np.flatnonzero(((met != keys.reshape(met.shape)) & (met >= 0)).reshape(-1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[left]]
            hit = met == keys[left]
            flat[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (met >= 0)]
        return out


class TreeCodec:
    """Encodes and decodes by tree reduction. known: words of which the tokens are kept, which bounds a worker's memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, known: int = KNOWN):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing}")
        self.ranks, self.leaf, self.most = ranks, leaf, known
        self.find, self.cuts = regex.compile(pattern).findall, pattern in CUT_AT_SPACES
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.none = len(self.table)
        self.pair = PairRanks(ranks, self.none)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.width = np.array([len(t) for t in self.table], dtype=np.int64)
        self.begin, self.bytes = _starts(self.width), np.frombuffer(b"".join(self.table), dtype=np.uint8)
        self.stable: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.words, self.chars, self.ids, self.starts = Numbered(), 0, np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    # merging by definition

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """The encodings of rows of single-byte tokens: in each row the first neighbours of least rank merge until none are left. `none` fills up rows."""
        out, row = np.full(rows.shape, self.none, dtype=np.int32), np.arange(len(rows))
        rank = self.pair(rows[:, :-1], rows[:, 1:])
        while len(row):
            if not rank.shape[1]:
                out[row, :1] = rows
                break
            at = rank.argmin(axis=1)
            low = np.take_along_axis(rank, at[:, None], 1)[:, 0]
            go = low < self.none
            if not go.all():
                out[row[~go], : rows.shape[1]] = rows[~go]
                row, rows, rank, at, low = row[go], rows[go], rank[go], at[go], low[go]
                if not len(row):
                    break
            k = np.arange(len(row))
            rows[k, at] = low
            stay = np.ones(rows.shape, dtype=bool)
            stay[k, at + 1] = False
            rows = rows[stay].reshape(len(row), -1)
            stay = np.ones(rank.shape, dtype=bool)
            stay[k, at] = False
            rank = rank[stay].reshape(len(row), -1)
            x = k[at < rank.shape[1]]
            rank[x, at[x]] = self.pair(low[x], rows[x, at[x] + 1])
            x = k[at > 0]
            rank[x, at[x] - 1] = self.pair(rows[x, at[x] - 1], low[x])
        return out

    def merge_long(self, data: bytes) -> list[int]:
        """The same for one string of any length, with a heap."""
        n, get = len(data), self.ranks.get
        end, back, fore = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\x01") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = fore[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], fore[i] = 0, stop, fore[j]
            if fore[j] < n:
                back[fore[j]] = i
            for k in (back[i], i):
                if k >= 0 and fore[k] < n and (r := get(data[k : end[fore[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[fore[k]]))
        return [self.ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def merge(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of stretches of some bytes, side by side, and how many each has. Rows of a matrix hold stretches of similar length."""
        counts, parts = np.zeros(len(begin), dtype=np.int64), []
        wide = np.where(size > WIDEST, 0, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        for w in np.unique(wide).tolist():
            which = np.flatnonzero(wide == w)
            if w:
                col = np.arange(w)
                inside = col < size[which][:, None]
                rows = np.where(inside, self.single[data[np.where(inside, begin[which][:, None] + col, 0)]], np.int32(self.none))
                merged = self.merge_rows(rows)
                real = merged < self.none
                counts[which] = real.sum(axis=1)
                parts.append((which, merged[real]))
            else:
                lists = [self.merge_long(data[b : b + n].tobytes()) for b, n in zip(begin[which].tolist(), size[which].tolist(), strict=True)]
                counts[which] = list(map(len, lists))
                parts.append((which, np.array([t for x in lists for t in x], dtype=np.int32)))
        starts = _starts(counts)
        out = np.empty(int(starts[-1]), dtype=np.int32)
        for which, flat in parts:
            n = counts[which]
            out[np.arange(len(flat)) + np.repeat(starts[which] - _starts(n)[:-1], n)] = flat
        return out, counts

    # the tree

    def border(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of tokens x, y that stand side by side."""
        keys, back = np.unique(x.astype(np.int64) * (self.none + 1) + y, return_inverse=True)
        if len(self.stable) + len(keys) > PAIRS:
            self.stable.clear()
        new = np.array([k for k in keys.tolist() if k not in self.stable], dtype=np.int64)
        if len(new):
            one, two = new // (self.none + 1), new % (self.none + 1)
            data, sizes = _spread(self.bytes, self.begin, np.stack((one, two), axis=1).reshape(-1))
            size = sizes.reshape(-1, 2).sum(axis=1)
            flat, counts = self.merge(data, _starts(size)[:-1], size)
            self.stable.update(zip(new.tolist(), ((counts == 2) & (flat[_starts(counts)[:-1]] == one)).tolist(), strict=True))
        return np.fromiter(map(self.stable.__getitem__, keys.tolist()), dtype=bool, count=len(keys))[back.reshape(-1)]

    def join(self, data: np.ndarray, tokens: np.ndarray, low: np.ndarray, seam: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins the encodings tokens[low:seam] and tokens[seam:high], many at once; data: the bytes of all tokens.

        Returns all tokens after that, and where each place of `tokens` has gone to (one more than there are).
        """
        byte = _starts(self.width[tokens])
        open_ = np.flatnonzero(~self.border(tokens[seam - 1], tokens[seam]))
        low, seam, high = low[open_], seam[open_], high[open_]
        a, b, made = seam - 1, seam + 1, []
        while len(seam):
            flat, counts = self.merge(data, byte[a], byte[b] - byte[a])
            at = _starts(counts)
            left, right = a == low, b == high
            x = np.flatnonzero(~left)
            left[x] = self.border(tokens[a[x] - 1], flat[at[x]])
            x = np.flatnonzero(~right)
            right[x] = self.border(flat[at[x + 1] - 1], tokens[b[x]])
            done = left & right
            x = np.flatnonzero(done)
            made.append((a[x], b[x], *_spread(flat, at, x)))
            a, b = np.where(left, a, np.maximum(low, 2 * a - seam)), np.where(right, b, np.minimum(high, 2 * b - seam))
            a, b, low, seam, high = (v[~done] for v in (a, b, low, seam, high))
        gone = np.zeros(len(tokens) + 1, dtype=np.int64)
        for a, b, _, _ in made:  # windows don't overlap, but one may begin where another ends
            gone[a] += 1
            gone[b] -= 1
        stay = np.cumsum(gone)[:-1] == 0
        room = stay.astype(np.int64)
        for a, _, _, n in made:
            room[a] = n
        place = _starts(room)
        out = np.empty(int(place[-1]), dtype=np.int32)
        out[place[:-1][stay]] = tokens[stay]
        for a, _, flat, n in made:
            out[np.arange(len(flat)) + np.repeat(place[a] - _starts(n)[:-1], n)] = flat
        return out, place

    def tree(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of some non-empty strings side by side, and where each string's begin (one more entry than strings)."""
        data = np.frombuffer(b"".join(items), dtype=np.uint8)
        start = _starts(np.fromiter(map(len, items), dtype=np.int64, count=len(items)))
        nodes = -(-np.diff(start) // self.leaf)  # of each item
        inner = np.arange(int(nodes.sum())) - np.repeat(_starts(nodes)[:-1], nodes)  # a node's number within its item
        begin = np.repeat(start[:-1], nodes) + inner * self.leaf
        tokens, counts = self.merge(data, begin, np.minimum(self.leaf, np.repeat(start[1:], nodes) - begin))
        at = _starts(counts)
        while len(nodes) and nodes.max() > 1:
            left = np.flatnonzero((inner % 2 == 0) & (inner + 1 < np.repeat(nodes, nodes)))
            tokens, place = self.join(data, tokens, at[left], at[left + 1], at[left + 2])
            at = place[np.append(at[:-1][inner % 2 == 0], at[-1])]
            inner, nodes = inner[inner % 2 == 0] // 2, (nodes + 1) // 2
        return tokens, at

    # texts

    def _learn(self, units: list[str]) -> None:
        """Appends the tokens of units, which are whole numbers of matches, to those known."""
        matches: Numbered = Numbered()
        number, per_unit = matches.__getitem__, []
        index: list[int] = []
        for u in units:
            if u.isascii() and u[1:].isalpha() and (u[0] == " " or u[0].isalpha()):
                index.append(number(u))
                per_unit.append(1)
            else:
                found = self.find(u)
                index += map(number, found)
                per_unit.append(len(found))
        data = [m.encode() for m in matches]
        direct = np.fromiter((self.ranks.get(x, -1) for x in data), dtype=np.int32, count=len(data))
        rest = np.flatnonzero(direct < 0)
        tokens, at = self.tree([data[k] for k in rest.tolist()])
        flat = np.concatenate((direct, tokens))  # a known match is one token; the others follow
        begin, size = np.arange(len(data)), np.ones(len(data), dtype=np.int64)
        begin[rest], size[rest] = len(data) + at[:-1], np.diff(at)
        which = np.array(index, dtype=np.int64)
        n = size[which]
        ids = flat[np.arange(int(n.sum())) + np.repeat(begin[which] - _starts(n)[:-1], n)]
        ends = _starts(n)[_starts(np.array(per_unit, dtype=np.int64))]
        self.ids, self.starts = np.concatenate((self.ids, ids)), np.concatenate((self.starts, self.starts[-1] + ends[1:]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids, unsigned 32-bit, of each text; texts of about TOGETHER characters go up the tree together."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from self._encode_some(some)
                some, size = [], 0
        yield from self._encode_some(some)

    def _encode_some(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Under a pattern of CUT_AT_SPACES texts are cut at spaces before anything but white space; equal words are then encoded once."""
        if len(self.words) > self.most or self.chars > KNOWN_CHARS:
            self.forget()
        words, first, index = self.words, len(self.words), []
        number = words.__getitem__
        for text in texts:
            if not self.cuts:
                head, rest = text, []
            elif _GAP.search(text):
                head, *rest = _CUT.split(text)
                rest = [x[1:] for x in rest]
            else:
                head, *rest = text.split(" ")
            index.append(np.array([number((head,)), *map(number, rest)], dtype=np.int64))
        new = [k[0] if isinstance(k, tuple) else " " + k for k in list(words)[first:]]
        self.chars += sum(map(len, new))
        self._learn(new)
        for x in index:
            yield _spread(self.ids, self.starts, x)[0].astype("<u4")

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text])).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """Concatenates up the tree."""
        return self._concat(np.frombuffer(ids, dtype="<u4"))

    def _concat(self, ids: np.ndarray) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.table.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self._concat(ids[:half]) + self._concat(ids[half:])


@contextlib.contextmanager
def task_codec(ranks: bytes, pattern: str) -> Iterator[TreeCodec]:
    """A codec for one task. It goes with the task, so that idle workers hold nothing."""
    codec = TreeCodec(load_ranks(ranks), pattern)
    try:
        yield codec
    finally:
        codec.forget()
        codec.stable.clear()
        tidy()


def codec_udfs(ranks_path: str, pattern: str):
    """(encode, decode) as Arrow functions of a text column and of an ids column. The ranks, of fixed size, travel with them."""
    blob = read_file(ranks_path)

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with task_codec(blob, pattern) as codec:
            for texts in batches:
                yield pa.array([ids.tobytes() for ids in codec.encode_all(t or "" for t in texts.to_pylist())], pa.binary())

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with task_codec(blob, pattern) as codec:
            for ids in batches:
                yield pa.array([codec.decode(x or b"") for x in ids.to_pylist()], pa.binary())

    return encode, decode


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids: the tokens of each row's text as little-endian unsigned 32-bit integers. Other columns are left out."""
    require(df, id_col, text_col)
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col), codec_udfs(ranks_path, pattern)[0](text_or_empty(text_col)).alias("ids"))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with the column `decoded`: the bytes that the ids stand for."""
    require(df, ids_col)
    bound_batches(df.sparkSession)
    return df.withColumn("decoded", codec_udfs(ranks_path, pattern)[1](F.col(ids_col)))


def ids_as_array(ids: Column) -> Column:
    """The ids of one row as an array of long, in Spark."""
    n = (F.length(ids) / 4).cast("int")
    piece = lambda i: F.reverse(F.hex(F.substring(ids, i * 4 + 1, 4)))
    swap = lambda x: F.regexp_replace(x, "(.)(.)", "$2$1")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(swap(piece(i)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


CHECKED = "ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_checked(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each row's text: id_col, ids, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded bytes equal the text's).

    The id column keeps its name even if it is that of a result, which then follows it.
    """
    require(df, id_col, text_col)
    bound_batches(df.sparkSession)
    blob = read_file(ranks_path)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *StructType.fromDDL(CHECKED)])
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_())

    def both(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(blob, pattern) as codec:
            for table in tables:
                texts, rows = table.column(1).to_pylist(), []
                for text, found in zip(texts, codec.encode_all(texts), strict=True):
                    ids = found.tobytes()
                    back = codec.decode(ids)
                    rows.append((ids, len(found), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([table.column(0), *columns], schema.names)

    return df.select(F.col(id_col), text_or_empty(text_col).alias("_text")).mapInArrow(both, schema)


def digest(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_checked() without the ids."""
    return encode_checked(df, ranks_path, pattern, id_col, text_col).drop("ids")
