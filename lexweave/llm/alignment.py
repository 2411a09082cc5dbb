"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A (a `tokenizers` JSON file) reads a space and the text, tokenizer B (a sentencepiece model, which adds the space) the
text. Both sequences spell the same bytes, so the ends of their tokens, by one union1d, cut those bytes into elementary
intervals. searchsorted finds the two tokens that own an interval; each interval is one overlap, a link. Where tokens of both end, a
group closes; a group's product is every A token with every B token of it.

Texts are cut before spaces that both tokenizers never join to what stands before them: A's pattern because a match has white space
at its start only, B because no piece has a space mark after another character. What is found of such a segment holds wherever it
stands, so a worker keeps that of recent segments, and a group never reaches over a cut. Where a tokenizer isn't of that
kind, the text is one segment.

An id pair's count is how many links of all documents hold it. Texts are encoded once; each row's links are stored, packed, and
counted within batches, and only sums of pairs are shuffled; there are as many pairs as the vocabularies allow, at most. The counts
then meet the stored links: the FREQUENT most common pairs as arrays of that bounded size, which most links need; links of others are
joined by a shuffle, so every link gets its count at any size of the table.

Texts that are null or empty, or of which a tokenizer doesn't give back the bytes, have no tokens: zeros, and '' for the digest.
Repeated rows are aligned and counted one by one; ids may be null or repeat. Texts are read whole, long ones a piece at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import operator
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, checkpoint, fresh, kth_largest, quoted, read_file, require, text_or_empty, tidied, tidy
from lexweave.operators.tokenizer import byte_letters

MARK = "▁"
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs whose counts every worker has: three arrays of that length.
FREQUENT = 1 << 18
#: Segments that a worker keeps what it has found of; characters of texts that are aligned together.
KNOWN, TOGETHER = 600_000, 1 << 20
_GAP = re.compile(r" (?:\s|$)")
_CUT = re.compile(r"(?<! )(?= \S)")
#: Segments that may be encoded as one text: of letters and white space that all engines' patterns class alike, with neither at an end that joins another.
_PLAIN = re.compile(r"[!-~¡-ɏ](?:[\t\n\r -~¡-ɏ]*[!-~¡-ɏ])?")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the ends of two sequences of tokens over the same bytes: the elementary intervals' ends, the token of each sequence that owns each, and whether a group closes there."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


#: Of a segment: tokens of either side, groups and links as four 32-bit numbers; the groups spelled out; the links' id pairs as 64-bit numbers. Without any where it can't be aligned.
Segment = tuple[bytes, bytes, bytes]
BAD: Segment = (bytes(16), b"", b"")
_sizes, _spelled, _pairs = (operator.itemgetter(k) for k in range(3))


class Aligner:
    """Aligns texts by two tokenizers. known: segments that are kept, which bounds a worker's memory."""

    def __init__(self, a: bytes, b: bytes, known: int = KNOWN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_str(a.decode()), sentencepiece.SentencePieceProcessor(model_proto=b), known
        self.a.encode_special_tokens = True
        byte = {c: k for k, c in enumerate(byte_letters())}
        spell = lambda t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.bytes_a = [spell(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
        self.bytes_b = [piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        spec = json.loads(a)
        plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True)
        whole = self.b.normalize(" a  b\tﬁ ") == MARK + " a  b\tﬁ ".replace(" ", MARK)
        self.cuts = plain and whole and not any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.b.get_piece_size()))
        self.digits = len(str(max(len(self.bytes_a), len(self.bytes_b))))
        self.ranked = self._ranked(spec) if plain else None
        self.new: dict[str, Segment] = {}
        self.old: dict[str, Segment] = {}

    def _ranked(self, spec: dict):
        """The encoder of A's vocabulary as ranks, where each merge makes the token of the next id, so that merges go by ranks; else None."""
        import tiktoken

        vocab, merges = spec["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        made = [vocab.get("".join(m)) for m in merges]
        ranks = {self.bytes_a[i]: i for i in {*made, *(vocab.get(c) for c in byte_letters())} if i is not None}
        if None in made or made != sorted(set(made)) or len(ranks) != 256 + len(made) or spec["model"].get("ignore_merges"):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def segments(self, text: str) -> list[str]:
        """The segments of a space and the text, each without its first space."""
        if not self.cuts:
            return [text]
        if not _GAP.search(" " + text):
            return text.split(" ")
        return [s[1:] for s in _CUT.split(" " + text) if s]

    def pieces(self, text: str) -> Iterator[str]:
        """The text in parts of about TOGETHER characters, cut between segments."""
        start = 0
        while self.cuts and len(text) - start > 2 * TOGETHER and (m := _CUT.search(text, start + TOGETHER)):
            yield text[start : m.start()]
            start = m.start() + 1
        yield text[start:]

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids that both tokenizers give each segment."""
        return [x.ids for x in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)], self.b.encode(segments, num_threads=1)

    def found(self, segments: list[str]) -> list[Segment]:
        """Each segment's."""
        if 2 * len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, segments))
        absent = [i for i, x in enumerate(out) if x is None]
        missing = []
        for i in absent:
            if (x := old.get(s := segments[i])) is None:
                missing.append(i)
            else:
                out[i] = new[s] = x
        # those that may be encoded together go first
        missing.sort(key=lambda i: _PLAIN.fullmatch(segments[i]) is None)
        for i, x in zip(missing, self.align([segments[i] for i in missing]), strict=True):
            out[i] = x
            if len(segments[i]) <= 64:
                new[segments[i]] = x
        return out

    def align(self, segments: list[str]) -> list[Segment]:
        if not segments:
            return []
        together = sum(1 for _ in itertools.takewhile(_PLAIN.fullmatch, segments)) if self.ranked and self.cuts else 0
        whole = [(" " + s).encode() for s in segments]
        text, sizes = b"".join(whole), np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        rest = [x.ids for x in self.a.encode_batch_fast([" " + s for s in segments[together:]], add_special_tokens=False)]
        a = np.array(self.ranked.encode_ordinary(" " + " ".join(segments[:together])) if together else [], dtype=np.int64)
        n_a = np.diff(np.searchsorted(np.cumsum(self.size_a[a]), np.cumsum(sizes[:together]), side="right"), prepend=0)
        a = np.concatenate((a, np.fromiter(itertools.chain.from_iterable(rest), dtype=np.int64)))
        n_a = np.concatenate((n_a, np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))))
        ids_b = self.b.encode(segments, num_threads=1)
        n_b = np.fromiter(map(len, ids_b), dtype=np.int64, count=len(ids_b))
        b = np.fromiter(itertools.chain.from_iterable(ids_b), dtype=np.int64, count=int(n_b.sum()))
        spelled = [b"".join(map(table.__getitem__, ids.tolist())) for table, ids in ((self.bytes_a, a), (self.bytes_b, b))]
        if spelled[0] == spelled[1] == text:
            return self._align(a, n_a, b, n_b)
        # some segment isn't given back: the others stay
        ends = [np.concatenate(([0], np.cumsum(size[ids])))[np.concatenate(([0], np.cumsum(n)))].tolist() for size, ids, n in ((self.size_a, a, n_a), (self.size_b, b, n_b))]
        same = np.array([spelled[0][ends[0][k] : ends[0][k + 1]] == spelled[1][ends[1][k] : ends[1][k + 1]] == w for k, w in enumerate(whole)])
        fine = iter(self._align(a[np.repeat(same, n_a)], n_a[same], b[np.repeat(same, n_b)], n_b[same]))
        return [next(fine) if ok else BAD for ok in same.tolist()]

    def _align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> list[Segment]:
        """Segments from all ids side by side, and how many each segment has."""
        if not len(n_a):
            return []
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends, of_a, of_b, closes = intervals(ends_a, ends_b)
        segment = np.repeat(np.arange(len(n_a)), n_a)[of_a]
        n_links, n_groups = np.bincount(segment, minlength=len(n_a)), np.bincount(segment[closes], minlength=len(n_a))
        group = np.cumsum(closes) - closes
        spelled = self._spell(np.concatenate((a, b)), np.concatenate((group[np.searchsorted(ends, ends_a)] * 2, group[np.searchsorted(ends, ends_b)] * 2 + 1)), np.concatenate(([0], np.cumsum(n_a + n_b))))
        pairs, starts = (a[of_a] << 32 | b[of_b]).astype("<i8").tobytes(), np.concatenate(([0], np.cumsum(n_links * 8))).tolist()
        sizes = np.stack((n_a, n_b, n_groups, n_links), axis=1).astype("<u4").tobytes()
        return [(sizes[16 * k : 16 * k + 16], x, pairs[starts[k] : starts[k + 1]]) for k, x in enumerate(spelled)]

    def _spell(self, ids: np.ndarray, place: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Ids in the order of their place (group, side), in decimals: commas within a side, a bar between sides, a semicolon between groups."""
        order = np.argsort(place, kind="stable")
        ids, place = ids[order], place[order]
        cells = np.zeros((len(ids), self.digits + 1), dtype=np.uint8)
        rest = ids.copy()
        for k in range(self.digits - 1, -1, -1):
            cells[:, k] = 48 + rest % 10
            rest //= 10
        shown = np.ones(cells.shape, dtype=bool)
        for k in range(self.digits - 1):
            shown[:, k] = ids >= 10 ** (self.digits - 1 - k)
        next_place = np.concatenate((place[1:], place[-1:]))
        cells[:, -1] = np.where(next_place == place, ord(","), np.where(place % 2 == 0, ord("|"), ord(";")))
        shown[starts[1:] - 1, -1] = False
        lengths = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))[starts].tolist()
        blob = cells[shown].tobytes()
        return [blob[i:j] for i, j in zip(lengths[:-1], lengths[1:], strict=True)]

    def units(self, texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """(which text, a part of it) of texts that aren't empty, about TOGETHER characters at a time."""
        unit, held = [], 0
        for k, text in enumerate(texts):
            for part in self.pieces(text) if text else ():
                unit.append((k, part))
                held += len(part)
                if held >= TOGETHER:
                    yield unit
                    unit, held = [], 0
        if unit:
            yield unit

    def counts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Id pairs and how many links of the texts hold them, a bounded number of texts at a time."""
        open_text, open_counts, open_ok = -1, Counter(), True  # of a text whose parts are still to come
        for unit in self.units(texts):
            segments = [(k, self.segments(part)) for k, part in unit]
            distinct = list(dict.fromkeys(itertools.chain.from_iterable(s for _, s in segments)))
            known = dict(zip(distinct, self.found(distinct), strict=True))
            bad = {s for s, x in known.items() if x is BAD}
            wrong = {k for k, s in segments if bad and not bad.isdisjoint(s)}
            last, total = unit[-1][0], Counter()
            if open_text >= 0:
                mine = [s for k, s in segments if k == open_text]
                open_ok = open_ok and open_text not in wrong
                for s in mine:
                    open_counts.update(s)
                if last != open_text:
                    if open_ok:
                        yield self._pairs(open_counts)
                    segments, open_text, open_counts, open_ok = [x for x in segments if x[0] != open_text], -1, Counter(), True
                else:
                    continue
            # the last text may go on in the next unit
            total.update(itertools.chain.from_iterable(s for k, s in segments if k not in wrong and k != last))
            if total:
                yield self._pairs(total, known)
            open_text, open_ok = last, last not in wrong
            for k, s in segments:
                if k == last:
                    open_counts.update(s)
        if open_text >= 0 and open_ok:
            yield self._pairs(open_counts)

    def _pairs(self, counts: Counter, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        segments = list(counts)
        held = list(map(_pairs, map(known.__getitem__, segments) if known else self.found(segments)))
        links = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 8
        times = np.repeat(np.fromiter(map(counts.__getitem__, segments), dtype=np.int64, count=len(segments)), links)
        pairs = np.frombuffer(b"".join(held), dtype="<i8")
        order = np.argsort(pairs, kind="stable")
        pairs, times = pairs[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        return pairs[first], np.add.reduceat(times, first)

    def described(self, texts: list[str | None], frequent: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[dict]:
        """n_a, n_b, n_groups, n_links, groups_sha256 of each text; n_best and count_sum over links of frequent pairs; the pairs of the other links. Without frequent ones, the pairs of all links."""
        pairs, counts, best = frequent or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        sums = np.zeros((len(texts), 6), dtype=np.int64)
        hashed: dict[int, hashlib._Hash] = {}
        others: dict[int, list[np.ndarray]] = {}
        wrong = set()
        for unit in self.units(texts):
            segments = [self.segments(part) for _, part in unit]
            distinct = {s: i for i, s in enumerate(dict.fromkeys(itertools.chain.from_iterable(segments)))}
            known = self.found(list(distinct))
            if any(x is BAD for x in known):
                bad = {s for s, i in distinct.items() if known[i] is BAD}
                wrong.update(k for (k, _), s in zip(unit, segments, strict=True) if not bad.isdisjoint(s))
            table = np.zeros((len(known), 6), dtype=np.int64)
            table[:, :4] = np.frombuffer(b"".join(map(_sizes, known)), dtype="<u4").reshape(-1, 4)
            links, of = np.frombuffer(b"".join(map(_pairs, known)), dtype="<i8"), np.repeat(np.arange(len(known)), table[:, 3])
            at = np.minimum(np.searchsorted(pairs, links), max(0, len(pairs) - 1))
            hit = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
            starts = np.concatenate(([0], np.cumsum(table[:, 3])))
            if len(pairs):
                for column, value in ((4, best[at] & hit), (5, np.where(hit, counts[at], 0))):
                    total = np.concatenate(([0], np.cumsum(value, dtype=np.int64)))
                    table[:, column] = total[starts[1:]] - total[starts[:-1]]
            rare_of, rare = of[~hit], links[~hit]
            rare_starts = np.searchsorted(rare_of, np.arange(len(known) + 1))
            sizes = np.array([len(s) for s in segments])
            index = np.fromiter(map(distinct.__getitem__, itertools.chain.from_iterable(segments)), dtype=np.int64, count=int(sizes.sum()))
            begin = np.concatenate(([0], np.cumsum(sizes)))
            sums_here = np.add.reduceat(table[index], begin[:-1], axis=0)
            has_rare = (np.diff(rare_starts) > 0)[index]
            if frequent is None:
                n_links = table[index, 3]
                ends = np.cumsum(n_links)
                flat = links[np.repeat(starts[index] - (ends - n_links), n_links) + np.arange(n_links.sum())]
                bounds = np.concatenate(([0], ends))[begin]
            spelled = list(map(_spelled, known))
            for n, (k, _) in enumerate(unit):
                sums[k] += sums_here[n]
                mine = index[begin[n] : begin[n + 1]]
                text = b";".join(map(spelled.__getitem__, mine.tolist()))
                if k in hashed:
                    hashed[k].update(b";" + text)
                else:
                    hashed[k] = hashlib.sha256(text)
                if frequent is None:
                    others.setdefault(k, []).append(flat[bounds[n] : bounds[n + 1]])
                elif has_rare[begin[n] : begin[n + 1]].any():
                    others.setdefault(k, []).extend(rare[rare_starts[i] : rare_starts[i + 1]] for i in mine[has_rare[begin[n] : begin[n + 1]]].tolist())
        names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
        out = []
        for k in range(len(texts)):
            if k not in hashed or k in wrong:
                out.append(dict.fromkeys(names, 0) | {"groups_sha256": "", "rest": np.zeros(0, np.int64)})
            else:
                out.append(dict(zip(names, sums[k].tolist(), strict=True)) | {"groups_sha256": hashed[k].hexdigest(), "rest": np.concatenate(others[k]) if k in others else np.zeros(0, np.int64)})
        return out

    def groups(self, text: str | None) -> dict | None:
        """All that is found of one text: groups (ids of either side) and links (an id of either side, the bytes that both cover); None where nothing can be aligned."""
        if not text:
            return None
        segments = self.segments(text)
        ids_a, ids_b = self.encoded(segments)
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64) for ids in (ids_a, ids_b))
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends, of_a, of_b, closes = intervals(ends_a, ends_b)
        last = np.flatnonzero(closes)
        spans = zip(np.concatenate(([0], of_a[last][:-1] + 1)).tolist(), (of_a[last] + 1).tolist(), np.concatenate(([0], of_b[last][:-1] + 1)).tolist(), (of_b[last] + 1).tolist(), strict=True)
        links = zip(a[of_a].tolist(), b[of_b].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)
        return {"groups": [{"a": a[i:j].tolist(), "b": b[k:m].tolist()} for i, j, k, m in spans], "links": [dict(zip(("a", "b", "start", "end"), x, strict=True)) for x in links]}


@functools.lru_cache(maxsize=1)
def worker_aligner(a: bytes, b: bytes) -> Aligner:
    """One aligner for all tasks of a worker process."""
    return Aligner(a, b)


def _listed(texts: pa.Array, rows: int = 512) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, groups (array of the A ids and the B ids that cover the same bytes) and links (array of A id, B id, and the bytes of a space and the text that both cover); null where there is nothing to align."""
    require(df, id_col, text_col)
    bound_batches(df.sparkSession)
    a, b = read_file(a_path), read_file(b_path)
    kind = "groups array<struct<a:array<int>,b:array<int>>>, links array<struct<a:int,b:int,start:long,end:long>>"
    ids = pa.list_(pa.int32())
    arrow = pa.struct([("groups", pa.list_(pa.struct([("a", ids), ("b", ids)]))), ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = worker_aligner(a, b)
        for texts in batches:
            yield pa.array([aligner.groups(t.as_py()) for t in texts], arrow)
        tidy()

    return df.select(quoted(id_col).alias(id_col), run(quoted(text_col)).alias("_r")).select(id_col if "." not in id_col else quoted(id_col), "_r.groups", "_r.links")


def products(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, group, a, b: every A id with every B id of each group of align()."""
    each = aligned.select(quoted(id_col), F.posexplode("groups").alias("group", "g")).select(quoted(id_col), "group", F.explode("g.a").alias("a"), "g.b")
    return each.select(quoted(id_col), "group", "a", F.explode("b").alias("b"))


def link_counts(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """pair (A id times 2^32 and B id), n (links of all rows that hold it), best (whether no pair of its B id has more)."""
    require(df, text_col)
    bound_batches(df.sparkSession)
    a, b = read_file(a_path), read_file(b_path)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(a, b)
        for batch in batches:
            for texts in _listed(batch.column(0)):
                for pairs, n in aligner.counts(texts):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return _totals(df.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "pair long, n long"))


def _totals(parts: DataFrame) -> DataFrame:
    """pair, n, best from parts (pair, n) of the sums."""
    counts = checkpoint(parts.groupBy("pair").agg(F.sum("n").alias("n")))
    most = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


#: Links whose pairs are counted together.
COUNTED = 1 << 21


def packed(pairs: np.ndarray) -> bytes:
    """Pairs of ids, in two bytes an id where that is enough, compressed."""
    short = not len(pairs) or int(max((pairs >> 32).max(), (pairs & 0xFFFFFFFF).max())) < 1 << 16
    plain = ((pairs >> 32 << 16) | (pairs & 0xFFFF)).astype("<u4").tobytes() if short else pairs.astype("<i8").tobytes()
    return bytes([short]) + len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(plain, asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    plain = pa.Codec("zstd").decompress(blob[9:], int.from_bytes(blob[1:9], "little"), asbytes=True)
    if not blob[0]:
        return np.frombuffer(plain, dtype="<i8")
    short = np.frombuffer(plain, dtype="<u4").astype(np.int64)
    return short >> 16 << 32 | short & 0xFFFF


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair and how many of the packed links hold it, a bounded number of links at a time."""
    held, n = [], 0
    for blob in itertools.chain((x for batch in batches for x in batch.column(0)), [None]):
        if blob is not None:
            held.append(unpacked(blob.as_py()))
            n += len(held[-1])
        if held and (blob is None or n >= COUNTED):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], ["pair", "n"])
            held, n = [], 0


def describe(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair no pair of their B id outnumbers), count_sum (of the links' pairs' counts), groups_sha256 of each row. Other columns are left out."""
    require(df, id_col, text_col)
    spark, a, b = df.sparkSession, read_file(a_path), read_file(b_path)
    names = ("n_a", "n_b", "n_groups", "n_links")
    arrow = pa.struct([*((n, pa.int64()) for n in names), ("groups_sha256", pa.string()), ("links", pa.binary())])

    @F.arrow_udf(", ".join(f"{n} long" for n in names) + ", groups_sha256 string, links binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = worker_aligner(a, b)
        for texts in batches:
            yield pa.chunked_array([pa.array([x | {"links": packed(x["rest"])} for x in aligner.described(part)], arrow) for part in _listed(texts)], arrow).combine_chunks()
        tidy()

    row, id_ = fresh(df, "row", "id")
    found = checkpoint(df.select(quoted(id_col).alias(id_), run(text_or_empty(text_col)).alias("r"))).select(id_, "r.*")
    counts = checkpoint(_totals(found.select("links").mapInArrow(tidied(_counted), "pair long, n long")))
    common = counts.where(F.col("n") > kth_largest(counts, "n", frequent)) if counts.limit(frequent + 1).count() > frequent else counts
    common = common.toPandas().sort_values("pair")  # of `frequent` rows at most
    held = spark.sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), common["best"].to_numpy(bool)))
    sums = pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", pa.list_(pa.int64()))])

    @F.arrow_udf("n_best long, count_sum long, rest array<long>")
    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs, n, best = held.value
        for blobs in batches:
            out = []
            for links in (unpacked(x.as_py()) for x in blobs):
                at = np.minimum(np.searchsorted(pairs, links), max(0, len(pairs) - 1))
                hit = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
                at = at[hit]
                out.append({"n_best": int(np.count_nonzero(best[at])), "count_sum": int(n[at].sum()), "rest": links[~hit]})
            yield pa.array(out, sums)
        tidy()

    rows = found.select(id_, *names, "groups_sha256", summed("links").alias("s")).withColumn(row, F.monotonically_increasing_id())
    rows = checkpoint(rows).select(id_, *names, "groups_sha256", "s.*", row)
    more = rows.where(F.size("rest") > 0).select(row, F.explode("rest").alias("pair")).groupBy(row, "pair").agg(F.count("*").alias("times")).join(counts, "pair")
    more = more.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    plus = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return rows.join(more, row, "left").select(F.col(id_).alias(id_col), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
