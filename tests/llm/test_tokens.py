import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from lexweave.llm import bpe_codec, piece_count
from lexweave.llm.common import table
from tests.llm.cases import empty, frame, key, texts

RANKS, MODEL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    ranks = bpe_codec.load_ranks(open(RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe_codec.load_ranks(open(RANKS, "rb").read())


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe_codec.TreeCodec(ranks, public_tokenizers.PATTERN, known=5000)


def plain_merge(data, ranks):
    """The encoding by its definition."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


def strings(n, seed=7):
    r = random.Random(seed)
    alphabets = ["ab", "a b\n", "aé ñ中😀\t ' s1", "the and ", "  \n\r\x1c\x85x.!'", "0123456789 ", "abcdefghijklmnopqrstuvwxyz", "\u3000 \u00a0x"]
    for _ in range(n):
        a = r.choice(alphabets)
        yield "".join(r.choice(a) for _ in range(r.choice([0, 1, 3, 10, 60, 400])))
    yield from ("a" * 20_000, " " * 3000 + "x", "ab" * 5000, "the" * 2000, "\x00a", "<|endoftext|> <s>", "▁a▁▁b", "a ▁b", "it's  we'll")


def test_encode_equals_the_library(codec, library):
    for s in strings(600):
        ids = codec.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(s), repr(s[:80])
        assert codec.decode(ids) == s.encode()


@pytest.mark.parametrize("leaf", [1, 2, 5, 16])
def test_any_leaf_gives_the_same(leaf, ranks, library):
    other = bpe_codec.TreeCodec(ranks, public_tokenizers.PATTERN, leaf=leaf)
    some = list(strings(200, seed=leaf))
    for s, ids in zip(some, other.encode_all(some), strict=True):
        assert ids.tolist() == library.encode_ordinary(s), repr(s[:80])
        assert other.decode(ids.tobytes()) == s.encode()


def test_tree_of_bytes_equals_the_definition(ranks):
    """Whole strings without a pattern go up the tree, all at once; among them runs on which windows grow far."""
    r = random.Random(1)
    items = ["".join(r.choice(a) for _ in range(n)).encode() for a in ("a", "ab", "abehnrt ", "aé中 ", "the") for n in (1, 2, 3, 5, 8, 9, 17, 40, 130, 300)] + [b"aab" * 90, bytes(range(256)) * 2]
    for leaf in (1, 3, 8):
        tokens, at = bpe_codec.TreeCodec(ranks, public_tokenizers.PATTERN, leaf=leaf).tree(items)
        assert [tokens[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain_merge(x, ranks) for x in items]


def test_long_windows_are_merged_by_heap(codec, ranks):
    for data in (b"a" * 700, b"abcab" * 60, "中文字".encode() * 30):
        assert codec.merge_long(data) == plain_merge(data, ranks)


@pytest.mark.parametrize("pattern", [r"[0-9 ]{1,3}", r"\p{L}+|\s+|.", r"(?s).{1,7}"])
def test_other_patterns_are_not_cut_at_spaces(pattern, ranks):
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe_codec.TreeCodec(ranks, pattern)
    for s in ("12 34 567", " 1  2 ", "the cat sat", "a b  c\n d "):
        assert np.frombuffer(codec.encode(s), "<u4").tolist() == library.encode_ordinary(s)


def test_the_public_pattern_is_cut_at_spaces(codec):
    assert codec.cuts and public_tokenizers.PATTERN in bpe_codec.CUT_AT_SPACES


def test_decoding_goes_up_the_tree(codec, library, monkeypatch):
    calls = []
    whole = bpe_codec.TreeCodec._concat
    monkeypatch.setattr(bpe_codec.TreeCodec, "_concat", lambda self, ids: calls.append(len(ids)) or whole(self, ids))
    s = "the cat sat on a mat " * 400
    assert codec.decode(codec.encode(s)) == s.encode()
    assert len(calls) > 7 and max(calls) == len(library.encode_ordinary(s))


def test_digest_of_the_table(spark, sf, library):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in bpe_codec.digest(table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN).collect()}
    for doc_id, text in rows:
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert got[doc_id][1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), True)


def test_codec_edge_rows(spark, library):
    out = bpe_codec.encode(frame(spark), RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "ids"]
    got = bpe_codec.decode(out.withColumn("n", bpe_codec.ids_as_array(out.ids)), RANKS, public_tokenizers.PATTERN).collect()
    want = [(i, t, library.encode_ordinary(t)) for i, t in texts()]
    assert key((r.doc_id, bytes(r.decoded).decode(), r.n) for r in got) == key(want)
    assert bpe_codec.digest(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = piece_count.PieceCounter(open(MODEL, "rb").read(), memo=5000)
    for s in strings(600):
        assert counter.count(s) == len(sp.encode(s)), repr(s[:80])


def test_counts_of_the_table(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = table(spark, sf, "documents")
    want = [(r.doc_id, len(r.text.encode()), n := len(sp.encode(r.text)), n > 4096) for r in docs.collect()]
    assert key(map(tuple, piece_count.count_tokens(docs, MODEL).collect())) == key(want)


def test_count_edge_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len(t.encode()), n := len(sp.encode(t)), n > 10) for i, t in texts()]
    assert key(map(tuple, piece_count.count_tokens(frame(spark), MODEL, limit=10).collect())) == key(want)
    assert piece_count.count_tokens(empty(spark), MODEL).count() == 0
    with pytest.raises(KeyError):
        piece_count.count_tokens(frame(spark), MODEL, text_col="absent")
