import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexweave.llm import alignment
from lexweave.llm.common import read_file, table
from lexweave.operators.tokenizer import byte_letters
from tests.llm.cases import empty, frame, key, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Rows (id, text): whole texts through the libraries, all pairs of tokens compared within reach."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(byte_letters())}
    seen, counts = [], Counter()
    for i, text in rows:
        found = None
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            sa = [bytes(byte[c] for c in one.id_to_token(x)) for x in a]
            sb = [bytes([int(two.id_to_piece(x)[3:-1], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(sa) == b"".join(sb) == (" " + text).encode():
                ends = []
                for parts in (sa, sb):
                    at, out = 0, []
                    for p in parts:
                        at += len(p)
                        out.append(at)
                    ends.append(out)
                shared = sorted({*ends[0]} & {*ends[1]})
                groups, links, x, y, j0 = [], [], 0, 0, 0
                for end in shared:
                    ga = [a[k] for k in range(x, len(a)) if ends[0][k] <= end] if len(a) < 300 else []
                    u, v = x, y
                    while u < len(a) and ends[0][u] <= end:
                        u += 1
                    while v < len(b) and ends[1][v] <= end:
                        v += 1
                    assert not ga or ga == a[x:u]
                    groups.append((a[x:u], b[y:v]))
                    x, y = u, v
                for i2 in range(len(a)):
                    low, high = ends[0][i2] - len(sa[i2]), ends[0][i2]
                    while ends[1][j0] <= low:
                        j0 += 1
                    j = j0
                    while j < len(b) and ends[1][j] - len(sb[j]) < high:
                        links.append((a[i2], b[j]))
                        j += 1
                found = (a, b, groups, links)
                counts.update(links)
        seen.append((i, found))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, found in seen:
        if not found:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = found
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(spelled.encode()).hexdigest()))
    return key(out)


def got(df, **more):
    return key(map(tuple, alignment.describe(df, A, B, **more).collect()))


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 50])
def test_documents(spark, sf, frequent):
    docs = table(spark, sf, "documents")
    assert got(docs, frequent=frequent) == plain([(r.doc_id, r.text) for r in docs.collect()])


def odd_texts():
    r = random.Random(4)
    parts = ["a", " ", "  ", "\n", " \n", "\n ", "\t", "é", "中文", "😀", "▁", "<|endoftext|>", "<s>", "<0x41>", "word", "Word's", "12345", " ", "　", "\r\n", "...", "ﬁ", "\x00", "x" * 40, "don't", "á"]
    return [(k, "".join(r.choices(parts, k=r.randint(1, 30)))) for k in range(150)]


def test_odd_texts(spark, monkeypatch):
    rows = [*texts(), *odd_texts(), (500, " "), (501, "  x"), (502, "x  "), (503, "\n"), (504, " \n x"), (None, "again"), (None, "again")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, pair string, n int").repartition(2)
    assert got(df) == plain(rows)
    assert got(df.withColumnRenamed("doc_id", "a.b"), id_col="a.b") == plain(rows)


def test_long_texts_in_pieces(monkeypatch):
    """Parts of a text that is read a piece at a time give what the whole gives; a part that can't be aligned spoils the whole text only."""
    aligner = alignment.Aligner(read_file(A), read_file(B), known=50)
    rows = [t for _, t in odd_texts()] + ["one two  three\n four " * 40, "▁" + " five" * 90, "six " * 200 + "▁"]
    none = tuple(__import__("numpy").zeros(0, t) for t in ("int64", "int64", "bool"))
    whole, counted = aligner.described(rows, none), sum_of(aligner.counts(rows))
    monkeypatch.setattr(alignment, "TOGETHER", 16)
    parts = aligner.described(rows, none)
    strip = lambda found: [{k: sorted(v) if k == "rest" else v for k, v in x.items()} for x in found]
    assert strip(whole) == strip(parts)
    assert sum_of(aligner.counts(rows)) == counted
    assert sum(counted.values()) == sum(x["n_links"] for x in whole)


def sum_of(found):
    out = Counter()
    for pairs, n in found:
        out.update(dict(zip(pairs.tolist(), n.tolist(), strict=True)))
    return out


def test_real_outputs(spark):
    rows = [(1, "Cross-tokenizer alignment, naïvely."), (2, None), (3, "▁"), (4, "")]
    out = {r.doc_id: r for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert out[2].groups is None and out[3].links is None and out[4].groups is None
    a = Tokenizer.from_file(A).encode(" " + rows[0][1], add_special_tokens=False).ids
    assert [x for g in out[1].groups for x in g.a] == a
    assert [x for g in out[1].groups for x in g.b] == sentencepiece.SentencePieceProcessor(model_file=B).encode(rows[0][1])
    assert out[1].links[0].start == 0 and out[1].links[-1].end == len((" " + rows[0][1]).encode())
    pairs = alignment.products(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)).collect()
    assert len(pairs) == sum(len(g.a) * len(g.b) for g in out[1].groups)
    assert {(x.a, x.b) for x in out[1].links} <= {(r.a, r.b) for r in pairs}


def test_edge_tables(spark):
    assert got(empty(spark)) == []
    assert got(frame(spark)) == plain(texts())


def test_texts_are_encoded_once(spark, monkeypatch):
    """The counts come from stored links; texts were encoded for them, and again for the rows."""

    def again(*a, **b):
        raise AssertionError("texts are read a second time")

    monkeypatch.setattr(alignment, "link_counts", again)
    monkeypatch.setattr(alignment, "COUNTED", 7, raising=False)
    assert got(frame(spark)) == plain(texts())
    for pairs in ([], [(1 << 32) + 2, (65535 << 32) + 65535], [(65536 << 32) + 1], [(5 << 32) + 70000]):
        assert alignment.unpacked(alignment.packed(alignment.np.array(pairs, dtype="int64"))).tolist() == pairs
