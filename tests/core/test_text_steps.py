import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import dedup, quality, split
from lexweave.operators.clean import CleanOptions, clean


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos long, text string")


def texts(df, col="text"):
    return [r[col] for r in df.orderBy("pos").collect()]


def test_white_space_is_the_29_characters(spark):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, chr(c)) for c in points if c < 0x4000 or chr(c).isspace()], "c int, x string")
    found = {r.c for r in rows.where(F.col("x").rlike(f"^[{tx.WS}]$")).collect()}
    assert found == {c for c in points if chr(c).isspace()} and len(found) == 29


def test_strip_and_normalize(spark):
    some = ["  a  B　", "\x1cx\x85", "", " \n ", "ÀÉ  z"]
    got = docs(spark, some).select("pos", tx.strip(F.col("text")).alias("s"), tx.normalize(F.col("text")).alias("n"))
    assert texts(got, "s") == [t.strip() for t in some] and texts(got, "n") == [" ".join(t.lower().split()) for t in some]


@pytest.mark.parametrize("text, want", [("<p>Hello   <b>x</b></p>\n\n\n\nEnd", "Hello x\n\nEnd"), ("a\n \n \n \nb", "a\n\n\n\nb"), ("a\rb", "ab"), ("Ａ", "A"), ("＜p＞", "<p>"), ("x\x00\x01y\nz", "xy\nz"), ("​q­", "q")])
def test_clean(spark, text, want):
    assert texts(clean(docs(spark, [text]))) == [want]


def test_clean_options(spark):
    d = docs(spark, ["see https://a.b/c now www.x.y!", "short\nlong enough line\n\nx", "<br>", None])
    assert texts(clean(d, CleanOptions(url_replacement="$0\\"))) == ["see $0\\ now $0\\", "short\nlong enough line\n\nx"]
    assert texts(clean(d, CleanOptions(min_line_length=6)))[1] == "long enough line"
    assert clean(d, CleanOptions(strip_html=False)).count() == 3
    with pytest.raises(KeyError):
        clean(d, text_col="absent")
    with pytest.raises(ValueError):
        CleanOptions(min_line_length=-1)
    assert texts(d.select("pos", tx.nfkc(F.col("text")).alias("text")))[0] == unicodedata.normalize("NFKC", "see https://a.b/c now www.x.y!")


def test_quality(spark):
    good = "This is a perfectly reasonable sentence with quite enough words in it to pass."
    some = [good, "short", "#### $$$$ %%%% " * 10, "same line here now\n" * 10 + "one other", "", None]
    got = quality.verdict(docs(spark, some)).orderBy("pos").collect()
    assert [r.reasons for r in got] == [[], ["too_short", "too_few_words"], ["too_many_symbols", "too_few_alpha_chars"], ["too_repetitive"], ["too_short", "too_few_words"], ["too_short", "too_few_words"]]
    kept, rejected = quality.route(docs(spark, some))
    assert texts(kept) == [good] and rejected.count() == 5 and rejected.columns == ["pos", "text", "_reject_reasons"]
    said = [r.messages for r in quality.messages(quality.verdict(docs(spark, some[:3]))).orderBy("pos").collect()]
    assert said[1] == ["too_short (5 < 50)", "too_few_words (1 < 10)"] and said[2][0] == "too_many_symbols (1.00 > 0.3)"
    for bad in ({"min_chars": -1}, {"max_chars": 3}, {"max_symbol_ratio": 1.5}):
        with pytest.raises(ValueError):
            quality.QualityOptions(**bad)


def test_ratio_at_its_limit_passes(spark):
    half = quality.QualityOptions(min_chars=0, min_words=0, max_repetition_ratio=0.5, max_symbol_ratio=0.5)
    assert [r.passed for r in quality.verdict(docs(spark, ["a a\na a", "a#", "a##"]), half).orderBy("pos").collect()] == [True, True, False]


def test_exact_dedup(spark):
    d = docs(spark, ["Hello World", "hello   world ", "other", "Hello World", None, ""])
    assert [r.pos for r in dedup.exact_dedup(d).orderBy("pos").collect()] == [0, 2, 4]
    assert [(r.first_pos, r.n) for r in dedup.duplicate_clusters(docs(spark, ["a", "A ", "b"])).collect()] == [(0, 2)]


def walk(sets, bands):
    """The drop walk by its definition: buckets in order of first member and band, pairs ascending, both still there."""
    buckets = {}
    for i, b in enumerate(bands):
        for k, h in enumerate(b):
            buckets.setdefault((k, h), []).append(i)
    gone = set()
    for (_, _), members in buckets.items():
        for x, i in enumerate(members):
            for j in members[x + 1 :]:
                a, b = sets[i], sets[j]
                if i in gone or j in gone:
                    continue
                if (1.0 if not a and not b else len(a & b) / len(a | b)) >= 0.5:
                    gone.add(j)
    return gone


@pytest.mark.parametrize("hash, seed", [("xxhash64", 3), ("xxhash64", 4), ("xxhash64", 5), ("blake2b", 3)])
def test_near_dedup_is_the_walk(spark, hash, seed):
    import random

    r = random.Random(seed)
    base = [f"w{i}" for i in range(30)]
    some = [" ".join(r.choice("pqr") if r.random() < r.choice([0, 0.05, 0.1, 0.2]) else w for w in base) for _ in range(25)] + ["", "  ", "entirely different words stand here"]
    some += [r.choice(some) for _ in range(12)]  # sets that repeat
    r.shuffle(some)
    d = docs(spark, some)
    got = {x.pos for x in d.join(dedup.near_dedup(d, shingle_size=3, num_perm=32, num_bands=16, similarity_threshold=0.5, hash=hash), "pos", "left_anti").collect()}
    rows = dedup.signatures(d, "text", "pos", 3, 32, hash).orderBy("pos").collect()
    sets = [set(x.set) for x in dedup.shingle_sets(d, "text", "pos", 3).orderBy("pos").collect()]
    assert len({x.key for x in rows}) == len({frozenset(x) for x in sets})
    assert got == walk(sets, [[tuple(x.signature[k * 2 : k * 2 + 2]) for k in range(16)] for x in rows])
    with pytest.raises(ValueError):
        dedup.similar_pairs(d, num_perm=64, num_bands=10)
    with pytest.raises(ValueError):
        dedup.similar_pairs(d, similarity_threshold=1.5)


def test_shingles_and_jaccard(spark):
    d = dedup.shingle_sets(docs(spark, ["a b c d", "a b", "", "x x x x"]), "text", "pos", 3)
    assert [r.set for r in d.orderBy("pos").collect()] == [["a b c", "b c d"], ["a b"], [], ["x x x"]]


def test_split(spark):
    d = spark.range(100).select(F.col("id").alias("pos"))
    got = split.split(d, 0.8, 0.1, 0.1, seed=7)
    first = {r.pos: r.split for r in got.collect()}
    assert first == {r.pos: r.split for r in split.split(d.repartition(7), 0.8, 0.1, 0.1, seed=7).collect()}
    counts = [list(first.values()).count(s) for s in split.SPLITS]
    assert counts == [80, 10, 10] and split.cut_points(3, 0.5, 0.5) == (2, 4) and split.cut_points(5, 0.5, 0.5) == (2, 4)
    import random

    order = list(range(100))
    random.Random(7).shuffle(order)
    parity = {r.pos: r.split for r in split.split(d, 0.8, 0.1, 0.1, seed=7, mode="parity").collect()}
    assert [parity[i] for i in order] == ["train"] * 80 + ["validation"] * 10 + ["test"] * 10
    assert 60 < split.split(d, 0.8, 0.1, 0.1, mode="scalable").where("split = 'train'").count() < 95
    for bad in ((0.5, 0.1, 0.1), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            split.split(d, *bad)
    with pytest.raises(ValueError):
        split.split(d.limit(0))


def test_exact_dedup_where_positions_repeat(spark):
    d = spark.createDataFrame([(0, "a b"), (0, "c"), (1, "A  b"), (1, "d"), (2, None), (3, "")], "pos long, text string")
    assert sorted((r.pos, r.text or "") for r in dedup.exact_dedup(d).collect()) == [(0, "a b"), (0, "c"), (1, "d"), (2, "")]


def test_running_sums_in_chunks(spark, monkeypatch):
    from lexweave.functions import prefix

    rows = [(int(i * 7919 % 5003), int(i % 5)) for i in range(3000)]
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k], total = total, total + v
    for size in (10**6, 100, 7):
        monkeypatch.setattr(prefix, "RANGE_ROWS", size)
        out = prefix.running(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", "before")
        assert {r.k: r.before for r in out.collect()} == want and out.columns == ["k", "v", "before"]


def test_ranks_of_texts(spark, monkeypatch):
    """Texts, ties of the first column, nulls in the value; ranks without a value."""
    from lexweave.functions import prefix

    monkeypatch.setattr(prefix, "RANGE_ROWS", 11)
    rows = [(f"{'é' * (i % 3)}k{i * 37 % 101}", i % 4, None if i % 5 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b int, v int").repartition(5)
    ordered = sorted({(a.encode(), b) for a, b, _ in rows})
    got = {(r.a.encode(), r.b): r.at for r in prefix.placed(df.dropDuplicates(["a", "b"]), ["a", "b"], None, "at").collect()}
    assert got == {k: i for i, k in enumerate(ordered)}
    sums, total = {}, 0
    for a, b, v in sorted(rows, key=lambda r: (r[0].encode(), r[1])):
        sums[a, b] = total
        total += v or 0
    if len(sums) == len(rows):
        assert {(r.a, r.b): r.at for r in prefix.placed(df, ["a", "b"], "v", "at").collect()} == sums
    assert prefix.placed(df.limit(0), ["a"], None, "at").collect() == []


def test_white_space_strings_agree(spark):
    assert len(tx.SPACES) == 29 and all(c.isspace() for c in tx.SPACES)


def test_quick_check_lets_no_text_pass_that_changes(spark):
    """Every character alone, and after and before others: what the native test lets pass is its own normal form."""
    import unicodedata

    ranges = tx.unchanging()
    known = [c for a, b in ranges for c in (a, b)]
    assert all(unicodedata.is_normalized("NFKC", chr(c)) for a, b in ranges for c in range(a, b + 1))
    r = __import__("random").Random(3)
    assert all(unicodedata.is_normalized("NFKC", "".join(chr(r.choice(known)) for _ in range(6))) for _ in range(20_000))
    some = ["plain", "é", "e\u0301", "\uff41b", "ﬁ", "한", "\u1112\u1161\u11ab", "\uac00\u11a8", "\u0345\u0301", "中文", "x\u0338", "²", "a\u00a0b", "\u2126", "ß", "İ", "ñandú", "", None, "Ж", "がか\u3099"]
    df = docs(spark, some)
    out = df.select("pos", "text", tx.may_change(F.col("text")).alias("sent"), tx.nfkc(F.col("text")).alias("made")).collect()
    for x in out:
        assert x.made == (None if x.text is None else unicodedata.normalize("NFKC", x.text))
        assert x.sent or x.text is None or x.made == x.text
    assert {x.text: x.sent for x in out}["ñandú"] is False and {x.text: x.sent for x in out}["中文"] is False
