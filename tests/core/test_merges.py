import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import merges, tokenizer


def plain(counts, size, least):
    """The greedy rule with all pairs counted anew for each merge; words are lists of token strings."""
    letters = tokenizer.byte_letters()
    ids = {t: i for i, t in enumerate(tokenizer.first_tokens())}
    words, out = [([letters[b] for b in w.encode()], n) for w, n in counts.items()], []
    while len(ids) < size:
        pairs = {}
        for w, n in words:
            for p in zip(w, w[1:]):
                pairs[p] = pairs.get(p, 0) + n
        best = min(pairs, key=lambda p: (-pairs[p], ids[p[0]], ids[p[1]]), default=None)
        if best is None or pairs[best] < least:
            break
        out.append(best)
        ids.setdefault("".join(best), len(ids))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = ["".join(best)]
                i += 1
    return list(ids), out


def counts(seed, alphabet="abc", words=60, most=9):
    r = random.Random(seed)
    return {"".join(r.choices(alphabet, k=r.randint(1, most))): r.choice([1, 1, 2, 3, 3, 50]) for _ in range(words)}


@pytest.mark.parametrize("seed", range(8))
def test_rule_in_memory(seed):
    for alphabet in ("ab", "abcde", "é😀 x"):
        found = counts(seed, alphabet)
        assert tokenizer.learn_merges(found, 330, 2) == plain(found, 330, 2)


@pytest.mark.parametrize("seed, pairs, most", [(1, 4096, 200_000), (2, 5, 200_000), (3, 1, 200_000), (4, 64, 12), (5, 3, 4)])
def test_any_bounds_give_the_same_merges(spark, seed, pairs, most):
    """Levels of one pair up to all of them, with ties of many more pairs than a level takes."""
    found = counts(seed, "abcd", 30, 6)
    vocabulary = merges.Vocabulary(tokenizer.first_tokens())
    words = spark.createDataFrame(list(found.items()), "w string, n long").select(tokenizer.byte_ids(F.col("w")).alias("s"), "n")
    got = merges.learn_from(words, vocabulary, 275, 2, pairs, most)
    want = plain(found, 275, 2)
    assert (vocabulary.tokens, [(vocabulary.tokens[a], vocabulary.tokens[b]) for a, b, _ in got]) == want


def test_merges_that_spell_a_known_token():
    """xyz by (x, yz) first and by (xy, z) later: the level ends there, and the rule goes on from all words."""
    found = {"yz": 100, "xyz": 50, "xyy": 60, "axy": 70, "xyzxyz": 9, "xxyyzz": 7, "aaaa": 30, "aaa": 31, "aa": 5}
    assert tokenizer.learn_merges(found, 290, 1) == plain(found, 290, 1)


def test_stretches_and_rewrites(spark):
    words = [[1, 2, 3], [1, 2], [], [5], [2, 1, 2, 3, 9, 1, 2], [7, 7, 7, 7], [3, 1]]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, s array<int>").coalesce(1)
    cut = [r.x for r in df.orderBy("k").select(merges.stretches(F.col("s"), [(1, 2), (2, 3), (7, 7)]).alias("x")).collect()]
    assert cut == [[[1, 2, 3]], [[1, 2]], [], [], [[1, 2, 3], [1, 2]], [[7, 7, 7, 7]], []]
    whole = [r.x for r in df.orderBy("k").select(merges.stretches(F.col("s"), [(1, 2)], True).alias("x")).collect()]
    assert whole == [[words[0]], [words[1]], [], [], [words[4]], [], []]
    new = [r.x for r in df.orderBy("k").select(merges.rewrite(F.col("s"), [(7, 7, 10), (1, 2, 11), (10, 10, 12), (11, 3, 13)]).alias("x")).collect()]
    assert new == [[13], [11], [], [5], [2, 13, 9, 11], [12], [3, 1]]
    assert df.limit(0).select(merges.stretches(F.col("s"), [(1, 2)])).collect() == []


def test_training_equals_the_library(spark, sf):
    """The default vocabulary, learned from a table, against the trainer of the tokenizers library."""
    import json

    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = Tokenizer(models.BPE(unk_token="<unk>"))
    library.normalizer, library.pre_tokenizer = normalizers.NFKC(), pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = trainers.BpeTrainer(vocab_size=32_000, min_frequency=2, special_tokens=list(tokenizer.SPECIALS), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False)
    library.train_from_iterator((r.text for r in docs.select("text").collect()), trainer)
    want, got = json.loads(library.to_str())["model"], json.loads(tokenizer.train(docs))["model"]
    assert got["vocab"] == want["vocab"] and got["merges"] == want["merges"]


@pytest.mark.parametrize("frequent", [tokenizer.FREQUENT, 30, 1])
def test_distinct_words_encoded_once_equal_the_library(spark, frequent):
    from tokenizers import Tokenizer

    lines = ["The quick brown fox jumps over the lazy dog.", "the the the", "Numbers 123 and symbols !?", "日本語 and émoji 😀", "it's  two  spaces\n\n \tend ", "ｆｕｌｌ width ﬁ", "", None, " ", "a", "the the the"]
    df = spark.createDataFrame([(k % 7, t, "x") for k, t in enumerate(lines)], "pos int, text string, n string").repartition(3)
    spec = tokenizer.train(df, 300)
    library = Tokenizer.from_str(spec)
    out = tokenizer.encode_distinct(df, spec, frequent=frequent)
    assert out.columns == ["pos", "text", "n", "ids"]
    assert sorted((r.pos, r.text or "", r.ids or []) for r in out.collect()) == sorted((k % 7, t or "", library.encode(t or "").ids) for k, t in enumerate(lines))
    assert [r.ids for r in out.where("text IS NULL").collect()] == [None]
    ends = tokenizer.encode_distinct(df, spec, bos=True, eos=True).where("text = ''").first().ids
    assert ends == [tokenizer.BOS, tokenizer.EOS]
    assert tokenizer.encode_distinct(df.limit(0), spec).collect() == []
    table = {(r.first, r.second): r.made for r in tokenizer.merge_table(spark, spec).collect()}
    vocab = {i: t for t, i in Tokenizer.from_str(spec).get_vocab().items()}
    assert len(table) == len(vocab) - 260 > 0 and all(vocab[a] + vocab[b] == vocab[c] for (a, b), c in table.items())
