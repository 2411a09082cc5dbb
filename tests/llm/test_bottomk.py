import random
import re

import numpy as np
import pytest

from lexweave.llm import bottomk
from lexweave.llm.common import table, word_hashes
from tests.llm.cases import empty, frame, key, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain(rows):
    """Rows (id, text) by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    above = {i: i for i, _ in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    have = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(have):
        for j, t in have[:k]:
            if 100 * len(s & t) >= 75 * len(s | t) and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return key((i, len(s), top(i), i is None or top(i) == i) for i, s in sets)


def got(df):
    return key(map(tuple, bottomk.near_duplicates(df).collect()))


def test_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert got(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    assert got(frame(spark)) == plain(texts())
    assert bottomk.near_duplicates(empty(spark)).collect() == []


def edited(words, r, share):
    return [r.choice("pqrst") + str(r.randint(0, 9999)) if r.random() < share else w for w in words]


@pytest.mark.parametrize("short, rows, seed", [(64, 1024, 1), (4, 1024, 2), (4, 16, 3), (2, 8, 4)])
def test_groups_and_passages(spark, monkeypatch, short, rows, seed):
    """Dense groups of near copies, a passage in most texts; long lists and small blocks forced."""
    monkeypatch.setattr(bottomk, "SHORT", short)
    monkeypatch.setattr(bottomk, "BLOCK_ROWS", rows)
    r = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(30)]
    made = []
    for i in range(90):
        made.append(edited(base, r, r.choice([0, 0.01, 0.02, 0.04, 0.06])))
    for i in range(40):
        made.append([f"x{r.randint(0, 10**6)}" for _ in range(r.randint(10, 80))] + passage)
    for i in range(20):
        made.append(edited(passage, r, 0.03))
    r.shuffle(made)
    data = [(100 + i, " ".join(w), None) for i, w in enumerate(made)]
    assert got(frame(spark, data)) == plain([x[:2] for x in data])


@pytest.mark.parametrize("seed", [3, 31])
def test_popular_passage_inside_a_group(spark, seed):
    """A member of a large group also holds a passage that more documents share than the group has; 11 of its sketch's values are the passage's."""
    r = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(150)]
    passage = [f"p{seed}x{i}" for i in range(46)]
    made = [[*base, f"own{i}"] for i in range(80)] + [[*passage, *(f"y{i}x{k}" for k in range(40))] for i in range(120)]
    made.append([*passage, *base])
    r.shuffle(made)
    data = [(100 + i, " ".join(w), None) for i, w in enumerate(made)]
    assert got(frame(spark, data)) == plain([x[:2] for x in data])


def test_two_popular_passages_in_one_group(spark):
    """35 documents hold a common text and passage one, 35 the same and passage two; passage one stands in 200 others. All of the group are linked."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    common, one, two = words("c", 132), words("p", 20), words("q", 20)
    made = [[*common, *one, f"o{i}"] for i in range(35)] + [[*common, *two, f"t{i}"] for i in range(35)] + [[*words(f"z{i}x", 60), *one] for i in range(200)]
    data = [(i, " ".join(w), None) for i, w in enumerate(made)]
    assert got(frame(spark, data)) == plain([x[:2] for x in data])
    assert {r.component_id for r in bottomk.near_duplicates(frame(spark, data[:70])).collect()} == {0}


@pytest.mark.parametrize("rows, few", [(8, 0), (12, 2)])
def test_long_lists_in_every_form(spark, monkeypatch, rows, few):
    """Blocks so small that lists are dealt in many: rounds inside blocks, the largest group against the others, wider sketches."""
    for name, value in (("SHORT", 3), ("BLOCK_ROWS", rows), ("FEW_BLOCKS", few)):
        monkeypatch.setattr(bottomk, name, value)
    r = random.Random(rows + few)
    made = []
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(120)]
        made += [edited(base, r, r.choice([0, 0.01, 0.03, 0.05])) for _ in range(25)]
    template = [f"t{i}" for i in range(80)]
    for i in range(50):
        own = [f"u{i // 2}x{k}" for k in range(r.choice([15, 40, 90]))]
        made.append([*template, *own, *([f"z{i}"] if i % 2 else [])])
    data = [(i, " ".join(w), None) for i, w in enumerate(r.sample(made, len(made)))]
    assert got(frame(spark, data)) == plain([x[:2] for x in data])


def test_boilerplate_makes_few_rows(spark, monkeypatch):
    """600 pages that are half boilerplate stand in the same long lists, yet no block of the last step holds one: wider sketches tell that no two can be linked."""
    seen, met_in = [], bottomk._met_in
    monkeypatch.setattr(bottomk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bottomk, "FEW_BLOCKS", 0)
    monkeypatch.setattr(bottomk, "_met_in", lambda met, *rest: (seen.append(met.count()), met_in(met, *rest))[1])
    template = [f"t{i}" for i in range(80)]
    data = [(i, " ".join([*template, *(f"p{i}x{k}" for k in range(80))]), None) for i in range(600)]
    out = bottomk.near_duplicates(frame(spark, data))
    assert out.where("NOT kept").count() == 0
    assert max(seen) <= 600 and seen[3:] == [0], seen


def test_union_share():
    r = np.random.default_rng(7)
    for _ in range(200):
        sets = [np.unique(r.integers(0, 120, r.integers(1, 60))) for _ in range(6)]
        rows = np.full((6, bottomk.K), bottomk.PAD, dtype=np.int64)
        for k, s in enumerate(sets):
            rows[k, : min(len(s), bottomk.K)] = s[: bottomk.K]
        shared, size = bottomk.union_share(rows[0], rows[1:])
        for k in range(5):
            union = sorted({*sets[0][: bottomk.K].tolist(), *sets[k + 1][: bottomk.K].tolist()})[: bottomk.K]
            both = {*sets[0][: bottomk.K].tolist()} & {*sets[k + 1][: bottomk.K].tolist()} & {*union}
            assert (shared[k], size[k]) == (len(both), len(union))


@pytest.mark.parametrize("seed", range(3))
def test_recall_of_links_among_shared_passages(spark, monkeypatch, seed):
    """Every link of random tables whose texts are put together from passages of all frequencies is found in the components."""
    monkeypatch.setattr(bottomk, "SHORT", 6)
    monkeypatch.setattr(bottomk, "BLOCK_ROWS", 24)
    r = random.Random(seed + 50)
    passages = [[f"s{seed}p{k}w{i}" for i in range(r.randint(8, 60))] for k in range(25)]
    made = []
    for i in range(220):
        if made and r.random() < 0.6:
            made.append(edited(r.choice(made), r, r.choice([0.005, 0.02, 0.05])))
        else:
            chosen = r.choices(passages, weights=[1 / (k + 1) for k in range(25)], k=r.randint(1, 5))
            made.append([w for p in chosen for w in p] + [f"own{i}x{k}" for k in range(r.randint(0, 20))])
    data = [(i, " ".join(w), None) for i, w in enumerate(made)]
    assert got(frame(spark, data)) == plain([x[:2] for x in data])


def test_rows_that_repeat_an_id_with_other_texts(spark):
    words = [f"w{i}" for i in range(60)]
    copied, own = " ".join(words), " ".join(f"o{i}" for i in range(60))
    near = " ".join([*words, "end"])
    data = [(2, copied, None), (6, near, None), (6, own, None), (9, own + " more", None)]
    rows = [(r.doc_id, r.component_id, r.kept) for r in bottomk.near_duplicates(frame(spark, data)).collect()]
    assert key(rows) == key([(2, 2, True), (6, 2, False), (6, 6, True), (9, 6, False)])
    assert sorted(r.text for r in bottomk.drop_duplicates(frame(spark, data)).collect()) == sorted([copied, own])


def test_forest_joins_what_all_pairs_join():
    r = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(edited(base, r, r.choice([0, 0.01, 0.03, 0.05]))) for _ in range(60)]
    links = bottomk.forest(list(range(60)), [t.encode() for t in texts])
    assert len(links) < 60

    def groups(pairs):
        label = list(range(60))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    sets = [shingles(t) for t in texts]
    assert groups(links) == groups([(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])


@pytest.mark.parametrize("before", [[], [f"a b c d {i} e f" for i in range(512)], ["word " * 120_000]])
def test_chunks_of_few_words(before):
    """Chunks that hold fewer words than a shingle in all: alone, after 512 rows, and after a text that fills a chunk."""
    for words in range(7):
        texts = [*before, " ".join("xyzuvw"[:words])]
        parts = [texts[k : k + 512] for k in range(0, len(texts), 512)]
        assert [len(s) for part in parts for s in bottomk.shingle_sets([t.encode() for t in part])] == [len(shingles(t)) for t in texts]


def test_table_with_a_part_of_three_words(spark):
    data = [*((i, f"a b c d {i} e f", None) for i in range(512)), (1000, "x y z", None)]
    assert got(frame(spark, data)) == plain([x[:2] for x in data])


def test_words_of_regular_letters_differ(spark):
    """A polynomial over a power of two gives the Thue-Morse word of 1,024 letters and its complement one hash."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    data = [(k, text, None) for k, text in enumerate((word, other, f"{word} x y z", f"{other} x y z", " ".join([word, other] * 512), " ".join([other, word] * 512)))]
    assert got(frame(spark, data)) == plain([x[:2] for x in data])
    hashed = [word_hashes([t.encode()])[0] for t in ("a" * n for n in (1, 7, 8, 9, 47, 48, 49, 300))]
    assert len({int(x[0]) for x in hashed}) == 8


def test_links_are_confirmed_on_the_words(spark, monkeypatch):
    """Were all words' hashes equal, texts that share nothing would still not be linked."""
    one, two = b" ".join(b"a%d" % i for i in range(50)), b" ".join(b"b%d" % i for i in range(50))
    monkeypatch.setattr(bottomk, "word_hashes", lambda texts: (np.concatenate([np.arange(len(t.split()), dtype=np.uint64) for t in texts]), np.cumsum([0, *(len(t.split()) for t in texts)])))
    assert bottomk.forest([1, 2, 3], [one, two, one + b" end"]) == [(1, 3)]


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4900, 5000)]
    found = dict(map(tuple, bottomk.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    label = {x: x for p in pairs for x in p}
    for _ in range(70):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {x: label[x] for a, b in pairs if a != b for x in (a, b)}


def test_components_run_few_stages(spark):
    """Stars are found to be settled without a further round, and a round moves each edge in one direction only: every stage costs tasks and files in all partitions."""
    pairs = [(i, i % 40) for i in range(40, 400)]
    sc, group = spark.sparkContext, "components-of-stars"
    links = spark.createDataFrame(pairs, "a long, b long")
    sc.setJobGroup(group, group)
    try:
        bottomk.components(links)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    known = sc.statusTracker()
    stages = {s for j in known.getJobIdsForGroup(group) for s in known.getJobInfo(j).stageIds}
    ran = [i for s in stages if (i := known.getStageInfo(s)) and i.numCompletedTasks]
    assert len(ran) <= 6, len(ran)
