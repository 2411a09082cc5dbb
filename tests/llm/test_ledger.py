import random
import re

from lexweave.llm import ledger
from lexweave.llm.common import table
from tests.llm.cases import empty, frame, key, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeat = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n)


def picked(out):
    return key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())


def test_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert picked(ledger.judge(docs)) == key((r.doc_id, *plain(r.text)) for r in docs.collect())


def test_edge_rows(spark):
    out = ledger.judge(frame(spark))
    assert picked(out) == key((i, *plain(t)) for i, t in texts())
    assert all(not r.kept for r in out.collect() if r.base_failed)
    assert ledger.judge(empty(spark)).count() == 0 and [r.n_failed for r in ledger.ablations(ledger.ledger(empty(spark)), "v2").collect()] == [0] * 5


def test_random_repeats(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60))), None) for i in range(200)]
    assert picked(ledger.judge(frame(spark, rows))) == key((i, *plain(t)) for i, t, _ in rows)


def test_policies_and_ablations(spark, sf):
    book = ledger.ledger(table(spark, sf, "documents")).cache()
    rows = book.collect()
    for version in ledger.POLICIES:
        kept = {r.doc_id for r in ledger.apply_policy(book, version).collect() if r.kept}
        assert kept == {r.doc_id for r in rows if not r.fail_bits & ledger.mask(version)}
        for a in ledger.ablations(book, version).collect():
            bit = next(x.bit for x in ledger.RULES if x.name == a.rule)
            less = ledger.mask(version) & ~(1 << bit)
            assert a.kept_without == sum(not r.fail_bits & less for r in rows)
            assert a.n_failed == sum(bool(r.fail_bits >> bit & 1) for r in rows)
            assert a.kept_with == len(kept) and a.n_only == a.kept_without - a.kept_with


def test_no_python_in_the_plan(spark, sf):
    plan = ledger.judge(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_labels_agree(spark, sf):
    """Documents labelled good are kept unless they fail the base rules; most others go."""
    judged = ledger.judge(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").collect()
    good = [r.kept for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) <= 0.1
