import re
from collections import Counter, defaultdict

import pytest

from lexweave.llm import divergence
from lexweave.llm.common import table
from tests.llm.cases import empty, frame, key

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """Rows (lang, source, text), every term of every pair."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    for lang in held:
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        sources = [s for l, s in counts if l == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept]

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum((x - y) ** 2 // y for x, y in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            terms = [(t, (x - y) ** 2 // y) for t, x, y in zip(kept, p[s], q, strict=True) if x > y and counts[lang, s][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found[: 200 if part == "term" else None], 1)]
    return key(out)


def got(df):
    return key(map(tuple, divergence.audit(df).collect()))


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert got(docs) == plain([(r.lang, r.source, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    data = [
        ("en", "a", "one two two THREE"), ("en", "b", "one Two"), ("en", "b", "one two three, ñandú中 x1y"), ("en", "c", None), ("en", None, ""), ("en", "a", "one two two THREE"),
        (None, "a", "ÀÉ àé ÀÉ"), (None, "a", "ÀÉ"), ("", "b", "ÀÉ ÀÉ ÀÉ"), ("de", "a", "rare"), ("de", "b", "rarer"), ("fr", "only", "le le le"), ("en", "z", "word " * 30_000),
        ("en", "hot", "one " * 999), ("en", "hot", "two two"), ("en", "hot", "KK İ"), ("it", "p", "\x00\x7f 123"), ("it", "q", "é"), ("it", "q", "é"), ("it", "q", "é é"),
    ]
    df = spark.createDataFrame([(None, t, l, s, "clash", 1) for l, s, t in data], "doc_id long, text string, lang string, source string, group string, n int").repartition(3)
    assert got(df) == plain(data)


def test_other_tables(spark):
    docs = frame(spark).withColumnRenamed("key", "lang")
    assert got(docs) == plain([(r.lang, r.source, r.text) for r in docs.collect()])
    assert divergence.audit(empty(spark).withColumnRenamed("key", "lang")).collect() == []
    with pytest.raises(KeyError):
        divergence.audit(docs.drop("source"))


def test_histograms_hold_every_kept_term(spark, sf):
    """The combinations of a pair, those of zero included, are all kept terms, and its margins are each source's counts."""
    seen = divergence.Audit(table(spark, sf, "documents"))
    groups = {r.group: r for r in seen.groups.collect()}
    cells = seen.histograms().collect()
    sums = defaultdict(lambda: [0, 0, 0])
    for r in cells:
        for k, x in enumerate((r.n, r.n * r.ca, r.n * r.cb)):
            sums[r.a, r.b][k] += x
    assert sums == {(a, b): [groups[a].kept, groups[a].total, groups[b].total] for a, b in sums}
    assert len({(r.a, r.b, r.ca, r.cb) for r in cells}) == len(cells)
