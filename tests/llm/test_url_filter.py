import itertools
import math
import re

import pytest

from lexweave.llm import common
from lexweave.llm import url_filter as uf
from lexweave.llm.common import table

URLS = [
    "http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "https://www.example.com/EN/", "https://x.www.example.com/en/a", "http://example.com", "http://example.com?x=/en/", "http://notexample.com/en/1",
    "http://a.net/es/1", "http://net/fr/", "http://a.net/de/", "nothing", "", None, "://", "http://", "a://b://c.com/", "http://x.com\n/en/", "https://cheap-pills.example.org/x", "https://spam-farm.example.org/x",
    "http://" + "ab" * 3000 + ".org/" + "z" * 5000, "http://com/", "http://ÀB.com/é",
]


def plain(url):
    """Host, path and rule by definition."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in uf.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def plain_names(host, path):
    return "".join(c if c.isalpha() else " " for c in f"{host} {path}".lower()).split()


def corpus(spark, counts):
    return spark.createDataFrame(list(counts.items()), "w string, n long")


def plain_model(counts, labelled):
    """The score of a (host, path) by plain Python: the labelled words known, every name split, words weighed."""
    known = dict(counts)
    for u, _ in labelled:
        for w in plain_names(*plain(u)[:2]):
            if len(w) <= uf.LONGEST:
                known[w] = max(known.get(w, 0), uf.MET)
    total = sum(known.values())
    words = lambda host, path: [w for n in plain_names(host, path) for w in uf.viterbi(n, known, total)]
    seen = {b: [w for u, k in labelled if k is b for w in plain_names(*plain(u)[:2])] for b in (True, False)}
    vocabulary = {*seen[True], *seen[False]}
    chance = lambda w, b: (seen[b].count(w) + 1) / (len(seen[b]) + len(vocabulary))
    prior = math.log((sum(b for _, b in labelled) + 1) / (sum(not b for _, b in labelled) + 1))
    return lambda host, path: prior + sum(math.log(chance(w, True) / chance(w, False)) for w in words(host, path) if w in vocabulary)


@pytest.mark.parametrize("hot", [1000, 3])
def test_verdicts_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    urls = URLS + ["https://cheappills.example.org/free", "https://cheappills.example.org/free", "http://dailynews.org/world", "https://blog.adult-x.example.net/de/1", "http://новости.org/мир", "http://x.org/" + "cheap" * 40]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    counts = {"the": 100, "new": 30, "s": 20, "a": 50, "daily": 9, "мир": 4}
    score = plain_model(counts, uf.default_labels())
    found = uf.judge(df, corpus(spark, counts)).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path, best = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), urls[r.page_id]
        if best:
            assert r.score is None and r.verdict == best[1]
        else:
            assert r.score == pytest.approx(score(host, path), abs=1e-6) and r.verdict == ("block" if score(host, path) > 0 else "allow")


def test_viterbi_by_brute_force():
    counts = {"a": 50, "ab": 20, "bc": 30, "abc": 4, "c": 9, "cab": 3}
    total = sum(counts.values())
    cost = lambda parts: sum(math.log(total / counts[p]) if p in counts else math.log(total) + math.log(10) * len(p) for p in parts)
    for name in ("abc", "abcab", "cabcabx", "zabc", "aabbcc"):
        splits = []
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
            splits.append([name[a:b] for a, b in itertools.pairwise(at)])
        assert cost(uf.viterbi(name, counts, total)) == pytest.approx(min(map(cost, splits)))
    assert uf.viterbi("", counts, total) == []


def test_left_out_labels():
    """Each labelled url judged by a classifier trained on the others, its names written as one word each."""
    labelled = uf.default_labels()
    right = {True: [], False: []}
    for k, (u, b) in enumerate(labelled):
        host, path, _ = plain(u.replace("-", ""))
        rest = labelled[:k] + labelled[k + 1 :]
        right[b].append((plain_model({}, rest)(host, path) > 0) is b)
    assert sum(right[True]) >= 0.9 * len(right[True]) and sum(right[False]) >= 0.9 * len(right[False])


def test_held_out_hosts():
    score = plain_model({"the": 100, "and": 50}, uf.default_labels())
    held = [("cheap-pills.a", "/1", True), ("spamfarm.a", "/1", True), ("m.ads-track.a", "/en/4", True), ("casinoprize.a", "/", True), ("newsarchive.a", "/", False), ("cityguide.a", "/", False), ("ththre.a", "/en/1", False), ("m.ththth.a", "/de/5", False), ("tionble.a", "/es/5", False)]
    assert [score(h, p) > 0 for h, p, _ in held] == [b for *_, b in held]


def test_counts_over_all_rows(spark, sf):
    pages = table(spark, sf, "pages")
    want = {}
    for r in pages.collect():
        for w in "".join(c if c.isalpha() else " " for c in re.sub("<[^>]*>", " ", r.html).lower()).split(" "):
            if 1 <= len(w) <= uf.LONGEST:
                want[w] = want.get(w, 0) + 1
    assert {r.w: r.n for r in uf.word_counts(pages, "html").collect()} == want


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, None, "x", "y"), (1, "http://a.b/", None, None), (1, "http://a.b/", None, None)], "page_id long, url string, host string, fits string")
    none = spark.createDataFrame([], "w string, n long")
    out = uf.judge(df, none)
    assert out.columns == ["page_id", "host", "path", "rule", "score", "verdict"] and out.count() == 3
    assert uf.judge(df, none, labelled=[]).where("verdict = 'allow' and score = 0").count() == 3
    assert uf.judge(df.limit(0), none).count() == 0
    assert uf.word_counts(df.limit(0), "url").count() == 0
    with pytest.raises(KeyError):
        uf.judge(df, none, url_col="absent")
