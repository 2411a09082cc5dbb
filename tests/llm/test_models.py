import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import common, features, importance, mixing, queries
from lexweave.llm.common import table
from tests.llm.cases import ROWS, empty, frame, texts


M = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def scrambled(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def word_hash(word):
    word = word.lower()
    if len(word) > common.SHORT_WORD:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    acc = len(word) * ODD & M
    for k in range(0, len(word), 8):
        acc = scrambled(((acc ^ int.from_bytes(word[k : k + 8], "little")) * ODD + k + 1) & M)
    return acc


def run_hash(hashes):
    acc = 0
    for h in hashes:
        acc = scrambled((acc * ODD + h) & M)
    return acc


def plain_counts(text):
    """Counts of each bucket of the views (words, shapes) of one text, in plain Python from what features.py says."""
    out, words = np.zeros(importance.TOTAL), words_of(text)
    hashes = [word_hash(w) for w in words]
    size, shapes = features.BUCKETS["words"], features.BUCKETS["shapes"]
    for k, h in enumerate(hashes):
        out[h % size] += 1
        out[(run_hash(hashes[k : k + 2]) if k + 1 < len(hashes) else h) % size] += 1
    ends, seen, codes = {**dict.fromkeys(b".", 1), **dict.fromkeys(b",", 2), **dict.fromkeys(b"!", 3), **dict.fromkeys(b"?;:", 4), **dict.fromkeys(b"0123456789", 5)}, set(), [0, 0]
    for k, w in enumerate(words):
        symbol = any(33 <= c < 127 and not chr(c).isalnum() and c not in b".,;:'\"-!?()" for c in w)
        same = 1 if k and hashes[k] == hashes[k - 1] else 2 if k > 1 and hashes[k] == hashes[k - 2] else 0
        pair = tuple(hashes[k - 1 : k + 1]) if k else None
        again = pair in seen
        if pair:
            seen.add(pair)
        code = 0
        for value, base in ((symbol, 2), (min(2, sum(65 <= c <= 90 for c in w)), 3), (min(4, len(w) // 4), 5), (same, 3), (again, 2), (ends.get(w[-1], 0), 6)):
            code = code * base + value
        codes.append(code + 1)
        out[size + scrambled((codes[-1] * 2048 + codes[-2]) * 2048 + codes[-3]) % shapes] += 1
    return out


def test_a_batch_is_its_texts_one_by_one():
    some = [t for _, t in texts()] + ["The The The", "a", "", "x y x y x y"]
    for view in features.BUCKETS:
        alone = [next(features.batches([t.encode()], (view,)))[1][view][0].tolist() for t in some]
        together = []
        for _, views, _ in features.batches([t.encode() for t in some], (view,), most=200):
            at, starts = views[view]
            together += [at[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        if view != "bytes":  # the bytes of the last text run into the padding either way
            assert alone == together
        else:
            assert len(alone) == len(together)


def test_models_and_draw_by_brute_force(spark):
    """Counts, evidence, calibration, Gumbel numbers and the k largest of a small table, each made anew."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["red", "Blue.", "the", "$$$", "go!", "12"]) for _ in range(r.randint(0, 40))), None) for i in range(90)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(t.count("$$$") < 4), 0) for i, t, _ in rows if i % 4], "doc_id long, quality int, toxic int")
    sample = {x.id: (x.label, x.fold) for x in importance.labelled_sample(labels).collect()}
    assert len(sample) == labels.count() and {f for _, f in sample.values()} == set(range(importance.FOLDS))
    good = {i: f for i, (label, f) in sample.items() if label == 1}
    counts = {i: plain_counts(t) for i, t, _ in rows}
    raw, target = sum(counts.values()), sum(counts[i] for i in good)
    got = importance.count_models(df.join(spark.createDataFrame(list(good.items()), "doc_id long, fold int"), "doc_id", "left"))
    assert (got[0] == raw).all() and (got[1].sum(axis=0) == target).all()

    def log_ratio(target):
        out = np.zeros(importance.TOTAL)
        for part in (slice(0, features.BUCKETS["words"]), slice(features.BUCKETS["words"], None)):
            out[part] = np.log((target[part] + importance.PRIOR) / (raw[part] / raw[part].sum() * target[part].sum() + importance.PRIOR))
        return out

    judged = lambda c, ratio: c @ ratio / (c.sum() + importance.BLANK)
    evidence = {i: judged(c, log_ratio(target)) for i, c in counts.items()}
    without = [log_ratio(sum(counts[i] for i in good if good[i] != f)) for f in range(importance.FOLDS)]
    held = {i: judged(counts[i], without[f]) for i, (_, f) in sample.items()}
    slope, intercept = importance.calibrate(np.array(list(held.values())), np.array([sample[i][0] == 1 for i in held]))
    seeds = {x.id: x.u for x in spark.range(90).select("id", ((F.shiftrightunsigned(F.xxhash64(F.lit(importance.SEED), "id"), 11) + 0.5) / float(1 << 53)).alias("u")).collect()}
    weight = {i: evidence[i] * slope + intercept for i in evidence}
    keys = {i: w - math.log(-math.log(seeds[i])) for i, w in weight.items()}
    for budget in (None, 0, 1, 37, 90, 500):
        out = {x.doc_id: x for x in importance.resample(df, labels, budget=budget).collect()}
        k = sum(w > 0 for w in weight.values()) if budget is None else budget
        assert {x.budget for x in out.values()} == {k}
        assert all(out[i].log_weight == pytest.approx(weight[i], abs=1e-4) for i in weight)
        kept = {i for i, x in out.items() if x.kept}
        assert kept == set(sorted(keys, key=keys.get, reverse=True)[:k])
        assert kept == {x[0] for x in importance.keep(df, labels, budget=budget).select("doc_id").collect()}


def test_calibration():
    """The fit is the least smoothed log loss; odds of a logistic sample come back; one kind alone says nothing."""
    r = np.random.default_rng(3)
    x = r.normal(0, 0.05, 4000)
    good = r.random(4000) < 1 / (1 + np.exp(-(60 * x + 1)))
    slope, intercept = importance.calibrate(x, good)
    assert slope == pytest.approx(60, rel=0.1) and intercept == pytest.approx(1 - math.log(good.mean() / (1 - good.mean())), abs=0.15)
    assert importance.calibrate(x, good | True) == (1.0, 0.0) == importance.calibrate(x * 0, good)
    slope, _ = importance.calibrate(np.array([0.0, 0.1, 0.2, 0.3]), np.array([False, False, True, True]))
    assert 0 < slope < 1000


def test_inclusion_follows_the_odds(spark):
    """Over many seeds, two of four documents are drawn as often as drawing by odds without replacement says."""
    weights = [0.0, 1.0, 2.0, -1.0]
    seeds = spark.range(20_000).select(F.col("id").alias("seed"))
    docs = spark.createDataFrame(list(enumerate(weights)), "doc long, w double")
    keys = seeds.crossJoin(docs).withColumn("key", F.col("w") + importance.gumbel(F.col("doc"), F.col("seed")))
    top = keys.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("key", "doc")), False).alias("a")).select(F.explode(F.slice("a", 1, 2)).alias("x"))
    share = {x.doc: x["count"] / 20_000 for x in top.groupBy("x.doc").count().collect()}
    odds = np.exp(weights)
    for i in range(4):
        want = odds[i] / odds.sum() + sum(odds[j] / odds.sum() * odds[i] / (odds.sum() - odds[j]) for j in range(4) if j != i)
        assert share[i] == pytest.approx(want, abs=0.012)


def test_the_draw_matters(spark):
    """On real texts the kept rows are not simply the largest log weights, and another seed keeps others."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    out = importance.resample(docs, labels).collect()
    k = sum(x.kept for x in out)
    assert k == out[0].budget and 0.5 < k / len(out) < 0.95
    plain = {x.doc_id for x in sorted(out, key=lambda x: -x.log_weight)[:k]}
    assert 0 < len(plain ^ {x.doc_id for x in out if x.kept}) < 0.05 * len(out)


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 5)
    monkeypatch.setattr(common, "PARTS", 4)
    r = random.Random(6)
    values = [r.choice([r.gauss(0, 1), 0.25, -1e6, 3.0, 1e-12]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 50, 137, 299, 300, 999):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[min(k, 300) - 1]
    assert importance.kth_largest(df, "x", 0) == math.inf and importance.kth_largest(df.limit(0), "x", 3) == math.inf


def test_held_out_quality(spark):
    """Fitted on labels of even ids, judged on odd ones."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    kept = {r.doc_id: r.kept for r in importance.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good, bad = [kept[r.doc_id] for r in held if r.quality == 1], [kept[r.doc_id] for r in held if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_importance_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1), (11, 0), (None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, quality int")
    out = importance.resample(frame(spark), labels)
    assert out.columns == ["doc_id", "log_weight", "key", "budget", "kept"] and out.count() == len(ROWS)
    assert len({r.log_weight for r in out.collect() if r.doc_id in (2, 3, 8)}) == 1
    assert importance.keep(frame(spark), labels).columns == frame(spark).columns
    assert importance.resample(empty(spark), labels).count() == 0
    assert importance.resample(frame(spark), labels.limit(0)).where("kept").count() == len(ROWS)


def test_posteriors_are_whole_shares():
    model = mixing.Classifier(np.arange(5), np.random.default_rng(1).normal(0, 2, (6, 3)))
    p, n = model.posteriors([t.encode() for _, t in texts()])
    assert (p.sum(axis=1) == mixing.GRID).all() and (p >= 0).all() and n[10] == 1


def test_rates_by_brute_force(spark):
    r = np.random.default_rng(2)
    p = r.multinomial(mixing.GRID, [0.6, 0.3, 0.1], 40) if False else np.array([np.round(x * mixing.GRID) for x in r.dirichlet([0.4, 0.3, 0.2], 40)], dtype=int)
    p[:, 0] += mixing.GRID - p.sum(axis=1)
    n = r.integers(0, 500, 40)
    df = spark.createDataFrame([(int(a), [int(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<int>")
    target = {"a": 0.5, "b": 0.4, "c": 0.1}
    residuals = mixing.solve(df, target, ["a", "b", "c"], steps=200)
    got = np.array([x[0] for x in df.select(mixing.rate(F.col("p"), residuals)).collect()])
    share, q = n / n.sum(), p / mixing.GRID
    reached = (share * np.maximum(got, 0)) @ q
    assert np.abs(reached - list(target.values())).max() < 0.005
    # plain projected gradient on one machine, long enough
    a, y = share @ q, np.ones(40)
    for _ in range(20_000):
        y = np.maximum(0, y - (q @ (((share * y) @ q - list(target.values())) / a) + mixing.RIDGE * (y - 1)) / (1 + mixing.RIDGE))
    assert np.abs(np.maximum(got, 0) - y)[n > 0].max() < 0.05


def test_mixing_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (11, 0, 0), (14, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out, *_ = mixing.rates(frame(spark), labels, queries.domain(), queries.TARGET)
    assert out.columns == ["doc_id", "n_tokens", "p", "rate", "copies"] and out.count() == len(ROWS)
    assert all(sum(r.p) == mixing.GRID and r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out.collect())
    mixed = mixing.mix_documents(frame(spark), labels, queries.domain(), queries.TARGET)
    assert mixed.columns == frame(spark).columns
    assert mixed.count() == sum(r.copies for r in out.collect())
    assert mixing.rates(empty(spark), labels, queries.domain(), queries.TARGET)[0].count() == 0
    assert mixing.rates(frame(spark), labels.limit(0), queries.domain(), queries.TARGET)[0].count() == len(ROWS)


def test_mixture_meets_its_targets(spark):
    """Expected tokens within a tenth of each target; those of the copies, drawn row by row, within what such draws vary by."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_soft_mixing(spark, sf).collect()
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    target = np.array(list(queries.TARGET.values()))
    n, rate, p, copies = (np.array(x, dtype=float) for x in zip(*((r.n_tokens, max(r.rate, 0), r.p, r.copies) for r in rows), strict=True))
    expected, drawn = (n * rate) @ p / mixing.GRID, (n * copies) @ p / mixing.GRID
    assert (np.abs(expected / expected.sum() - target) < 0.1 * target).all()
    assert (np.abs(drawn / drawn.sum() - target) < 0.3 * target).all()
    spread = np.sqrt(((n[:, None] * p / mixing.GRID) ** 2 * ((rate % 1) * (1 - rate % 1))[:, None]).sum(axis=0))
    assert (np.abs(drawn - expected) < 4 * spread + 1).all()
    clean = [r.copies for r in rows if r.doc_id in labels and (labels[r.doc_id].quality, labels[r.doc_id].toxic) == (1, 0)]
    assert sum(c > 0 for c in clean) >= 0.95 * len(clean)


def test_posteriors_by_brute_force():
    """Presence, scores and shares of each text by itself, in plain Python."""
    known = np.array(sorted({word_hash(w) % features.BUCKETS["tokens"] for w in (b"the", b"cat", b"key", b"x", b"one", b"zebra")}))
    weights = np.random.default_rng(1).normal(0, 2, (len(known) + 1, 3))
    p, n = mixing.Classifier(known, weights).posteriors([t.encode() for _, t in texts()])
    for k, (_, t) in enumerate(texts()):
        words = words_of(t)
        present = {word_hash(w) % features.BUCKETS["tokens"] for w in words}
        z = weights[-1] + sum((weights[i] for i, b in enumerate(known) if b in present), np.zeros(3))
        share = np.exp(z - z.max())
        share = share / share.sum() * mixing.GRID
        assert n[k] == len(words) and p[k].sum() == mixing.GRID and np.abs(p[k] - share).max() < 1


def test_copies_follow_rates(spark):
    p = spark.range(40_000).select("id", F.array(F.lit(100), F.lit(156)).alias("p"))
    rate, copies = mixing._decided(F.col("p"), F.col("id"), [[-0.4, 0.1]])
    got = p.select(rate, copies).groupBy().agg(F.first("rate"), F.avg("copies"), F.min("copies"), F.max("copies")).first()
    assert got[1] == pytest.approx(got[0], abs=0.01) and (got[2], got[3]) == (int(got[0]), int(got[0]) + 1)
