import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import pii
from lexweave.llm.common import table
from tests.llm.cases import empty, frame, key, texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """Base spans by the patterns as they are written."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def row(i, text):
    spans = plain(text)
    listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (i, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest())


def test_base_spans_of_random_texts():
    r = random.Random(9)
    parts = [*"0123456789", ".", "..", "-", " ", "  ", "@", "a", "b.c", "%", "_", "+", "(", ")", "\n", "é", "+1 ", "4111 1111 1111 1111", "10.0.0.1", "255.256.1.2", "x@y.z", "x@y", "@@", "٣", "😀", "007", "000255.1.1.1"]
    for _ in range(20_000):
        text = "".join(r.choices(parts, k=r.randint(0, 25)))
        assert pii.base_spans(text) == plain(text), text


def test_scans_take_linear_time():
    for part in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 200_000, "a@" * 100_000, "+" * 200_000, "+1 (" * 50_000, "1 " * 100_000, "a@b." * 50_000, "(at) " * 40_000, "Aa " * 60_000, "a:" * 100_000, "0000:" * 40_000):
        pii.spans_of(part, pii.Gazetteer())


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    out = pii.digest(pii.find(docs)).collect()
    assert key(tuple(r)[:6] for r in out) == key(row(r.doc_id, r.text) for r in docs.collect())
    for r in out:
        assert r.n_added == sum(x.split(":")[0] in pii.KINDS[4:] for x in r.spans.split(",") if x)


def test_edge_rows(spark):
    data = [*texts(), (None, "call +1 (243) 555-5526 or a@b.co"), (None, "call +1 (243) 555-5526 or a@b.co")]
    df = spark.createDataFrame([(*x, "clash", 1) for x in data], "`a.b` long, text string, found string, row int")
    out = pii.digest(pii.find(df, "a.b"), "a.b").collect()
    assert key(tuple(r)[:6] for r in out) == key(row(*x) for x in data)
    assert pii.find(empty(spark)).collect() == []
    assert {r.spans for r in pii.digest(pii.find(frame(spark))).collect()} == {""}


@pytest.mark.parametrize("seed", [1, 2])
def test_reliabilities_of_made_votes(seed):
    """Votes drawn with known reliabilities: the estimates come near them, and the posteriors tell the classes."""
    r = np.random.default_rng(seed)
    private = r.random(20_000) < 0.3
    true = np.array([[0.97, 0.02], [0.8, 0.5], [0.99, 0.1], [0.7, 0.3], [0.9, 0.2], [0.55, 0.45]])
    said = np.where(r.random((20_000, 6)) < 0.6, np.where(r.random((20_000, 6)) < np.where(private[:, None], true[:, 0], true[:, 1]), 1, -1), 0)
    codes, at, n = np.unique(((said + 1) * 3 ** np.arange(6)).sum(axis=1), return_inverse=True, return_counts=True)
    share, rate, found = pii.reliabilities([(1, int(c), int(k)) for c, k in zip(codes, n, strict=True)])
    assert abs(share[1] - 0.3) < 0.03 and np.abs(rate[1] - true).max() < 0.06
    odds = np.log(0.3 / 0.7) + np.where(said > 0, np.log(true[:, 0] / true[:, 1]), np.where(said < 0, np.log((1 - true[:, 0]) / (1 - true[:, 1])), 0)).sum(axis=1)
    assert ((found[at.reshape(-1)] > 0.5) == private).mean() > ((odds > 0) == private).mean() - 0.003  # as good as by the true reliabilities


def planted(n=400, seed=5):
    """Texts with numbers that run into others or are written around (private), and numbers that only look alike (not); what the base patterns miss."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))

    def card(ok):
        while True:
            d = "4" + digits(15)
            if pii.luhn(d) == ok:
                return d

    words = lambda: " ".join(r.choices("there was once nothing much said about it until later".split(), k=6))
    phone = lambda: f"+1 ({digits(3)}) 555-{digits(4)}"
    out = []
    for k in range(n):
        sort = k % 8
        private = {0: phone(), 1: card(True), 2: None, 3: phone(), 4: "anna.k (at) mail dot example".replace(" dot ", " (dot) ") + " (dot) com", 5: None, 6: None, 7: card(True)}[sort]
        text = {0: f"{words()} {private} {card(True)} {words()}", 1: f"{words()} {private} {card(True)} {words()}", 2: f"{words()} order {card(False)} {words()}", 3: f"phone {private} {words()}", 4: f"write to {private} {words()}", 5: words(), 6: f"isbn 978{digits(10)} {words()}", 7: f"{words()} card {private} {words()}"}[sort]
        out.append((k, text, private))
    return out


def test_method_adds_what_the_patterns_miss(spark):
    data = planted()
    found = {r.doc_id: r.found for r in pii.find(spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")).collect()}
    for i, text, private in data:
        held = [text[x.start : x.end] for x in found[i]]
        if private:
            assert any(private in h for h in held), (text, held)
        else:
            base = {text[a:b] for a, _, b in plain(text)}
            assert set(held) <= base, (text, held)


def test_redact(spark):
    data = [(1, "mail a@b.co, ip 10.0.0.1; +1 (243) 555-5526 4111111111111111 end", 0), (2, None, 0), (2, "nothing", 0), (None, "a@b.coé4111111111111111", 0), (None, "a@b.coé4111111111111111", 0), (5, "", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, found int")
    out = key((r.doc_id, r.text) for r in pii.redact(df).collect())
    again = (None, "[EMAIL]é[CARD]")
    assert out == key([(1, "mail [EMAIL], ip [IP]; [NATIONAL] [ACCOUNT] end"), (2, None), (2, "nothing"), again, again, (5, "")])
    assert pii.redact(df).columns == df.columns and pii.redact(df.where(F.lit(False))).collect() == []
