"""Personal data by weak supervision: regex, gazetteer and context labelers vote, expectation-maximisation weighs them, a span classifier decides.

Base spans (e-mail and IP addresses, card numbers that pass Luhn, international phone numbers) follow fixed patterns and always stay. Beside
them stand candidates that the patterns miss or mangle: addresses written around, numbers that run into others, national forms, IPv6,
persons. How a candidate is judged:

1. One pass over the texts finds base spans and candidates. Each of either sort gets the votes of all labelers (for, against or none) and a
   few hashed features: its shape, length, checks and neighbours.
2. Spans are counted by family and votes: with six labelers there are 729 patterns a family at most, whatever the tables' size.
   On those counts, expectation-maximisation estimates each labeler's reliability (how often it votes for a span that is private and for
   one that isn't) and each family's share of private spans, from stated first guesses that also weigh as FIRST votes each; rates that are known are kept.
3. The patterns' posteriors label SAMPLE spans, drawn by a hash, on which a logistic classifier over the features is trained.
4. Candidates that the classifier finds private become spans, of kinds of their own.

Spans are of whole matches, in code points, ends exclusive. Scans take time in proportion to a text's length, whatever it holds. Null texts
count as empty. Repeated rows are scanned and returned one by one; ids may be null or repeat. Tables without spans train nothing and
add nothing. Other columns are left out.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, checkpoint, foretold, fresh, quoted, require, text_or_empty, tidy

#: Names of spans in the order in which they are listed where they start together; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "address", "host", "account", "national", "person"]
BASE = 4
#: Families share reliabilities: base kinds and what is like them.
FAMILIES = ["address", "host", "account", "national", "person"]
LABELERS = ["pattern", "form", "check", "gazetteer", "cue", "company"]
#: Labelled spans that the classifier is trained on at most, and its features.
SAMPLE, FEATURES = 20_000, 1 << 10
#: Votes that a first guess weighs as.
FIRST = 20.0
#: Code points before a span that hold its cues, and around it that hold its company.
CUE_REACH, COMPANY_REACH = 40, 200

_RUN, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED, _CARD, _PHONE = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9](?:[\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AROUND = re.compile(r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?([A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]+)+)", re.I)
_NUMBER = re.compile(r"\+?[0-9]{1,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}|\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|00[1-9][0-9]{0,2}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){2,3}|[0-9]{13,19}|[0-9]+")
_SIX = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
_PERSON = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}(?:\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}){1,2}")
_WORD_BEFORE, _WORD_AFTER = re.compile(r"(\w+)\W*$"), re.compile(r"^\W*(\w+)")
_ALNUM = re.compile(r"\w")


@dataclass(frozen=True)
class Gazetteer:
    """Lists that labelers look things up in; the defaults are small, and meant to be replaced by larger ones."""

    given_names: frozenset[str] = field(default_factory=lambda: frozenset("James John Robert Michael William David Mary Patricia Jennifer Linda Elizabeth Susan Thomas Peter Anna Maria Hans Karl Klaus Ursula Pierre Jean Marie Claire Juan José Carmen Pedro Luis Ana".split()))
    titles: frozenset[str] = field(default_factory=lambda: frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora don doña".split()))
    endings: frozenset[str] = field(default_factory=lambda: frozenset("com org net edu gov info io eu de fr es uk us it ch at nl be pt br mx ar ca au jp cn ru pl se no dk fi".split()))
    #: By family: words that speak for a span that follows them, and words that speak against it.
    cues: dict[str, frozenset[str]] = field(default_factory=lambda: {k: frozenset(v.split()) for k, v in {"address": "email e-mail mail contact write correo courriel", "host": "ip host server address from client", "account": "card visa mastercard credit iban account konto tarjeta carte", "national": "phone tel telephone call mobile fax cell telefon teléfono téléphone", "person": "name named signed author dear by from called"}.items()})
    against: dict[str, frozenset[str]] = field(default_factory=lambda: {k: frozenset(v.split()) for k, v in {"address": "git ssh commit", "host": "version release section chapter", "account": "isbn order invoice serial tracking id sku", "national": "isbn page pages order invoice serial part", "person": "the of in at street river lake university"}.items()})


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _RUN.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the base kinds, each leftmost and non-overlapping by itself."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, start = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(map(_small, four)):
                    found.append((start, 1, start + size))
                start += size + 1
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _apart(text: str, start: int, end: int) -> bool:
    """Whether a span stands by itself, not inside of a word."""
    return not (start and (_ALNUM.match(text[start - 1]) or text[start - 1] in "@/_=")) and not (end < len(text) and (_ALNUM.match(text[end]) or text[end] in "@_="))


def candidates(text: str, base: list[tuple[int, int, int]], lists: Gazetteer) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of spans that the base patterns don't have."""
    found: list[tuple[int, int, int]] = []
    lower = None
    for mark in ("(at)", "[at]", "{at}"):
        if mark[0] in text:
            lower = lower if lower is not None else text.lower() if len(text.lower()) == len(text) else text
            at = lower.find(mark)
            while at >= 0:
                spot = at - (at > 0 and text[at - 1] == " ")
                start = spot
                while start and spot - start < 64 and _RUN.match(text[start - 1]):
                    start -= 1
                if start < spot and (m := _AROUND.match(text, spot)):
                    found.append((start, 4, m.end()))
                at = lower.find(mark, at + 1)
    if ":" in text:
        found += [(m.start(), 5, m.end()) for m in _SIX.finditer(text)]
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 10 and (n := len(_digits(m[0]))) <= 19:
            found.append((m.start(), 6 if n > 12 and "(" not in m[0] and not m[0].startswith("00") else 7, m.end()))
    for m in _PERSON.finditer(text):
        words = m[0].split(" ")
        before = _WORD_BEFORE.search(text[max(0, m.start() - 12) : m.start()])
        if words[0].lower() in lists.titles and len(words) > 1 or words[0] in lists.given_names or before and before[1].lower() in lists.titles:
            found.append((m.start(), 8, m.end()))
    out, free = [], 0
    taken = [(a, b) for a, _, b in base]
    at = 0
    for a, kind, b in sorted(found):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= free and _apart(text, a, b) and not any(x < b and y > a for x, y in taken[at : at + 8]):
            out.append((a, kind, b))
            free = b
    return out


def _family(kind: int) -> int:
    return kind if kind < BASE else kind - BASE


def votes(text: str, span: tuple[int, int, int], company: bool, lists: Gazetteer) -> list[int]:
    """What each labeler says of a span: 1 for, -1 against, 0 nothing."""
    start, kind, end = span
    family, held = FAMILIES[_family(kind)], text[start:end]
    digits = _digits(held)
    before = {w.lower() for w in re.findall(r"[^\W_]+(?:-[^\W_]+)?", text[max(0, start - CUE_REACH) : start])}
    cue = 1 if before & lists.cues[family] else -1 if before & lists.against[family] else 0
    form = check = known = 0
    if family in ("account", "national", "host") and digits and (len(set(digits)) == 1 or digits in "01234567890123456789"):
        form = -1
    elif family == "account":
        form = 1 if re.fullmatch(r"[0-9]{15,16}|[0-9]{4}(?:[\x20-][0-9]{4}){3}", held) else 0
    elif family == "national":
        form = 1 if re.search(r"\([0-9]{2,4}\)|^\+|^00", held) else 0
    elif family == "address":
        form = 1 if re.search(r"[0-9._]", held.split("@")[0].split("(")[0].split("[")[0]) else 0
    elif family == "person":
        form = 1 if held.count(" ") == 1 else 0
    if family == "account":
        check = 1 if luhn(digits) else -1
        known = -1 if digits.startswith(("978", "979")) else 1 if digits.startswith(("34", "35", "37", "4", "51", "52", "53", "54", "55", "60", "65")) else 0
    elif family == "national":
        check = 1 if 9 <= len(digits) <= 15 and not re.fullmatch(r"(?:19|20)[0-9]{2}[.-].*", held) else -1
        known = 1 if re.match(r"\+?(?:1|33|34|39|44|49)\b", held) else 0
    elif family == "host":
        parts = held.split(".")
        check = 1 if len(parts) != 4 or parts[0] not in ("0", "255") else -1
        known = -1 if held.startswith(("127.", "0.", "1.0.", "2.0.")) else 0
    elif family == "address":
        ending = re.split(r"[^A-Za-z0-9-]+", held.rstrip(" "))[-1].lower()
        known = 1 if ending in lists.endings else -1
        check = 1 if len(held) <= 254 and ".." not in held else -1
    else:
        known = 1 if held.split(" ")[0] in lists.given_names or held.split(" ")[1] in lists.given_names else 0
        check = 1 if any(w.lower() in lists.titles for w in [*held.split(" ")[:1], *before]) else 0
    return [1 if kind < BASE else 0, form, check, known, cue, 1 if company else 0]


def _shape(held: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", held)))[:24]


def features(text: str, span: tuple[int, int, int], said: list[int]) -> list[int]:
    """Numbers below FEATURES of a span's shape, length, checks and neighbours; whether a base pattern has it isn't among them."""
    start, kind, end = span
    family, held = FAMILIES[_family(kind)], text[start:end]
    before, after = _WORD_BEFORE.search(text[max(0, start - CUE_REACH) : start]), _WORD_AFTER.search(text[end : end + CUE_REACH])
    named = [
        "bias", f"shape {_shape(held)}", f"length {min(len(held), 40) // 2}", f"digits {min(len(_digits(held)), 20)}", *(f"{n} {v}" for n, v in zip(LABELERS[1:], said[1:], strict=True)),
        f"before {before[1].lower() if before else ''}", f"after {after[1].lower() if after else ''}", f"left {_kind_of(text[start - 1 : start])}", f"right {_kind_of(text[end : end + 1])}",
    ]
    return sorted({zlib.crc32(f"{family} {n}".encode()) % FEATURES for n in named})


def _kind_of(c: str) -> str:
    return "" if not c else "a" if c.isalpha() else "9" if c.isdigit() else c if c < "\x80" else "x"


def spans_of(text: str, lists: Gazetteer) -> list[dict]:
    """Base spans and candidates of a text, sorted, each with its family, votes (a number in base three) and features."""
    base = base_spans(text)
    found = sorted([*base, *candidates(text, base, lists)])
    out = []
    for k, span in enumerate(found):
        near = (k and span[0] - found[k - 1][2] <= COMPANY_REACH) or (k + 1 < len(found) and found[k + 1][0] - span[2] <= COMPANY_REACH)
        said = votes(text, span, bool(near), lists)
        out.append({"start": span[0], "order": span[1], "end": span[2], "family": _family(span[1]), "votes": sum((v + 1) * 3**i for i, v in enumerate(said)), "features": features(text, span, said)})
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: Gazetteer | None = None) -> DataFrame:
    """id, row and found (array of start, order, end, family, votes, features) of each row; stored."""
    require(df, id_col, text_col)
    bound_batches(df.sparkSession)
    lists = lists or Gazetteer()
    number = ("start", "order", "end", "family", "votes")
    arrow = pa.list_(pa.struct([*((n, pa.int32()) for n in number), ("features", pa.list_(pa.int32()))]))

    @F.arrow_udf("array<struct<start:int,order:int,end:int,family:int,votes:int,features:array<int>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([spans_of(t.as_py(), lists) for t in texts], arrow)
        tidy()

    return checkpoint(df.select(quoted(id_col).alias("id"), run(text_or_empty(text_col)).alias("found")).withColumn("row", F.monotonically_increasing_id()))


#: First guesses: how often a labeler votes for a span, where it votes, if the span is private and if it isn't.
GUESS = {"pattern": (0.98, 0.20), "form": (0.85, 0.40), "check": (0.97, 0.15), "gazetteer": (0.80, 0.30), "cue": (0.85, 0.15), "company": (0.60, 0.40)}

#: Rates that are known and aren't estimated: of numbers that are no card's, one in ten passes Luhn's check by chance.
KNOWN = {("account", "check"): (0.99, 0.10)}


def reliabilities(patterns: list[tuple[int, int, int]], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From (family, votes, how many): each family's share of private spans, each labeler's share of votes for (family, labeler, whether private), and the patterns' posteriors."""
    family, code, n = (np.array(x, dtype=np.int64) for x in (zip(*patterns, strict=True) if patterns else ((), (), ())))
    said = code[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1
    guess = np.array([GUESS[x] for x in LABELERS])
    share, rate = np.full(len(FAMILIES), 0.5), np.broadcast_to(guess, (len(FAMILIES), *guess.shape)).copy()
    known = [((FAMILIES.index(f), LABELERS.index(x)), value) for (f, x), value in KNOWN.items()]
    for at, value in known:
        rate[at] = value
    found = np.zeros(len(n))
    for _ in range(rounds):
        odds = np.log(share[family]) - np.log1p(-share[family])
        one, zero = rate[family][:, :, 0], rate[family][:, :, 1]
        odds = odds + np.where(said > 0, np.log(one / zero), np.where(said < 0, np.log((1 - one) / (1 - zero)), 0.0)).sum(axis=1)
        before, found = found, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for f in range(len(FAMILIES)):
            of = family == f
            weights = np.stack([n[of] * found[of], n[of] * (1 - found[of])], axis=1)
            share[f] = (weights[:, 0].sum() + FIRST / 2) / (n[of].sum() + FIRST)
            rate[f] = ((said[of] > 0).T.astype(float) @ weights + FIRST * guess) / ((said[of] != 0).T.astype(float) @ weights + FIRST)
        for at, value in known:
            rate[at] = value
        if np.abs(found - before).max(initial=0) < 1e-9:
            break
    return share, rate, found


def train(rows: list[list[int]], labels: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier of labels between 0 and 1, by accelerated gradient steps."""
    w = np.zeros(FEATURES)
    if not rows:
        return w
    index, starts = np.concatenate(rows).astype(np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    step = 4.0 / max(len(r) for r in rows)
    ahead, last, t = w.copy(), w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(ahead[index], starts), -50, 50)))
        w = ahead - step * (np.bincount(index, (p - labels)[of], FEATURES) / len(rows) + ridge * ahead)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, last, t = w + (t - 1) / after * (w - last), w, after
    return w


@dataclass
class Model:
    share: np.ndarray  #: of private spans in each family
    rate: np.ndarray  #: of votes for a span: family, labeler, whether private
    weights: np.ndarray  #: of the classifier


def fit(scanned: DataFrame, sample: int = SAMPLE) -> Model:
    """Reliabilities from all spans' votes; a classifier from `sample` of them, drawn by a hash. What reaches the driver is bounded."""
    spans = scanned.select("row", F.explode("found").alias("x")).select("row", "x.*")
    patterns = sorted(tuple(r) for r in spans.groupBy("family", "votes").agg(F.count("*").alias("n")).collect())
    share, rate, found = reliabilities(patterns)
    posterior = {(f, v): p for (f, v, _), p in zip(patterns, found.tolist(), strict=True)}
    drawn = spans.orderBy(F.xxhash64("start", "end", "votes", "features", "row"), "row", "start", "order").limit(sample).select("family", "votes", "features").collect()
    weights = train([r.features for r in drawn], np.array([posterior[r.family, r.votes] for r in drawn]))
    return Model(share, rate, weights)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: Gazetteer | None = None, least: float = 0.5) -> DataFrame:
    """id_col and found (array of start, order, end, kind, probability; sorted) of each row: the base spans, and the candidates that the classifier finds private."""
    scanned = scan(df, id_col, text_col, lists)
    return decide(scanned, fit(scanned), least).withColumnRenamed("id", id_col).drop("row")


def decide(scanned: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """row, id and found of a scan, judged by a model."""
    weights = F.from_json(F.lit(json.dumps([round(x, 9) for x in model.weights.tolist()])), "array<double>")
    kinds = F.array(*map(F.lit, KINDS))
    score = lambda x: F.aggregate(x["features"], F.lit(0.0), lambda a, i: a + F.get(weights, i))
    judged = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), F.get(kinds, x["order"]).alias("kind"), (1 / (1 + F.exp(-score(x)))).alias("probability")))
    return scanned.select("row", "id", F.filter(judged, lambda x: (x["order"] < BASE) | (x["probability"] >= least)).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added from find()."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["order"] == k)).cast("long")
    base = F.filter("found", lambda x: x["order"] < BASE)
    return found.select(
        quoted(id_col), *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["order"] >= BASE)).cast("long").alias("n_added"),
    )


def redact(df: DataFrame, text_col: str = "text", lists: Gazetteer | None = None) -> DataFrame:
    """df with each span of its text replaced by its kind in brackets; of spans that overlap, the first and longest counts. Spans follow from the text, so ids aren't needed; a null text stays null."""
    require(df, text_col)
    key, id_, cuts = fresh(df, "key", "id", "cuts")
    text = quoted(text_col)
    keyed = df.withColumn(key, F.sha2(text, 256))
    found = find(keyed.select(F.col(key).alias("key"), text.alias("text")), "key", "text", lists).where(F.size("found") > 0).dropDuplicates(["key"])
    longest = F.array_sort("found", lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"]))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    apart = F.aggregate(longest, none, lambda a, x: F.when((F.size(a) == 0) | (x["start"] >= F.element_at(F.concat(a, F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind")))), F.greatest(F.size(a), F.lit(1)))["end"]), F.array_append(a, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).otherwise(a))
    spans = checkpoint(found.select(F.col("key").alias(id_), apart.alias(cuts)))
    some, others = foretold(keyed, spans.select(id_), key)
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    parts = F.transform(cuts, lambda x, k: F.concat(piece(F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k - 1)["end"]), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    cut = F.when(F.col(cuts).isNotNull(), F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text)))).otherwise(text)
    out = some.join(spans, F.col(key) == F.col(id_), "left").select(*(cut.alias(c) if c == text_col else quoted(c) for c in df.columns))
    return others.select(*map(quoted, df.columns)).unionByName(out)
