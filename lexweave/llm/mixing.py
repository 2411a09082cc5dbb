"""Mixing sources to target weights by soft membership.

A classifier trained on a labelled table gives each document posteriors over domains. Documents get nonnegative rates r so
that expected domain totals match targets: with n tokens and posteriors p of each, the least squares
    1/2 sum_d (sum_i n_i p_id r_i / N - t_d)^2 / a_d + ridge/2 sum_i n_i/N (r_i - 1)^2,  r >= 0
(a: the domains' shares of the tokens, so small domains count as much as large ones, and no step can be too long) are solved by accelerated projected gradient. All rates start at 1, so a rate is a function of the posteriors and of the
residuals of the steps so far: each step is one aggregation over the documents, in which every row replays the residuals;
nothing but D sums comes back, and a lost executor costs one aggregation's partition. Posteriors are whole 256ths, so equal
ones are summed up first, into a table whose size the grid bounds.

A rate becomes copies: its whole part, and one more where a hash of the id falls below its fraction.

The classifier is a softmax regression over the presence of FEATURES hashed words and runs of word shapes, chosen by chi-square, fitted
on at most SAMPLE labelled rows, the first by a hash of their id.

Null and empty texts have no tokens; their posteriors are those of no words. Texts of any length are read whole. Without labelled rows all
posteriors go to the first domain and its target decides. Rows are weighed and copied one by one: repeated rows of an id share their rate
and copies, rows that repeat an id with other texts have their own rates; null ids draw the number of a null. Extra columns of any name
stay as they are in mix_documents and are left out by rates. A labelled id counts once, whichever of its rows has it: the row of the least text hash.

Tokens are words [^\\x20\\x09-\\x0D]+ here; targets are shares of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, checkpoint, encoded, fresh, quoted, require, text_or_empty, tidied, tidy
from lexweave.llm.features import batches, layout

SAMPLE = 6000
FEATURES = 256
VIEWS = ("tokens", "shapes")
TOTAL = layout(VIEWS)[1]
GRID = 256
RIDGE = 0.001
STEPS = 60
SEED = 29


def labelled_sample(labels: DataFrame, domain: Column, id_col: str = "doc_id", most: int = SAMPLE) -> DataFrame:
    """id, domain: at most `most` labelled rows, the first by a hash of the id."""
    known = labels.select(quoted(id_col).alias("id"), domain.alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    return known.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "domain").limit(most).groupBy("id").agg(F.min("domain").alias("domain"))


def _present(texts: list[bytes], known: np.ndarray | None = None):
    """(range of texts, row in it and bucket of each distinct one present, words of each text); known: only these buckets, by their place."""
    place = None
    if known is not None:
        place = np.full(TOTAL, -1, dtype=np.int64)
        place[known] = np.arange(len(known))
    for (a, b), views, count in batches(texts, VIEWS):
        keys = []
        for at, starts in views.values():
            row = np.repeat(np.arange(b - a), np.diff(starts))
            if place is not None:
                at = place[at]
                row, at = row[at >= 0], at[at >= 0]
            keys.append(np.unique(row * TOTAL + at))
        keys = np.unique(np.concatenate(keys))
        yield (a, b), keys // TOTAL, keys % TOTAL, count


class Classifier:
    """Softmax regression over the presence of chosen buckets. weights: (features + 1, domains), the last row for the bias."""

    def __init__(self, known: np.ndarray, weights: np.ndarray):
        self.known, self.weights = known, weights

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors, whole GRID-ths that sum to GRID, and words of each text."""
        z = np.tile(self.weights[-1], (len(texts), 1))
        n = np.zeros(len(texts), dtype=np.int64)
        for (a, b), row, at, count in _present(texts, self.known):
            n[a:b] = count
            for d in range(z.shape[1]):
                z[a:b, d] += np.bincount(row, weights=self.weights[at, d], minlength=b - a)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        share = GRID * np.round(p / p.sum(axis=1, keepdims=True), 9)
        whole = np.floor(share).astype(np.int64)
        order = np.argsort(-(share - whole), axis=1, kind="stable")  # what is left goes to the largest fractions
        left = GRID - whole.sum(axis=1)
        np.put_along_axis(whole, order, np.take_along_axis(whole, order, 1) + (np.arange(z.shape[1]) < left[:, None]), 1)
        return whole, n


def fit_softmax(x: np.ndarray, y: np.ndarray, domains: int, decay: float = 2e-3, steps: int = 400) -> np.ndarray:
    """Weights by accelerated gradient descent on the mean log loss; the last row is the bias."""
    x = np.hstack((x, np.ones((len(x), 1))))
    target = np.eye(domains)[y]
    w = np.zeros((x.shape[1], domains))
    seen, rate = w.copy(), 4.0 / max(1.0, np.linalg.norm(x, 2) ** 2 / len(x))
    for k in range(steps):
        z = x @ seen
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = seen - rate * (x.T @ (p - target) / len(x) + decay * seen)
        seen, w = new + k / (k + 3) * (new - w), new
    return w


def train(docs: DataFrame, sample: DataFrame, domains: list[str]) -> Classifier:
    """docs: id, text. Buckets are chosen and weights fitted on the sample; counts and chosen bits only reach the driver."""
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    met = docs.join(F.broadcast(sample), "id").select("id", "text", number.cast("int").alias("y"), F.xxhash64("text").alias("h")).where("y >= 0")
    rows = checkpoint(met.groupBy("id").agg(F.min_by(F.struct("text", "y"), "h").alias("x")).select("x.*"))  # rows that repeat an id are no more than one

    @tidied
    def count(tables):
        total = np.zeros((len(domains), TOTAL), dtype=np.int64)
        for table in tables:
            y = np.array(table.column("y").to_pylist())
            for first, texts in encoded(table.column("text")):
                for (a, b), row, at, _ in _present(texts):
                    for d in range(len(domains)):
                        total[d] += np.bincount(at[y[first + a : first + b][row] == d], minlength=TOTAL)
        d, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(at), pa.array(total[d, at])], ["d", "at", "n"])

    present = np.zeros((len(domains), TOTAL))
    for r in rows.mapInArrow(count, "d long, at long, n long").groupBy("d", "at").agg(F.sum("n").alias("n")).collect():
        present[r.d, r["at"]] = r.n
    sizes = np.zeros(len(domains))
    for r in rows.groupBy("y").count().collect():
        sizes[r.y] = r["count"]
    if not sizes.sum():
        return Classifier(np.zeros(0, dtype=np.int64), np.array([[0.0] + [-60.0] * (len(domains) - 1)]))
    expected = present.sum(axis=0) * (sizes / sizes.sum())[:, None]
    chi = ((present - expected) ** 2 / np.maximum(expected, 1)).sum(axis=0)
    known = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])

    @tidied
    def bits(tables):
        for table in tables:
            out = [None] * table.num_rows
            for first, texts in encoded(table.column("text")):
                for (a, b), row, at, _ in _present(texts, known):
                    grid = np.zeros((b - a, len(known)), dtype=np.uint8)
                    grid[row, at] = 1
                    for k in range(b - a):
                        out[first + a + k] = np.packbits(grid[k]).tobytes()
            yield pa.RecordBatch.from_arrays([table.column("y"), pa.array(out, pa.binary())], ["y", "x"])

    got = rows.mapInArrow(bits, "y int, x binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.x)))  # the same sums in any order of tasks
    x = np.array([np.unpackbits(np.frombuffer(bytes(r.x), np.uint8))[: len(known)] for r in got], dtype=float)
    return Classifier(known, fit_softmax(x, np.array([r.y for r in got]), len(domains)))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with n_tokens (words) and p (whole GRID-ths for each domain)."""
    known, weights = model.known, model.weights

    @F.arrow_udf("n_tokens long, p array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(known, weights)
        for texts in columns:
            parts = [model.posteriors(part) for _, part in encoded(texts)] or [(np.zeros((0, weights.shape[1]), dtype=np.int64), np.zeros(0, dtype=np.int64))]
            p, n = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(p.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["n_tokens", "p"])
        tidy()

    (r,) = fresh(docs, "r")
    run = run.asNondeterministic()  # it isn't, but filters over its result would have it evaluated twice
    return docs.withColumn(r, run("text")).select(*map(quoted, docs.columns), f"{r}.n_tokens", f"{r}.p")


def rate(p: Column, residuals: list[list[float]], ridge: float = RIDGE) -> Column:
    """The rate after the steps whose residuals are given, to hundredths. A step goes from the accelerated point and stops at zero."""
    if not residuals:
        return F.lit(1.0)
    steps = F.array(*(F.struct(F.array(*map(F.lit, r)).alias("g"), F.lit(k / (k + 3)).alias("m")) for k, r in enumerate(residuals)))
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a / float(GRID) * b), F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))

    def step(a, s):
        new = F.greatest(F.lit(0.0), a["y"] - (dot(s["g"]) + ridge * (a["y"] - 1.0)) / (1.0 + ridge))
        return F.struct(new.alias("r"), (new + s["m"] * (new - a["r"])).alias("y"))

    return F.aggregate(steps, start, step, lambda a: a["y"])


def solve(weighed: DataFrame, target: dict[str, float], domains: list[str], total: float | None = None, hold: tuple[str, float] | None = None, steps: int = STEPS, ridge: float = RIDGE) -> list[list[float]]:
    """Relative residuals of each step. target: weights of the domains in the mixture, of `total` tokens (all there are, if null).

    hold: a domain and by what its expected tokens shall be multiplied; the total follows from its weight.
    """
    grouped = checkpoint(weighed.groupBy("p").agg(F.sum("n_tokens").alias("n")))
    sums = [F.sum(F.col("n") * F.element_at("p", d + 1)).cast("double") for d in range(len(domains))]
    now = [(x or 0.0) / GRID for x in grouped.agg(*sums).first()]
    whole = sum(now)
    if not whole:
        return []
    weight = {d: target.get(d, 0.0) / sum(target.values()) for d in domains}
    if hold is not None and weight[hold[0]] > 0:
        total = hold[1] * now[domains.index(hold[0])] / weight[hold[0]]
    aim = [weight[d] * (total or whole) / whole for d in domains]
    residuals: list[list[float]] = []
    for _ in range(steps):
        y = rate(F.col("p"), residuals, ridge)
        met = grouped.withColumn("y", y).agg(*(F.sum(F.col("n") * F.col("y") * F.element_at("p", d + 1) / float(GRID)).alias(f"s{d}") for d in range(len(domains)))).first()
        residuals.append([(s / whole - t) / max(n / whole, 1e-6) for s, t, n in zip(met, aim, now, strict=True)])
        if len(residuals) > 5 and max(abs(a - b) for a, b in zip(residuals[-1], residuals[-2], strict=True)) < 1e-4:
            break
    return residuals


def rates(df: DataFrame, labels: DataFrame, domain: Column, target: dict[str, float], hold: tuple[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Classifier, list[list[float]]]:
    """(id_col, n_tokens, p, rate and copies of each row, from a checkpoint; the classifier; the residuals of the steps)."""
    require(df, id_col, text_col)
    bound_batches(df.sparkSession)
    domains = list(target)
    docs = df.select(quoted(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    model = train(docs, labelled_sample(labels, domain), domains)
    weighed = checkpoint(posteriors(docs, model).drop("text"))
    residuals = solve(weighed, target, domains, total, hold)
    return weighed.select(F.col("id").alias(id_col), "n_tokens", "p", *_decided(F.col("p"), F.col("id"), residuals)), model, residuals


def _decided(p: Column, id_: Column, residuals: list[list[float]]) -> tuple[Column, Column]:
    r = F.round(F.greatest(F.lit(0.0), rate(p, residuals)), 2)
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), id_), 11) / float(1 << 53)
    return r.alias("rate"), (F.floor(r) + F.when(uniform < r - F.floor(r), 1).otherwise(0)).cast("int").alias("copies")


def mix_documents(df: DataFrame, labels: DataFrame, domain: Column, target: dict[str, float], hold: tuple[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows, each as often as its copies say, with df's columns. Posteriors are computed again rather than moved."""
    _, model, residuals = rates(df, labels, domain, target, hold, total, id_col, text_col)
    inner = df.select(F.struct(*map(quoted, df.columns)).alias("row"), text_or_empty(text_col).alias("text"))
    with_p = posteriors(inner, model)
    copies = _decided(F.col("p"), F.col("row")[id_col], residuals)[1]
    return with_p.select("row", copies).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
