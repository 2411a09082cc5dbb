"""A quality classifier by importance resampling.

Two generative models over hashed n-grams of whole texts: of all documents, and of target documents, which are labelled
good. A document's evidence is the mean, over its n-grams, of the log ratio of target to raw probability. N-grams of a text are far from
independent, so a sum of log ratios overstates; labelled rows tell how much a unit of evidence is worth: a logistic fit turns it
into log odds of being a target document, which less those of the labelled rows as a whole are the log weight: the calibrated log ratio of
target to other documents. For the fit each labelled row is judged by a target model that leaves out its own fold of FOLDS.

Documents are drawn without replacement by Gumbel top-k: a Gumbel number, fixed by seed and id, is added to each log weight,
and the k largest are kept. k is the budget; unless given it is the count of documents whose ratio is above one.
Documents near the k-th place are kept by chance, in the proportion of their ratios.

The raw model counts every document. The labelled rows are a documented sample of at most SAMPLE, the first by a hash of their id.
Labels of an id that has both are the lesser; all rows of an id share its label.

Null and empty texts have no evidence and the log odds of none. Without labelled rows of both kinds evidence counts one
to one; without any every document is kept. Texts of any length are read whole. Ties at the k-th place are all kept, so repeated rows are
treated alike. Rows with a null id draw the number of a null. Extra columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, checkpoint, encoded, kth_largest, quoted, require, text_or_empty, tidied, tidy
from lexweave.llm.features import batches, layout, sums

SAMPLE = 20_000
VIEWS = ("words", "shapes")
PLACES, TOTAL = layout(VIEWS)
#: Counts that a bucket's ratio is drawn towards 1 by.
PRIOR = 200.0
#: N-grams without evidence that a text is taken to have besides its own, so that a few words count for little.
BLANK = 5
SEED = 17
FOLDS = 3


def labelled_sample(labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """id, label, fold: at most `most` labelled rows, the first by a hash of the id; one label per id, the least."""
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    first = known.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "label").limit(most).groupBy("id").agg(F.min("label").alias("label"))
    return first.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int"))


def count_models(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all rows of (text, fold), and over the target rows of each fold, (FOLDS, buckets); fold is null where a row isn't target. Tasks send one row per bucket that they met."""
    names = ["raw", *(f"t{f}" for f in range(FOLDS))]

    @tidied
    def count(tables):
        totals = np.zeros((1 + FOLDS, TOTAL), dtype=np.int64)
        for table in tables:
            fold = np.array([-1 if f is None else f for f in table.column("fold").to_pylist()], dtype=np.int64)
            for first, texts in encoded(table.column("text")):
                for (a, b), views, _ in batches(texts, VIEWS):
                    part = fold[first + a : first + b]
                    for at, starts in views.values():
                        totals[0] += np.bincount(at, minlength=TOTAL)
                        of = np.repeat(part, np.diff(starts)) if (part >= 0).any() else part[:0]
                        for f in np.unique(of[of >= 0]).tolist():
                            totals[1 + f] += np.bincount(at[of == f], minlength=TOTAL)
        met = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(x[met]) for x in totals)], ["bucket", *names])

    counted = docs.select("text", "fold").mapInArrow(count, ", ".join(f"{n} long" for n in ["bucket", *names]))
    out = np.zeros((1 + FOLDS, TOTAL))
    for bucket, *values in counted.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect():
        out[:, bucket] = values
    return out[0], out[1:]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, within its view."""
    out = np.zeros(TOTAL)
    for part in PLACES.values():
        if raw[part].sum() and target[part].sum():
            expected = raw[part] / raw[part].sum() * target[part].sum()
            out[part] = np.log((target[part] + PRIOR) / (expected + PRIOR))
    return out


def weigher(ratio: np.ndarray, without: np.ndarray | None = None):
    """The evidence of a text column: the mean log ratio of its n-grams and BLANK more without any.

    without: the ratios of the models that leave a fold out; the column function then takes the fold too, and rows that have one get their evidence by those.
    """
    blob = np.vstack([ratio, *([] if without is None else without)]).astype(np.float32).tobytes()

    def weighed(texts: pa.Array, which: np.ndarray) -> pa.Array:
        tables = np.frombuffer(blob, dtype=np.float32).reshape(-1, TOTAL).astype(np.float64)
        out, n = np.zeros(len(texts)), np.full(len(texts), float(BLANK))
        for first, part in encoded(texts):
            for (a, b), views, _ in batches(part, VIEWS):
                use = which[first + a : first + b]
                for at, starts in views.values():
                    n[first + a : first + b] += np.diff(starts)
                    for k in np.unique(use).tolist():
                        x = sums(tables[k][at], starts)
                        out[first + a : first + b] += np.where(use == k, x, 0.0)
        return pa.array(np.round(out / n, 9))

    if without is None:

        @F.arrow_udf("double")
        def weigh(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in columns:
                yield weighed(texts, np.zeros(len(texts), dtype=np.int64))
            tidy()

        return weigh

    @F.arrow_udf("double")
    def weigh_apart(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, folds in columns:
            yield weighed(texts, np.array([0 if f is None else 1 + f for f in folds.to_pylist()], dtype=np.int64))
        tidy()

    return weigh_apart


def calibrate(evidence: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the log ratio of target to other documents by the evidence: the logistic fit to smoothed labels, by Newton's method, less the labels' own log odds.

    The smoothing, one more of each kind, keeps the slope finite where the kinds are apart. (1, 0) unless there are both kinds with different evidence.
    """
    n_good, n = int(good.sum()), len(good)
    if not 0 < n_good < n or np.ptp(evidence) == 0:
        return 1.0, 0.0
    aim = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n - n_good + 2))
    mean, spread = evidence.mean(), evidence.std()
    x = np.stack(((evidence - mean) / spread, np.ones(n)), axis=1)
    loss = lambda w: float(np.sum(np.logaddexp(0, x @ w) - aim * (x @ w)))
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - aim))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread - np.log(n_good / (n - n_good)))


def gumbel(id_col: Column, seed: Column | int = SEED) -> Column:
    """A standard Gumbel number fixed by the seed and the id."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    uniform = (F.shiftrightunsigned(F.xxhash64(seed, id_col), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> tuple[DataFrame, Column, float, int]:
    """(id, log_weight and key of each row, from a checkpoint; the key as a function of df's columns; the least key that is kept; the budget)."""
    require(df, id_col, text_col)
    bound_batches(df.sparkSession)
    sample = labelled_sample(labels)
    docs = df.select(quoted(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "id", "left")
    raw, folds = count_models(docs.select("text", F.when(F.col("label") == 1, F.col("fold")).alias("fold")))
    target = folds.sum(axis=0)
    weigh, apart = weigher(log_ratio(raw, target)), weigher(log_ratio(raw, target), np.array([log_ratio(raw, target - f) for f in folds]))
    weighed = checkpoint(docs.select("id", weigh("text").alias("evidence")))
    known = docs.where("label IS NOT NULL").select("id", "label", apart("text", "fold").alias("evidence"))
    held = known.groupBy("id").agg(F.min(F.struct("label", "evidence")).alias("x")).select("id", "x.*").orderBy("id").collect()
    slope, intercept = calibrate(np.array([r.evidence for r in held]), np.array([r.label == 1 for r in held], dtype=bool))
    odds = lambda evidence: F.round(evidence * slope + intercept, 6)
    scores = weighed.select("id", odds(F.col("evidence")).alias("log_weight")).withColumn("key", F.col("log_weight") + gumbel(F.col("id")))
    if budget is None:
        budget = scores.where("log_weight > 0").count() if held else scores.count()
    least = kth_largest(scores, "key", budget)
    return scores, odds(weigh(text_or_empty(text_col))) + gumbel(quoted(id_col)), least, budget


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """id_col, log_weight, key, budget, kept of each row. Other columns are left out."""
    scores, _, least, k = score(df, labels, id_col, text_col, budget)
    return scores.select(F.col("id").alias(id_col), "log_weight", "key", F.lit(k).cast("long").alias("budget"), (F.col("key") >= least).alias("kept"))


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """The rows of df that are drawn, with all their columns. Texts are weighed again rather than moved."""
    _, key, least, _ = score(df, labels, id_col, text_col, budget)
    return df.where(key >= least)
