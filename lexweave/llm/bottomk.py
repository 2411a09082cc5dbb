"""Near-duplicate documents: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact Jaccard.

A document's set holds its distinct 5-word shingles. Equal sets form a class, which has a number and its least id's text.
A sketch keeps the k least hash values of a set. Steps:

1. Inverted lists: each retained value with the classes that retain it. Lists of one class are dropped.
2. Short lists (up to SHORT classes) make pairs. A pair's shared short lists, with the long lists that both are in, bound its
   sketches' overlap from above; pairs that can't reach the least overlap go. The union's sketch then estimates the
   similarity, and what stays far below the threshold goes. The rest is confirmed on the full sets.
3. A pair in no common short list shares long lists only, at least as many as the least overlap t. Classes in that many take
   part in all their long lists but the t - 1 most common, by one order of all lists: the rarest list that such a pair shares
   has t - 1 shared ones after it, so both keep it and they meet. Lists are dealt in blocks of bounded size, and each block
   meets each other twice. First by sketches alone: a class stays where it has a partner, not yet in its component, that the
   union's sketch allows. Then those that stay meet with their texts, and what joins two components that are still apart is
   confirmed on full sets: a forest comes back instead of all pairs. This is done in one list of each class first, the one
   of its least value, so that large groups of near copies are one component before their other lists are looked at.
4. Components by alternating large and small stars over the links, until the edges are stars; a component is named by its least id.
   Stars that step 3 has made stand for their links in step 4.

Recall: of a pair at 75 %, the union's k=32 least values are shared with probability 3/4 each, so fewer than 11 have a chance
of about one in ten million; at 85 % it is negligible. Fewer than 57 % of 256 have one of less than one in ten billion. Pairs that
share that many always meet.

Texts without words (null, empty, blank) have an empty set and link with nothing. Rows without an id take no part: their
component is null and they are kept. Repeated rows give a row each, and rows that repeat an id with other texts are judged by
their own. Texts of any length are read whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexweave.llm.common import bound_batches, checkpoint, chunks, encoded, foretold, fresh, mix, quoted, require, rolling, text_or_empty, tidy, word_hashes

WORDS = 5  #: words of a shingle
K = 32  #: values of a sketch
THRESHOLD = 75  #: per cent
LEAST = 34  #: per cent of the union's sketch that a candidate shares at least
WIDE_K, WIDE_LEAST = 256, 57  #: the same of the wider sketches by which long lists are looked at
SHORT = 64  #: classes of a short list
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000  #: bounds of a block
FEW_BLOCKS = 16  #: of a list, beside its largest group, that meet all others as they are
EXACT_SETS = 8  #: sets of shingles themselves that a worker keeps for the next pairs


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's shingles; of fewer words than five, the whole sequence is one."""
    for a, b in chunks(texts):
        words, starts = word_hashes(texts[a:b])
        grams = rolling(words, WORDS)
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s >= WORDS:
                yield np.unique(grams[s : e - WORDS + 1] >> np.uint64(1)).astype(np.int64)
            elif e > s:
                with np.errstate(over="ignore"):
                    yield (mix(rolling(words[s:e], e - s) + np.uint64(e - s)) >> np.uint64(1)).astype(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """id, h (of the text), n (shingles), key (of the set), sketch (its k least values, ascending) of each row."""
    require(df, id_col, text_col)
    bound_batches(df.sparkSession)
    kinds = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    @F.arrow_udf("n long, key binary, sketch array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [{"n": len(s), "key": hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "sketch": s[:k].copy()} for _, part in encoded(texts) for s in shingle_sets(part)]
            yield pa.array(out, kinds)
        tidy()

    return df.select(quoted(id_col).alias("id"), _text_hash(text_col).alias("h"), run(text_or_empty(text_col)).alias("r")).select("id", "h", "r.*")


def exact_set(text: bytes) -> set:
    """The shingles themselves: tuples of words."""
    words = text.lower().split()
    return {tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)} if len(words) >= WORDS else {tuple(words)} if words else set()


def exactly(one: set, two: set) -> bool:
    """Whether two sets of shingles are linked."""
    return bool(one and two) and _linked(len(one & two), len(one), len(two))


def _text_hash(text_col: str):
    """With the id, it tells rows apart that repeat an id with other texts."""
    return F.xxhash64(text_or_empty(text_col))


def _linked(shared, x, y):
    return 100 * shared >= THRESHOLD * (x + y - shared)


def _needed(n, k: int = K, least: int = LEAST):
    """The least overlap of sketches of sets of n shingles."""
    return F.ceil(F.least(n, F.lit(k)) * least / 100).cast("int")


def _needed_by_any(n, k: int = K, least: int = LEAST):
    """The least overlap with the sketch of any set that one of n shingles may be linked to; the smaller set of a pair sets it. Sketches that hold both sets whole share what the sets share."""
    smallest = F.ceil(n * THRESHOLD / 100)
    return F.when(n * 100 <= THRESHOLD * k, smallest.cast("int")).otherwise(_needed(smallest, k, least))


@F.arrow_udf(T.BooleanType())
def confirm(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Whether two texts' full sets are similar enough: by hashes of shingles first, then by the shingles themselves."""
    for one, two in batches:
        found = []
        for (_, a), (_, b) in zip(encoded(one, 256), encoded(two, 256), strict=True):
            distinct = list(dict.fromkeys(a + b))
            sets = dict(zip(distinct, shingle_sets(distinct), strict=True))
            exact = functools.lru_cache(maxsize=EXACT_SETS)(exact_set)
            close = lambda x, y: _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
            found += [bool(close(sets[x], sets[y])) and exactly(exact(x), exact(y)) for x, y in zip(a, b, strict=True)]
        yield pa.array(found, pa.bool_())
    tidy()


class _Rows:
    """Sets of numbered values side by side, so that one set is met with many in a few numpy steps."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.flat = flat.reshape(-1)
        self.mask = np.zeros(len(self.values), dtype=np.int32)

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i + 1]]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many values row i shares with each of the others; no row is empty."""
        sizes = self.sizes[others]
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.repeat(self.starts[others] - begin, sizes) + np.arange(int(sizes.sum()))
        self.mask[self.row(i)] = 1
        out = np.add.reduceat(self.mask[self.flat[at]], begin)
        self.mask[self.row(i)] = 0
        return out


PAD = (1 << 63) - 1


def union_share(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sketch and each of others, rows filled up with PAD: values of the union's sketch that both have, and its size."""
    x = np.sort(np.concatenate((np.broadcast_to(one, many.shape), many), axis=1), axis=1)
    real = x < PAD
    same = (x[:, 1:] == x[:, :-1]) & real[:, 1:]
    place = np.arange(1, x.shape[1]) - np.cumsum(same, axis=1)
    return (same & (place < K)).sum(axis=1), np.minimum(real.sum(axis=1) - same.sum(axis=1), K)


class Sketches:
    """Sketches side by side, with the sizes of their sets, a group each, and a side if only rows of different sides meet."""

    def __init__(self, sketches: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, side: np.ndarray | None):
        self.sizes, self.group, self.side, self.rows = sizes, group, side, _Rows(sketches)
        self.table = np.full((len(sketches), K), PAD, dtype=np.int64)
        self.table[np.arange(K) < self.rows.sizes[:, None]] = np.concatenate(sketches)
        self.least = np.ceil(np.minimum(sizes, K) * LEAST / 100)
        self.order = np.argsort(sizes, kind="stable")

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row, smaller sets first, with the later rows of other groups that may be similar enough. Groups and the mask `skip` may change on the way."""
        self.skip = np.zeros(len(self.sizes), dtype=bool)
        for at, i in enumerate(self.order.tolist()):
            others = self.order[at + 1 :]
            others = others[(self.group[others] != self.group[i]) & (THRESHOLD * self.sizes[others] <= 100 * self.sizes[i])]
            if self.side is not None:
                others = others[self.side[others] != self.side[i]]
            if self.skip[i]:
                others = others[~self.skip[others]]
            if len(others):
                others = others[self.rows.shared(i, others) >= self.least[i]]
            if len(others):
                shared, size = union_share(self.table[i], self.table[others])
                others = others[100 * shared >= LEAST * size]
            if len(others):
                yield i, others


def with_partners(sketches: Sketches) -> np.ndarray:
    """Whether each row has a partner."""
    for i, others in sketches.partners():
        sketches.skip[i] = sketches.skip[others] = True
    return sketches.skip


def forest(ids: list[int], texts: list[bytes], side: np.ndarray | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Stars that join rows into the components that all links, confirmed on full sets, and the groups would; side: only rows of different sides meet.

    A star's centre is the least id; a group is joined by its first row. What hashes of shingles find is confirmed on the shingles themselves before it joins two components.
    """
    sets = list(shingle_sets(texts))
    full, exact = _Rows(sets), functools.lru_cache(maxsize=EXACT_SETS)(lambda k: exact_set(texts[k]))
    first, before = np.unique(np.arange(len(ids)) if group is None else group, return_index=True, return_inverse=True)[1:]
    label = before.reshape(-1).copy()
    for i, others in Sketches([s[:K] for s in sets], full.sizes, label, side).partners():
        others = others[_linked(full.shared(i, others), full.sizes[i], full.sizes[others])]
        for j in others.tolist():
            if label[i] != label[j] and exactly(exact(i), exact(j)):
                label[label == label[j]] = label[i]
    stars: dict[int, list[int]] = {}
    for row in first.tolist():
        stars.setdefault(int(label[row]), []).append(ids[row])
    return [(min(star), x) for star in stars.values() for x in star if x != min(star)]


def _block_candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    side = None if pdf["i"].iloc[0] == pdf["j"].iloc[0] else pdf["b"].to_numpy()
    stay = with_partners(Sketches([np.asarray(x, dtype=np.int64) for x in pdf["sketch"]], pdf["n"].to_numpy(), pdf["group"].to_numpy(), side))
    return pdf.loc[stay, ["v", "i", "j", "b", "rep", "group"]]


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    side = None if pdf["i"].iloc[0] == pdf["j"].iloc[0] else pdf["b"].to_numpy()
    return pd.DataFrame(forest(pdf["rep"].tolist(), [t.encode() for t in pdf["text"]], side, pdf["group"].to_numpy()), columns=["a", "b"]).astype("int64")


def _lists(entries: DataFrame) -> DataFrame:
    """v, the blocks that a list takes, its largest group (big), and the blocks of that (m) and of the others (r), of lists that hold two groups or more. entries: v, rep, n, group."""
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("int")
    sizes = entries.groupBy("v", "group").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    lists = sizes.groupBy("v").agg(F.count("*").alias("groups"), F.max(F.struct("rows", "group", "all")).alias("of"), F.sum("rows").alias("rows"), F.sum("all").alias("all")).where("groups > 1")
    return lists.select("v", blocks(F.col("rows"), F.col("all")).alias("blocks"), F.col("of.group").alias("big"), blocks(F.col("of.rows"), F.col("of.all")).alias("m"), blocks(F.col("rows") - F.col("of.rows"), F.col("all") - F.col("of.all")).alias("r"))


def _inside_blocks(entries: DataFrame, classes: DataFrame, docs: DataFrame, deal: int) -> DataFrame:
    """Confirmed links between the groups of classes that stand in one block of a list, as `deal` deals them."""
    dealt = entries.join(_lists(entries).select("v", "blocks"), "v").withColumn("b", F.pmod(F.xxhash64("rep", "v", F.lit(deal)), F.col("blocks")).cast("int"))
    return _met_in(dealt.select("v", F.col("b").alias("i"), F.col("b").alias("j"), "b", "rep", "n", "group").join(classes.select("rep", "sketch"), "rep"), classes, docs)


def _in_blocks(entries: DataFrame, lists: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between the groups of classes that share one of the lists. Blocks of a list's largest group meet only the others."""
    one, first = F.col("blocks") == 1, F.col("group") == F.col("big")
    slot = lambda count: F.pmod(F.xxhash64("rep", "v"), count).cast("int")
    last = F.col("m") + F.col("r") - 1
    block = F.when(one, 0).when(first, slot(F.col("m"))).otherwise(F.col("m") + slot(F.col("r")))
    others = F.when(one, F.array(F.lit(0))).when(first, F.sequence(F.col("m"), last)).otherwise(F.sequence(F.lit(0), last))
    dealt = entries.join(lists, "v").select("v", block.alias("b"), "rep", "n", "group", others.alias("os")).join(classes.select("rep", "sketch"), "rep").withColumn("o", F.explode("os"))
    return _met_in(dealt.select("v", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "n", "group", "sketch"), classes, docs)


def _met_in(met: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    stay = checkpoint(met.groupBy("v", "i", "j").applyInPandas(_block_candidates, "v long, i int, j int, b int, rep long, group long"))
    texts = _texts_of(docs, checkpoint(classes.join(stay.select("rep").distinct(), "rep", "left_semi").select("id", "h", "rep")))
    return stay.join(texts, "rep").groupBy("v", "i", "j").applyInPandas(_block_links, "a long, b long")


def _prefixes(lists: DataFrame, k: int, least: int) -> DataFrame:
    """Of classes (rep, n) in lists (v, size), the lists of each but the most common ones, as many as a linked class shares beyond the rarest that it shares."""
    ranked = Window.partitionBy("rep").orderBy(F.desc("size"), "v")
    needed = _needed_by_any(F.col("n"), k, least)
    return lists.withColumn("k", F.row_number().over(ranked)).where(F.col("k") >= needed)


def _widely(entries: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The classes of entries (v, rep, n, group) in lists of wider sketches: v, rep, n, group of those that may have a partner."""
    bound_batches(docs.sparkSession)
    known = checkpoint(entries.select("rep", "n", "group").distinct())
    texts = _texts_of(docs, checkpoint(classes.join(known, "rep", "left_semi").select("id", "h", "rep")))

    @F.arrow_udf("array<long>")
    def wide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s[:WIDE_K] for _, part in encoded(batch) for s in shingle_sets(part)], pa.list_(pa.int64()))
        tidy()

    values = checkpoint(texts.select("rep", F.explode(wide("text")).alias("v")))
    counts = values.groupBy("v").agg(F.count("*").alias("size")).where("size > 1")
    lists = values.join(counts, "v").join(known, "rep")
    return _prefixes(lists, WIDE_K, WIDE_LEAST).select("v", "rep", "n", "group")


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to")), F.struct(F.col("v").alias("x"), F.lit(0).alias("from"), F.lit(1).alias("to")))))
    return ends.groupBy("x").agg(F.sum("from").alias("from"), F.max("to").alias("to")).where("from > 1 OR from = 1 AND to = 1").isEmpty()


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) as stars (u, v): v is the least id that links lead to from u, by alternating large and small stars. Ids that are least have no row.

    All edges lead from a larger id u to a smaller one v. So the least neighbour of v in a large star is the least that an edge from v leads to, and
    neither step needs the edges in both directions.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        return e.join(least(e), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        met = e.join(least(e), F.col("u") == F.col("w"))
        return met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))

    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _settled(edges):
        edges = checkpoint(small(large(edges)).distinct())
    return edges


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id that links lead to) of each id in the links (a, b)."""
    edges = _stars(links)
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.union(edges.select("v", "v").distinct())


def _texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """rep and text of the classes (id, h, rep), one row each. The bitmap keeps the others' texts from being moved."""
    return foretold(docs, classes, "id")[0].join(classes, ["id", "h"]).select("rep", "text").dropDuplicates(["rep"])


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of classes (rep, id, h, n, sketch) by their numbers, enough for the components of all links. docs: id, h, text."""
    entries = classes.select("rep", "n", F.explode("sketch").alias("v"))
    counts = entries.groupBy("v").agg(F.count("*").alias("size")).where("size > 1")
    lists = entries.join(counts, "v")
    long = F.count_if(F.col("size") > SHORT).alias("n_long")
    lists = checkpoint(lists.join(lists.groupBy("rep").agg(long), "rep").select("v", "rep", "n", "size", "n_long"))

    # pairs of short lists
    short = lists.where(F.col("size") <= SHORT)
    one = short.select("v", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("n_long").alias("la"))
    two = short.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("n_long").alias("lb"))
    alike = (F.col("a") < F.col("b")) & (THRESHOLD * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))
    pairs = one.join(two, "v").where(alike).groupBy("a", "b").agg(F.count("*").alias("met"), F.first(F.least("la", "lb")).alias("more"), F.first(F.greatest("na", "nb")).alias("n"))
    pairs = pairs.where(F.col("met") + F.col("more") >= _needed(F.col("n"))).select("a", "b")
    x = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("x"))
    y = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("x", "y"), F.col("union")))
    pairs = pairs.join(x, "a").join(y, "b").withColumn("union", union).where(100 * shared >= LEAST * F.size("union"))
    pairs = checkpoint(pairs.select("a", "b"))

    # classes that may be alike with no short list in common
    needed = _needed_by_any(F.col("n"))
    dense = _prefixes(lists.where((F.col("size") > SHORT) & (F.col("n_long") >= needed)), K, LEAST)
    dense = checkpoint(dense.select("v", "rep", "n"))

    wanted = checkpoint(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi").select("id", "h", "rep"))
    texts = checkpoint(_texts_of(docs, wanted))
    left, right = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    found = checkpoint(pairs.join(left, "a").join(right, "b").withColumn("ok", confirm("ta", "tb")).where("ok").select("a", "b"))
    one_list = checkpoint(dense.groupBy("rep").agg(F.min("v").alias("v"), F.first("n").alias("n")))
    one_list = one_list.withColumn("group", F.col("rep"))
    found = found.union(checkpoint(_inside_blocks(one_list, classes, docs, 1)))
    if _lists(one_list).where("blocks > 1").isEmpty():
        labels = _labels(found)
    else:
        found = found.union(checkpoint(_inside_blocks(checkpoint(_named(one_list, _labels(found))), classes, docs, 2)))
        # from here on the stars stand for the links that they come from
        found = _stars(found).select(F.col("u").alias("a"), F.col("v").alias("b"))
        labels = found.select(F.col("a").alias("rep"), F.col("b").alias("group"))
    named = checkpoint(_named(dense, labels))
    lists = checkpoint(_lists(named))
    few = (F.col("blocks") == 1) | (F.col("r") <= FEW_BLOCKS)
    found = found.union(checkpoint(_in_blocks(named, lists.where(few), classes, docs)))
    if not (hard := lists.where(~few)).isEmpty():
        wide = checkpoint(_widely(named.join(hard.select("v"), "v", "left_semi"), classes, docs))
        found = found.union(checkpoint(_in_blocks(wide, _lists(wide), classes, docs)))
    return found


def _named(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries (v, rep, n) with the group that labels (rep, group) give them, or one of their own."""
    return entries.select("v", "rep", "n").join(labels, "rep", "left").select("v", "rep", "n", F.coalesce("group", "rep").alias("group"))


def _labels(links: DataFrame) -> DataFrame:
    """rep and a class that links lead to from it, in up to two steps. Equal labels are of one component, which may have several; that is enough to skip pairs."""
    step = links.groupBy(F.greatest("a", "b").alias("rep")).agg(F.min(F.least("a", "b")).alias("group"))
    further = step.select(F.col("rep").alias("group"), F.col("group").alias("_next"))
    return step.join(further, "group", "left").select("rep", F.coalesce("_next", "group").alias("group"))


def _judged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, n, component and kept of each row."""
    rows = checkpoint(sketches(df, id_col, text_col))
    known = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("key").agg(F.min(F.struct("id", "h")).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # a number that can't be null breaks the constraints that Spark derives for the unions of components()
    classes = checkpoint(classes.select("key", F.nullif(F.monotonically_increasing_id(), F.lit(-1)).alias("rep"), "least.id", "least.h", "n", "sketch"))
    docs = df.select(quoted(id_col).alias("id"), _text_hash(text_col).alias("h"), text_or_empty(text_col).alias("text"))
    found = checkpoint(components(links(docs, classes)).withColumnRenamed("id", "rep").withColumnRenamed("component", "group"))
    least = found.join(classes.select("rep", "id"), "rep").groupBy("group").agg(F.min("id").alias("component"))
    found = found.join(least, "group").select("rep", "component")
    named = classes.select("key", "rep", "id").join(found, "rep", "left").select("key", F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "h", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.coalesce("component", "id")
    return out.select("id", "h", "n", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept of each row. Other columns are left out."""
    return _judged(df, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that near_duplicates keeps, with all their columns."""
    id_, h = fresh(df, "gone", "hash")
    gone = checkpoint(_judged(df, id_col, text_col).where("NOT kept").select(F.col("id").alias(id_), F.col("h").alias(h)).distinct())
    some, others = foretold(df, gone, id_col)
    return others.unionByName(some.join(gone, (quoted(id_col) == F.col(id_)) & (_text_hash(text_col) == F.col(h)), "left_anti"))
