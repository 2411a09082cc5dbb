"""Source divergence audit: how far each source's vocabulary lies from the other sources' of its language.

Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII. A language keeps the terms of at least `least`
of its documents. A group (a source's rows of one language) gives each kept term p = 1 + floor(SCALE (n + 1) / (N + V)),
of its count n there, the kept terms' counts N together and their number V; so does the language as a whole. How far p
lies from q is f = floor((p - q)^2 / q).

The sum of f over all kept terms, for each pair of sources, goes by joint count histograms. f depends on a term through its
two counts alone, so for a pair it is enough to know how many terms have each combination of counts:

1. One aggregation gives every kept term's vector: its count in each source that has it. Equal vectors are counted once, with
   their multiplicity; most of a vocabulary is rare terms, which share few vectors.
2. The vectors' entries, two by two, give the cells of which both counts are above zero.
3. The implied cells follow from the margins by signed multiplicities: terms of count c in one source are (c, 0), but for
   those that a cell of step 2 has; terms in neither are (0, 0).
4. f is evaluated once for each combination, in either direction, times its multiplicity. All numbers are whole.

A vector has an entry for each source of its language at most, and the result a row for each two sources, so nothing that is
gathered grows faster than the result. Counts are combined before each shuffle; a source or a term that holds a third of all
rows is one row of each task's partial counts.

Null texts, languages and sources count as ''. Each row is a document, repeated rows too; ids are not read. Texts are read
whole. Tables without rows give no rows; languages that keep no term give pairs of value 0. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import bound_batches, checkpoint, quoted, require, tidied

LEAST = 3  #: documents of a kept term
SCALE = 1_000_000_000
TOP = 200  #: ranks of terms

#: What stands for each byte: a term's byte, lower-cased, or a space.
_TERM = np.full(256, 32, dtype=np.uint8)
for _c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _TERM[_c] = _c | 0x20 if _c < 0x80 else _c


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, in order. Bytes of ASCII never stand inside of another character, so bytes are enough."""
    texts = texts.cast(pa.large_binary()) if not isinstance(texts, pa.LargeBinaryArray) else texts
    _, offsets, data = texts.buffers()
    held = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    spaced = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(_TERM[held]), None, 0, texts.offset)
    return pc.ascii_split_whitespace(spaced)


@tidied
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences) and d (rows that hold it) of each batch."""
    for batch in batches:
        listed = terms_of(batch.column("text"))
        terms, row = pc.list_flatten(listed), pc.list_parent_indices(listed)
        real = pc.not_equal(terms, "")
        terms, row = terms.filter(real).dictionary_encode(), row.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(terms):
            continue
        term, many = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary)
        keys = batch.select(["lang", "source"])
        langs, sources = keys.column(0).dictionary_encode(), keys.column(1).dictionary_encode()
        pair = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
        pairs, group = np.unique(pair, return_inverse=True)
        group = group.reshape(-1)
        in_row = np.unique(row * many + term)  # one for each term of each row
        of_group, n = np.unique(group[row] * many + term, return_counts=True)
        d = np.unique(group[in_row // many] * many + in_row % many, return_counts=True)[1]
        at, which = pairs[of_group // many], pa.array(of_group % many)
        columns = {"lang": langs.dictionary.take(pa.array(at // len(sources.dictionary))), "source": sources.dictionary.take(pa.array(at % len(sources.dictionary))), "term": terms.dictionary.take(which).cast(pa.string()), "n": pa.array(n, pa.int64()), "d": pa.array(d, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a count, exactly."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * big(n + 1), big(F.nullif(total + kept, F.lit(0))))


def apart(p: Column, q: Column) -> Column:
    """f."""
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """What the audit's parts read, each stored once.

    groups: group (a number), lang, source, total (N), kept (V), lang_total.
    terms: lang, term, n (in the language), v (group and count, for each group that has it).
    """

    def __init__(self, df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST):
        require(df, text_col, lang_col, source_col)
        bound_batches(df.sparkSession)
        rows = df.select(*(F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
        groups = checkpoint(rows.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()))
        counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
        counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        entries = counted.join(groups, ["lang", "source"])
        vectors = entries.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("group", "n"))).alias("v"))
        self.terms = checkpoint(vectors.where(F.col("d") >= least).drop("d"))
        langs = self.terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
        totals = self.terms.select(F.explode("v").alias("x")).groupBy("x.group").agg(F.sum("x.n").alias("total"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        known = groups.join(langs, "lang", "left").join(totals, "group", "left")
        self.groups = checkpoint(known.select("group", "lang", "source", zero("total"), zero("kept"), zero("lang_total")))

    def histograms(self) -> DataFrame:
        """a < b (groups of one language), ca, cb, n: how many kept terms have these counts in the two; combinations of zero included."""
        vectors = checkpoint(self.terms.groupBy("v").agg(F.count("*").alias("m")))
        first = vectors.select("m", "v", F.posexplode("v").alias("at", "x")).withColumn("rest", F.slice("v", F.col("at") + 2, F.size("v")))
        both = first.select("m", "x", F.explode("rest").alias("y")).groupBy(F.col("x.group").alias("a"), F.col("y.group").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb")).agg(F.sum("m").alias("n"))
        margins = first.groupBy(F.col("x.group").alias("group"), F.col("x.n").alias("c")).agg(F.sum("m").alias("m"))
        pairs = self._pairs().select("a", "b", "kept")
        zero, cell = F.lit(0).cast("long"), lambda ca, cb, n: F.struct(ca.alias("ca"), cb.alias("cb"), n.alias("n"))
        ca, cb, n, c, m = map(F.col, ("ca", "cb", "n", "c", "m"))
        signed = [
            both.select("a", "b", F.inline(F.array(cell(ca, cb, n), cell(ca, zero, -n), cell(zero, cb, -n), cell(zero, zero, n)))),
            margins.withColumnRenamed("group", "a").join(pairs, "a").select("a", "b", F.inline(F.array(cell(c, zero, m), cell(zero, zero, -m)))),
            margins.withColumnRenamed("group", "b").join(pairs, "b").select("a", "b", F.inline(F.array(cell(zero, c, m), cell(zero, zero, -m)))),
            pairs.select("a", "b", zero.alias("ca"), zero.alias("cb"), F.col("kept").alias("n")),
        ]
        cells = signed[0].union(signed[1]).union(signed[2]).union(signed[3])
        return cells.groupBy("a", "b", "ca", "cb").agg(F.sum("n").alias("n")).where("n > 0")

    def _pairs(self) -> DataFrame:
        """a < b, lang, their sources, totals and kept: the result's rows, but for direction."""
        one = self.groups.select("lang", "kept", F.col("group").alias("a"), F.col("source").alias("sa"), F.col("total").alias("ta"))
        two = self.groups.select("lang", F.col("group").alias("b"), F.col("source").alias("sb"), F.col("total").alias("tb"))
        return one.join(two, "lang").where("a < b")

    def pairs(self) -> DataFrame:
        """lang, source, item (each other source of the language), value."""
        known = self._pairs()
        met = self.histograms().join(known.select("a", "b", "ta", "tb", "kept"), ["a", "b"])
        p, q = share(F.col("ca"), F.col("ta"), F.col("kept")), share(F.col("cb"), F.col("tb"), F.col("kept"))
        each = met.select("a", "b", "n", p.alias("p"), q.alias("q"))
        values = each.groupBy("a", "b").agg(F.sum(F.col("n") * apart(F.col("p"), F.col("q"))).alias("there"), F.sum(F.col("n") * apart(F.col("q"), F.col("p"))).alias("back"))
        side = lambda s, i, v: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.coalesce(F.col(v), F.lit(0)).cast("long").alias("value"))
        return known.join(values, ["a", "b"], "left").select("lang", F.inline(F.array(side("sa", "sb", "there"), side("sb", "sa", "back"))))

    def over_used(self) -> DataFrame:
        """lang, source, item (each kept term of the group of which its p is above the language's), value."""
        entries = self.terms.select("term", F.col("n").alias("c"), F.explode("v").alias("x")).select("term", "c", "x.group", "x.n").join(self.groups, "group")
        each = entries.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("c"), F.col("lang_total"), F.col("kept")).alias("q"))
        return each.where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def audit(df: DataFrame, top: int = TOP, **columns) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: every other source of the language; part term: the `top` terms that a source uses most beyond its language."""
    seen = Audit(df, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part, name: part.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(seen.pairs(), "pair").union(ranked(seen.over_used(), "term").where(F.col("rank") <= top))
