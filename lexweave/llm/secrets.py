"""Secret scans with multipart credential linking, by Spark's own functions only.

Three base kinds are reported wherever they stand. Weak kinds (account names, bare tokens, endpoints) are common in clean
text; one is reported only if a part that completes it stands in the same scope, a paragraph of any length: an account
name needs a secret, a bare token an identifier or an endpoint, an endpoint a secret. Spans meet the intervals of their
scopes by one sweep over the positions of a row; which roles a scope holds is an aggregate, so spans that complete each
other are never listed two by two, however many a scope has.

Spans are of whole matches, in code points, ends exclusive. Positions come from a text's pieces between matches: running
sums of their lengths, so any number of matches in any length of text takes linear work.

Null texts count as empty and have no spans. Repeated rows, and rows without an id, are scanned and returned one by one.
Other columns than the id and the text are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import checkpoint, foretold, fresh, quoted, require, text_or_empty


@dataclass(frozen=True)
class Kind:
    name: str
    order: int  #: among spans that start together
    role: str  #: identifier, secret, endpoint or break
    weak: bool
    pattern: str
    group: int = 0  #: whose length counts
    least: int = 1  #: of that length
    holds: str | None = None  #: what that group must hold somewhere


ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Fixed patterns. Runs that are too short can't be part of a longer match of the same class, so their least lengths stand in the pattern.
KINDS = [
    Kind("assign", 0, "secret", False, ASSIGN, 2, 6),
    Kind("access", 1, "identifier", False, r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", 2, "secret", False, r"[0-9a-f]{24,}"),
    Kind("account", 3, "identifier", True, r"(?i:user_?name|user|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)", 1, 3),
    Kind("bare", 4, "secret", True, r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}={0,2}", holds="[0-9]"),
    Kind("endpoint", 5, "endpoint", True, r"https?://[A-Za-z0-9._~:/?#@!&=%+-]+"),
    Kind("break", 9, "break", True, r"\n[\x20\t\r]*\n"),
]
#: What completes a weak part.
COMPLETES = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}


def _found(kind: Kind) -> F.Column:
    """gap (from the match before), size and whether long enough, of each match in `_t`; null where there is none."""
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all("_t", pattern, F.lit(0))
    counted = whole if kind.group == 0 else F.regexp_extract_all("_t", pattern, F.lit(kind.group))
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    gaps = F.slice(lengths(F.split("_t", kind.pattern, -1)), 1, F.size(whole))
    ok = lambda y: (F.length(y) >= kind.least) & (y.rlike(kind.holds) if kind.holds else F.lit(True))
    zipped = F.zip_with(gaps, F.zip_with(lengths(whole), counted, lambda x, y: F.struct(x.alias("n"), ok(y).alias("ok"))), lambda g, m: F.struct(g.alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    return F.when(F.col("_t").rlike(kind.pattern), zipped)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: row, id; spans: row, kind, start, end of every reported span). Both read one checkpoint of the scan."""
    require(df, id_col, text_col)
    d = df.select(quoted(id_col).alias("id"), text_or_empty(text_col).alias("_t"))
    d = d.select("id", *(_found(k).alias(k.name) for k in KINDS))
    parts = [k for k in KINDS if k.role != "break"]
    d = d.select("id", *(k.name for k in parts), F.when(F.coalesce(*(F.col(k.name) for k in parts if k.weak)).isNotNull(), F.col("break")).alias("break"))
    seen = checkpoint(d.withColumn("row", F.monotonically_increasing_id()))

    each = F.array(*(F.struct(F.lit(k.name).alias("kind"), F.lit(k.order).alias("order"), F.lit(k.role).alias("role"), F.lit(k.weak).alias("weak"), F.col(k.name).alias("m")) for k in KINDS))
    spans = seen.select("row", F.explode(each).alias("k")).where(F.col("k.m").isNotNull()).select("row", "k.kind", "k.order", "k.role", "k.weak", F.posexplode("k.m").alias("at", "m"))
    to_here = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(to_here)
    spans = spans.withColumn("end", end).where("m.ok").select("row", "kind", "order", "role", "weak", (F.col("end") - F.col("m.n")).alias("start"), "end")
    linked = link(spans)
    base = spans.where(~F.col("weak")).select("row", "kind", "order", "start", "end")
    return seen.select("row", "id"), base.union(linked)


def link(spans: DataFrame) -> DataFrame:
    """The weak spans (row, kind, order, start, end) that a completing part stands in one scope with."""
    scope = F.count_if(F.col("role") == "break").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = spans.withColumn("scope", scope).where("role <> 'break'")
    held = placed.groupBy("row", "scope").agg(*(F.bool_or(F.col("role") == role).alias(f"has_{role}") for role in COMPLETES))
    completed = F.lit(False)
    for role, others in COMPLETES.items():
        for other in others:
            completed = completed | ((F.col("role") == role) & F.col(f"has_{other}"))
    return placed.where("weak").join(held, ["row", "scope"]).where(completed).select("row", "kind", "order", "start", "end")


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, found (array of start, order, end, kind; sorted) of each row."""
    rows, spans = scan(df, id_col, text_col)
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "order", "end", "kind"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    return rows.join(listed, "row", "left").select(F.col("id").alias(id_col), F.coalesce("found", none).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, n_linked from find()."""
    base = F.filter("found", lambda x: x["order"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["order"] == k)).cast("long")
    return found.select(
        quoted(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["order"] >= 3)).cast("long").alias("n_linked"),
    )


def redact(df: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """df with each reported span of its text replaced; spans that overlap or touch become one mark.

    Spans follow from the text alone, so rows meet their cuts by a digest of the text: ids may be null or repeat.

    length_col: a column that holds the text's length in code points, set anew where the text changes.
    """
    require(df, text_col)
    key, id_, marks, clean = fresh(df, "key", "id", "marks", "clean")
    text = quoted(text_col)
    keyed = df.withColumn(key, F.sha2(text, 256))
    found = find(keyed.select(key, text.alias("text")), key).where(F.size("found") > 0).dropDuplicates([key]).select(F.col(key).alias(id_), F.posexplode("found").alias("at", "x"))
    # a span opens a mark if it starts beyond all spans before it
    earlier = Window.partitionBy(id_).orderBy("at")
    reach = F.max("x.end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select(id_, "at", "x.start", "x.end", F.when(F.col("x.start") <= reach, 0).otherwise(1).alias("opens"))
    spans = spans.withColumn("mark", F.sum("opens").over(earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy(id_, "mark").agg(F.min("start").cast("int").alias("a"), F.max("end").cast("int").alias("b"))
    marked = checkpoint(spans.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias(marks)))
    some, others = foretold(keyed, marked.select(id_), key)
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    before = F.transform(marks, lambda x, k: F.concat(cut(F.when(k == 0, F.lit(0)).otherwise(F.get(marks, k - 1)["b"]), x["a"]), F.lit(mark)))
    after = F.substring(text, F.element_at(marks, -1)["b"] + 1, F.length(text))
    marked_text = F.when(F.col(marks).isNotNull(), F.concat(F.array_join(before, ""), after)).otherwise(text)
    out = some.join(marked, F.col(key) == F.col(id_), "left").withColumn(clean, marked_text)

    def column(c: str) -> F.Column:
        if c == text_col:
            return F.col(clean).alias(c)
        return F.when(F.col(marks).isNotNull(), F.length(clean)).otherwise(quoted(c)).cast(df.schema[c].dataType).alias(c) if c == length_col else quoted(c)

    return others.select(*map(quoted, df.columns)).unionByName(out.select(*map(column, df.columns)))
