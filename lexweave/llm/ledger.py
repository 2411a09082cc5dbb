"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one bit for each that fails, and the measurements. Policies
are versions of masks over these bits, so a policy is applied, changed or ablated without reading the texts again.
All work is done by Spark's own functions.

Null texts count as empty: no words, which fails the rule of too few. Repeated rows are judged alike; ids may be null.
Texts of any length are read whole. Other columns than the id and the text are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import quoted, require

WORD_SPACES = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    sql: str  #: true where a document fails, over the measurements


#: Whole numbers only, so any engine gives the same bits.
RULES = [
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * word_chars"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "exclamations", "100 * n_exclaims > 20 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "long_words", "word_chars > 25 * n_words"),
    Rule(7, "bars", "100 * n_bars > 15 * n_words"),
]
#: Policy versions: the names of the rules that reject. Versions are only added.
POLICIES = {
    "v1": ["few_words", "repeated_words"],
    "v2": ["few_words", "repeated_words", "symbols", "exclamations", "bars"],
    "v3": [r.name for r in RULES],
}
BASE = "v1"
CURRENT = "v2"


def mask(version: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version])


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for a null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash for each run of five words."""
    at = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>"))


def _sorted_windows(words: Column) -> Column:
    """The runs of five words themselves with their positions, sorted, so that equal ones are neighbours."""
    run = lambda i: F.concat_ws(" ", F.slice(words, i + 1, WINDOW))
    return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(run(i).alias("w"), i.alias("i"))))


def _repeats(windows: Column) -> Column:
    """Positions, ascending, of the windows that have an equal neighbour."""
    same = lambda x, k: (x["w"] == F.get(windows, k - 1)["w"]) | (x["w"] == F.get(windows, k + 1)["w"])
    return F.sort_array(F.array_compact(F.transform(windows, lambda x, k: F.when(same(x, k), x["i"]))))


def _covered(at: Column) -> Column:
    """Words in the windows at these positions: each adds what the one before it doesn't cover."""
    start = F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n"))
    return F.aggregate(at, start, step, lambda a: a["n"])


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the measurements of each row.

    Most texts have as many different window hashes as windows, so that nothing repeats; only the others sort their windows.
    """
    require(df, id_col, text_col)
    text = F.coalesce(quoted(text_col), F.lit(""))
    count = lambda characters: (F.length("_t") - F.length(F.translate("_t", characters, ""))).cast("long")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACES)) != "")
    d = df.select(quoted(id_col).alias("_id"), text.alias("_t"))
    d = d.select(
        "_id", words_of(F.col("_t")).alias("_w"), lines.alias("_l"), count(WORD_SPACES).alias("_spaces"), F.length("_t").cast("long").alias("_chars"),
        count("#*$%&|<>").alias("n_symbols"), count("!").alias("n_exclaims"), count("|").alias("n_bars"),
    )
    d = d.select(
        "_id", "n_symbols", "n_exclaims", "n_bars", F.size("_w").cast("long").alias("n_words"), (F.col("_chars") - F.col("_spaces")).alias("word_chars"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), "_w", _window_hashes(F.col("_w")).alias("_h"),
    )
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _sorted_windows(F.col("_w")))).drop("_w", "_h")
    d = d.withColumn("_s", F.when(F.col("_s").isNotNull(), _repeats(F.col("_s"))))
    return d.withColumn("n_repeat_words", F.when(F.col("_s").isNotNull(), _covered(F.col("_s"))).otherwise(F.lit(0).cast("long"))).drop("_s").withColumnRenamed("_id", id_col)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() with fail_bits: bit k is set where the rule of bit k fails."""
    bits = sum((F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return measure(df, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def apply_policy(book: DataFrame, version: str) -> DataFrame:
    """The ledger with `kept` under a policy version."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0)


def ablations(book: DataFrame, version: str) -> DataFrame:
    """One row per rule of a policy: documents that fail it, that only it rejects, and that are kept without it; from counts of sets of failing rules."""
    whole = mask(version)
    rules = [r for r in RULES if r.name in POLICIES[version]]
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("m")).agg(F.count("*").alias("n"))  # a row for each set of failing rules
    among = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    bit, others = lambda r: F.lit(1 << r.bit), lambda r: F.lit(whole & ~(1 << r.bit))
    totals = masks.agg(
        *(among(F.col("m").bitwiseAND(bit(r)) != 0).alias(f"fail{r.bit}") for r in rules), *(among(F.col("m") == bit(r)).alias(f"only{r.bit}") for r in rules),
        *(among(F.col("m").bitwiseAND(others(r)) == 0).alias(f"without{r.bit}") for r in rules), among(F.col("m") == 0).alias("kept"),
    )
    row = lambda r: F.struct(F.lit(version).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"fail{r.bit}").alias("n_failed"), F.col(f"only{r.bit}").alias("n_only"), F.col(f"without{r.bit}").alias("kept_without"), F.col("kept").alias("kept_with"))
    return totals.select(F.explode(F.array(*map(row, rules))).alias("r")).select("r.*")


def judge(df: DataFrame, version: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed (policy v1) and kept (neither v1 nor the given version rejects)."""
    book = ledger(df, id_col, text_col)
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return apply_policy(book, version).withColumns({"base_failed": failed, "kept": ~failed & F.col("kept")})
