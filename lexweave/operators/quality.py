"""Quality filter: six checks over a text's measurements, all failing ones reported in order."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.once import once
from lexweave.functions.text import SPACES, lines, strip


METRICS = ("n_chars", "n_words", "symbol_ratio", "alpha_ratio", "repetition")


@dataclass(frozen=True)
class QualityOptions:
    min_chars: int = 50
    max_chars: int | None = 200_000
    min_words: int = 10
    max_symbol_ratio: float = 0.3
    min_alpha_ratio: float = 0.5
    max_repetition_ratio: float = 0.5

    def __post_init__(self):
        if self.min_chars < 0 or self.min_words < 0:
            raise ValueError("least counts must not be negative")
        if self.max_chars is not None and self.max_chars < self.min_chars:
            raise ValueError("max_chars must be at least min_chars")
        for name in ("max_symbol_ratio", "min_alpha_ratio", "max_repetition_ratio"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")


def measured(text: Column) -> Column:
    """A struct of the measurements; the ratios are null where a text has no such characters or lines.

    What several of them need is made once, as the variable of a lambda: the text without white space, that without letters, and the lines that aren't blank. Words are counted by the
    single spaces between them, not as a list, and no pattern matches once a word: that costs several microseconds a match.
    """
    kept = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    made = F.struct(F.translate(text, SPACES, "").alias("dense"), kept.alias("kept"))

    def of(p: Column, rest: Column) -> Column:
        dense = F.length(p["dense"])
        spaced = F.btrim(F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), " {2,}", " "))
        return F.struct(
            F.length(text).alias("n_chars"),
            F.when(dense > 0, F.length(spaced) - dense + 1).when(dense == 0, 0).alias("n_words"),
            F.when(dense > 0, F.length(F.translate(rest, "0123456789", "")) / dense).alias("symbol_ratio"),
            F.when(dense > 0, (dense - F.length(rest)) / dense).alias("alpha_ratio"),
            F.when(F.size(p["kept"]) > 0, F.lit(1.0) - F.size(F.array_distinct(p["kept"])) / F.size(p["kept"])).alias("repetition"),
        )

    nested = F.transform(F.array(made), lambda p: F.transform(F.array(F.regexp_replace(p["dense"], r"\p{L}+", "")), lambda rest: of(p, rest)))
    return F.get(F.get(nested, F.lit(0)), F.lit(0))


def metrics(text: Column) -> dict[str, Column]:
    """The measurements as columns of their own; with_metrics() evaluates them all at once."""
    return {name: measured(text)[name] for name in METRICS}


def with_metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the measurements, evaluated once."""
    if text_col not in df.columns:
        raise KeyError(text_col)
    found = once(df, {"_measured": measured(F.col(text_col))})
    return found.select(*(F.col(f"_measured.{c}").alias(c) if c in METRICS else F.col(c) for c in dict.fromkeys([*df.columns, *METRICS])))


def checks(o: QualityOptions = QualityOptions()) -> dict[str, Column]:
    """What fails each check, over the measurements; a check that doesn't apply is null."""
    c = F.col
    return {
        "too_short": c("n_chars") < o.min_chars,
        "too_long": F.lit(False) if o.max_chars is None else c("n_chars") > o.max_chars,
        "too_few_words": c("n_words") < o.min_words,
        "too_many_symbols": c("symbol_ratio") > o.max_symbol_ratio,
        "too_few_alpha_chars": c("alpha_ratio") < o.min_alpha_ratio,
        "too_repetitive": c("repetition") > o.max_repetition_ratio,
    }


def verdict(df: DataFrame, o: QualityOptions = QualityOptions(), text_col: str = "text") -> DataFrame:
    """df with the measurements, `reasons` (codes of the failing checks, in order) and `passed`. Null texts count as empty."""
    filled = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    out = with_metrics(filled, text_col)
    reasons = F.array_compact(F.array(*(F.when(failed, F.lit(name)) for name, failed in checks(o).items())))
    return out.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def route(df: DataFrame, o: QualityOptions = QualityOptions(), text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept rows as they were, rejected rows with `_reject_reasons`)."""
    judged = verdict(df, o, text_col)
    return judged.where("passed").select(*df.columns), judged.where("NOT passed").select(*df.columns, F.col("reasons").alias("_reject_reasons"))


def messages(judged: DataFrame, o: QualityOptions = QualityOptions()) -> DataFrame:
    """judged (of verdict) with `messages`: each reason with the measured value and the limit."""

    @F.pandas_udf("array<string>")
    def run(reasons: pd.Series, chars: pd.Series, words: pd.Series, symbols: pd.Series, alpha: pd.Series, again: pd.Series) -> pd.Series:
        out = []
        for rs, n, w, s, a, r in zip(reasons, chars, words, symbols, alpha, again, strict=True):
            said = {
                "too_short": f"{n} < {o.min_chars}", "too_long": f"{n} > {o.max_chars}", "too_few_words": f"{w} < {o.min_words}", "too_many_symbols": f"{s:.2f} > {o.max_symbol_ratio}",
                "too_few_alpha_chars": f"{a:.2f} < {o.min_alpha_ratio}", "too_repetitive": f"{r:.2f} > {o.max_repetition_ratio}",
            }
            out.append([f"{x} ({said[x]})" for x in rs])
        return pd.Series(out)

    return judged.withColumn("messages", run("reasons", "n_chars", "n_words", "symbol_ratio", "alpha_ratio", "repetition"))
