"""Cleaning: a fixed order of rewriting steps, assembled from options into one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.once import once
from lexweave.functions.text import WS, lines, literal_replacement, nfkc, strip


@dataclass(frozen=True)
class CleanOptions:
    strip_html: bool = True
    unicode_nfkc: bool = True
    url_replacement: str | None = None
    strip_control: bool = True
    collapse_whitespace: bool = True
    min_line_length: int = 0
    strip_ends: bool = True

    def __post_init__(self):
        if self.min_line_length < 0:
            raise ValueError("min_line_length must not be negative")


def clean_text(text: Column, o: CleanOptions = CleanOptions()) -> Column:
    """Tags to spaces, NFKC, URLs, control characters (line feed and tab stay), short lines, spaces and blank lines, ends; in this order."""
    if o.strip_html:
        text = F.regexp_replace(text, "<[^>]+>", " ")
    if o.unicode_nfkc:
        text = nfkc(text)
    if o.url_replacement is not None:
        text = F.regexp_replace(text, rf"https?://[^{WS}]+|www\.[^{WS}]+", literal_replacement(o.url_replacement))
    if o.strip_control:
        text = F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")
    if o.min_line_length:
        size = lambda x: F.length(strip(x))
        text = F.array_join(F.filter(lines(text), lambda x: (size(x) == 0) | (size(x) >= o.min_line_length)), "\n")
    if o.collapse_whitespace:
        text = F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n")
        text = F.array_join(F.transform(lines(text), strip), "\n")
    return strip(text) if o.strip_ends else text


def clean(df: DataFrame, o: CleanOptions = CleanOptions(), text_col: str = "text") -> DataFrame:
    """Texts cleaned; rows whose text is null or ends empty are dropped, other columns stay."""
    if text_col not in df.columns:
        raise KeyError(text_col)
    return once(df, {text_col: clean_text(F.col(text_col), o)}).where(F.col(text_col) != "")
