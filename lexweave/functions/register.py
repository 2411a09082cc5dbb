"""The library's text rules as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexweave.functions.text import SPACES, WS

_SPACES = "".join(f"\\u{ord(c):04x}" for c in SPACES)
_CLASS = WS.replace("\\", "\\\\")
#: name: (parameters and result, body). Bodies are Spark's own expressions, so the optimizer sees through them.
FUNCTIONS = {
    "lex_strip": ("(x STRING) RETURNS STRING", f"btrim(x, '{_SPACES}')"),
    "lex_normalize": ("(x STRING) RETURNS STRING", f"regexp_replace(lower(btrim(x, '{_SPACES}')), '[{_CLASS}]+', ' ')"),
    "lex_exact_hash": ("(x STRING) RETURNS STRING", "sha2(lex_normalize(x), 256)"),
    "lex_words": ("(x STRING) RETURNS ARRAY<STRING>", "if(lex_normalize(x) = '', array(), split(lex_normalize(x), ' '))"),
    "lex_jaccard": ("(x ARRAY<STRING>, y ARRAY<STRING>) RETURNS DOUBLE", "if(size(x) = 0 AND size(y) = 0, 1D, size(array_intersect(x, y)) / size(array_union(x, y)))"),
    "lex_perplexity": ("(loss DOUBLE) RETURNS DOUBLE", "exp(least(loss, 20D))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{kind} RETURN {body}")
    return list(FUNCTIONS)
