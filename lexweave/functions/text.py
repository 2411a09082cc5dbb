"""Text rules that hold for every Unicode character, as column functions.

White space is the 29 code points below, not what a regular-expression engine takes `\\s` for; letters are Unicode's.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: inside of a character class with all white space.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as an engine of RE2's syntax spells it.
WS_RE2 = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


#: The same 29 characters themselves.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Each run of white space one space. Characters are translated first, so that the pattern has one to look for."""
    return F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), " {2,}", " ")


def normalize(text: Column) -> Column:
    """Stripped, lower-cased, each run of white space one space."""
    return collapse(F.lower(strip(text)))


def words(text: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def literal_replacement(text: str) -> str:
    """A replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


#: Ranges of characters that the quick check of nfkc() knows, the largest ones; texts with others take the way through Python.
QUICK_RANGES = 64


@functools.cache
def unchanging() -> tuple[tuple[int, int], ...]:
    """Ranges of characters that compatibility composition leaves alone in any text of such characters: assigned, their own normal form, no combining class, and second in no composition."""
    decomposed = (d.split() for c in map(chr, range(sys.maxunicode + 1)) if (d := unicodedata.decomposition(c)) and d[0] != "<")
    second = {int(d[-1], 16) for d in decomposed if len(d) > 1}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals, which join the syllable before them
    found: list[list[int]] = []
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if unicodedata.category(c) in ("Cn", "Cs") or unicodedata.combining(c) or k in second or k in jamo or not unicodedata.is_normalized("NFKC", c):
            continue
        if found and found[-1][1] == k - 1:
            found[-1][1] = k
        else:
            found.append([k, k])
    return tuple((a, b) for a, b in found)


def may_change(text: Column) -> Column:
    """Whether a text holds a character that isn't known to stay as it is under nfkc(); native."""
    largest = sorted(unchanging(), key=lambda r: (r[0] > 0x24F, r[0] - r[1]))[:QUICK_RANGES]
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in sorted(largest))
    return text.rlike(f"[^{ranges}]")


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark has no such function, so texts that may change go through Python; the others, found by a native test, are not sent there."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield texts if texts.null_count == len(texts) else pa.array([s if s is None else unicodedata.normalize("NFKC", s) for s in texts.to_pylist()], pa.string())

    return F.coalesce(run(F.when(may_change(text), text)), text)


def shingles(tokens: Column, size: int) -> Column:
    """Distinct runs of `size` words joined by spaces; fewer words are one run, no words none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(F.size(tokens) >= size, F.array_distinct(runs)).when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))


def jaccard(x: Column, y: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(shared / (F.size(x) + F.size(y) - shared))
