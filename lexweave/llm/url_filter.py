"""URL filters: rules by host and path, and for the rest a classifier over the words that names are made of.

Names are runs of letters of any script in the host and the path, in lower case. Unigram Viterbi splits each distinct name into the most
likely words, by the counts of all words of the corpus: every stretch of up to LONGEST letters of a name meets its count by a join, so the
model may be of any size and no task holds it. LONGEST is part of the model: it knows no longer words. Multinomial naive Bayes, trained on
labelled urls, scores the words; a url's log odds are the prior's and those of its names.

Names and stretches that very many rows have are looked up by a broadcast of bounded size, the others by a shuffle.

A null url, or one without "://", has an empty host and path; no rule fits it, and the prior alone decides. Urls that a rule decides
have no score. Repeated rows are judged alike, ids may be null or repeat, urls of any length are read whole (a name's distinct known
stretches are held in one row), an empty corpus or page table is fine. Other columns than the id and the url are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, checkpoint, lookup, quoted, require

#: (verdict, host, path): a rule fits its host and all subdomains, if the url's path starts with the rule's.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Letters of the unigram model's longest words.
LONGEST = 24
#: How often the words of labelled urls count as met, at least.
MET = 5
#: Labelled urls from which the classifier is trained unless others are given; hyphens part their words, which are not split further. Invented for this library.
BLOCKED = """
https://cheap-meds.example/buy-pills https://pill-store.example/order-cheap-pills https://casino-bonus.example/win-money https://free-money.example/claim-now https://spam-hub.example/link-farm
https://link-farm.example/spam-links https://poker-winner.example/bet-money https://cheap-loans.example/apply-now https://buy-meds.example/cheap-pills https://hot-casino.example/slots-bonus
https://get-rich-quick.example/free-cash https://lucky-prize.example/claim-bonus https://cheap-replica.example/buy-replica https://spam-offers.example/hot-deal https://farm-links.example/spam-hub
https://pills-online.example/cheap-meds https://adult-cams.example/live-adult https://hot-videos.example/adult-live https://click-bait.example/win-prize https://free-casino.example/slots-win
https://ads-server.example/track-click https://track-ads.example/click-banner https://banner-ads.example/click-track https://adult-videos.example/hot-cams https://win-cash.example/lucky-slots
https://replica-store.example/cheap-deal https://bet-bonus.example/poker-casino https://quick-loans.example/cash-now https://click-farm.example/ads-track https://prize-claim.example/free-win
"""
ALLOWED = """
https://daily-news.example/world-news https://city-history.example/archive-history https://open-library.example/books-archive https://science-journal.example/article-science https://bread-recipes.example/home-recipes
https://weather-today.example/local-weather https://university-course.example/science-course https://art-museum.example/history-art https://software-docs.example/guide-docs https://health-advice.example/guide-health
https://travel-blog.example/city-guide https://www.example/about https://m.example/page https://garden-roses.example/home-garden https://music-school.example/music-lessons
https://local-sports.example/sports-results https://parliament-debates.example/news-archive https://math-forum.example/question-help https://bird-watch.example/bird-guide https://open-wiki.example/index
https://town-hall.example/local-news https://home-work.example/help-lessons https://railway-travel.example/city-guide https://star-science.example/weather-world https://poetry-books.example/library-archive
https://blog.example/article https://school-lessons.example/math-course https://world-history.example/museum-guide https://museum-library.example/open-books https://health-journal.example/advice-article
"""
_LETTERS = r"\p{L}+"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case. Path: from there up to "?", "#" or the end."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """w, n: how often each word of up to LONGEST letters stands outside tags, over all rows; combined before the shuffle, from a checkpoint."""
    plain = F.lower(F.regexp_replace(F.coalesce(quoted(column), F.lit("")), "<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("w")).where(F.length("w").between(1, LONGEST))
    return checkpoint(words.groupBy("w").agg(F.count("*").alias("n")))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words of a name under a unigram model of `total` words; an unknown stretch costs more with each letter."""
    best, last = [0.0], [0]
    whole = math.log(total or 1)
    for end in range(1, len(name) + 1):
        cost, start = min((best[s] + (whole - math.log(n) if (n := counts.get(name[s:end])) else whole + math.log(10) * (end - s)), s) for s in range(max(0, end - LONGEST), end))
        best.append(cost), last.append(start)
    words, end = [], len(name)
    while end:
        words.append(name[last[end] : end])
        end = last[end]
    return words[::-1]


def segment(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """name, words of each row of names (name, distinct), from a checkpoint."""
    bound_batches(names.sparkSession)
    ahead = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")).where("name <> ''").select("name", F.substring("name", F.col("at"), F.lit(LONGEST)).alias("ahead"))
    pieces = ahead.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("ahead")), lambda k: F.substring("ahead", F.lit(1), k))).alias("w"))
    met = lookup(checkpoint(pieces.distinct()), "w", counts).groupBy("name").agg(F.collect_list(F.struct("w", "n")).alias("met"))

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for name, met in batches:
            yield pa.array([viterbi(x, {m["w"]: m["n"] for m in known or ()}, total) for x, known in zip(name.to_pylist(), met.to_pylist(), strict=True)], pa.list_(pa.string()))

    return checkpoint(names.join(met, "name", "left").select("name", split("name", "met").alias("words")))


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing. Words of no labelled url carry no evidence."""

    def __init__(self, labelled: Iterable[tuple[list[str], bool]]):
        count, rows = (Counter(), Counter()), [0, 0]
        for words, blocked in labelled:
            count[blocked].update(words)
            rows[blocked] += 1
        vocabulary = set(count[0]) | set(count[1])
        size = [sum(c.values()) + len(vocabulary) for c in count]
        self.prior = math.log((rows[1] + 1) / (rows[0] + 1))
        self.weight = {w: math.log((count[1][w] + 1) / size[1]) - math.log((count[0][w] + 1) / size[0]) for w in vocabulary}

    def score(self, words: Iterable[str]) -> float:
        """Log odds of block."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)


def names_of(host: Column, path: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", host, path)), F.lit(_LETTERS), F.lit(0))


def default_labels() -> list[tuple[str, bool]]:
    return [(u, True) for u in BLOCKED.split()] + [(u, False) for u in ALLOWED.split()]


def train(counts: DataFrame, labelled: Iterable[tuple[str, bool]] | None = None) -> tuple[DataFrame, int, NaiveBayes]:
    """(counts with the labelled urls' words, their sum, the classifier). The labelled urls, a parameter, are held on the driver; their words are taken as they are parted."""
    spark = counts.sparkSession
    rows = spark.createDataFrame([(u, bool(b), k) for k, (u, b) in enumerate(default_labels() if labelled is None else labelled)], "url string, blocked boolean, k long")
    rows = rows.select("k", "blocked", F.explode_outer(names_of(*host_path(F.col("url")))).alias("name"))
    known = rows.select(F.col("name").alias("w"), F.lit(MET).cast("long").alias("n")).where(F.length("w").between(1, LONGEST)).distinct()
    counts = checkpoint(counts.unionByName(known).groupBy("w").agg(F.max("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    urls: dict[int, tuple[list[str], bool]] = {}
    for r in rows.orderBy("k").collect():
        urls.setdefault(r.k, ([], r.blocked))[0].extend([r.name] if r.name else [])
    return counts, total, NaiveBayes(urls.values())


def judge(df: DataFrame, counts: DataFrame, labelled: Iterable[tuple[str, bool]] | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule (null if none fits), score (log odds of block, without a rule), verdict of each row. counts: of word_counts()."""
    require(df, id_col, url_col)
    counts, total, bayes = train(counts, labelled)
    host, path = host_path(quoted(url_col))
    pages = df.select(quoted(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    pages = checkpoint(pages.withColumn("row", F.monotonically_increasing_id()))
    parts = checkpoint(pages.where("fits IS NULL").select("row", F.explode(names_of(F.col("host"), F.col("path"))).alias("name")))
    weight = F.create_map(*(F.lit(x) for pair in sorted(bayes.weight.items()) for x in pair)) if bayes.weight else F.create_map().cast("map<string,double>")
    words = segment(parts.select("name").distinct(), counts, total)
    weighed = words.select("name", F.aggregate("words", F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(weight, w), F.lit(0.0))).alias("x"))
    sums = lookup(parts, "name", weighed.where("x <> 0")).groupBy("row").agg(F.sum("x").alias("x"))
    out = pages.join(sums, "row", "left").withColumn("score", F.when(F.col("fits").isNull(), F.round(F.coalesce("x", F.lit(0.0)) + bayes.prior, 9)))
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fits.rule").alias("rule"), "score", verdict.alias("verdict"))
