"""URL filters: rules, then naive Bayes over host words found by unigram Viterbi and over path tokens."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import ascii_lower, materialize

#: Longest word that a host label is cut into.
LONGEST = 24
#: Letters of a label whose substrings are taken at a time.
CHUNK = 256
#: Buckets of hashed tokens for each class.
BUCKETS = 1 << 16
#: Added to each bucket's count.
PRIOR = 0.5
VERDICTS = ("allow", "block")

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.

    A rule is a host and the start of a path; it fits the host and its subdomains.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, prefix = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable words of a label; an unknown word of n letters has 10 / (total x 10**n)."""
    base = math.log(max(total, 1))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(label[start:end])
            own = math.log(n) - base if n else math.log(10) * (1 - (end - start)) - base
            options.append((best[start][0] + own, -(end - start)))
        value, size = max(options)
        best.append((value, -size))
    out, end = [], len(label)
    while end:
        size = best[end][1]
        out.append(label[end - size : end])
        end -= size
    return out[::-1]


def page_words(html: Column) -> Column:
    """Lower-case letter runs of a page without its tags."""
    return F.split(F.lower(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"[^\p{L}]+")


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, host_words) for distinct ``hosts``, given counts (word, n) of a corpus.

    Labels are what lies between characters that are neither letters nor digits. Each distinct label sends its substrings
    of up to ``LONGEST`` letters, at most ``LONGEST`` for each letter, to a join with the counts. They carry the label's
    digest only, and are taken from chunks of ``CHUNK`` letters, so time and rows grow with the length of a label, however
    long it is.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("k", "label")).where("label <> ''")
    labels = parts.select("label").distinct().withColumn("key", F.unhex(F.sha2("label", 256)))
    starts = F.sequence(F.lit(0), F.floor((F.length("label") - 1) / CHUNK).cast("int"))
    chunks = labels.select("key", F.explode(F.transform(starts, lambda i: F.substring(F.col("label"), i * CHUNK + 1, CHUNK + LONGEST - 1))).alias("chunk"))
    sizes = F.sequence(F.lit(1), F.lit(LONGEST))
    pieces = F.transform(F.sequence(F.lit(1), F.least(F.length("chunk"), F.lit(CHUNK))), lambda i: F.transform(sizes, lambda n: F.substring(F.col("chunk"), i, n)))
    substrings = chunks.select("key", F.explode(F.array_distinct(F.flatten(pieces))).alias("word"))
    known = substrings.join(words, "word").groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def cut(label: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(
            [segment(x, {r["word"]: r["n"] for r in k} if k is not None else {}, total) for x, k in zip(label, known, strict=True)]
        )

    cuts = labels.join(known, "key", "left").select("label", cut("label", "known").alias("words"))
    rows = parts.join(cuts, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "words"))).alias("a"))
    return rows.select("host", F.flatten(F.transform("a", lambda x: x["words"])).alias("host_words"))


def tokens_of(host_words, path: str) -> list[str]:
    """Features of a URL: words of the host, words of the path, and each number as its length."""
    own = [f"h:{w}" for w in host_words] if host_words is not None else []
    return own + [f"p:#{len(t)}" if t.isdigit() else f"p:{t}" for t in _TOKEN.findall(path.lower())]


def buckets_of(host_words, path: str) -> list[int]:
    return [zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in tokens_of(host_words, path)]


def fit(urls: DataFrame) -> np.ndarray:
    """Weights of block against allow from all rows with a rule's verdict.

    Both classes weigh the same: how many URLs the rules happen to decide each way says nothing about the others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for words, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums[VERDICTS.index(verdict)]
                np.add.at(own, buckets_of(words, path), 1)
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["b", "a", "k"])

    parts = urls.where("verdict is not null").select("host_words", "path", "verdict").mapInArrow(count, "b int, a long, k long")
    sums = np.zeros((2, BUCKETS))
    for r in parts.groupBy("b").agg(F.sum("a").alias("a"), F.sum("k").alias("k")).toArrow().to_pylist():
        sums[:, r["b"]] = r["a"], r["k"]
    p = sums + PRIOR
    p /= p.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
) -> DataFrame:
    """Per page: host, path, rule, verdict, host_words and ``log_odds`` of block.

    Word counts come from all pages. Rows that a rule decides train the classifier and keep the rule's verdict. A URL
    without tokens (null, or no ``://`` and so no host) is allowed with odds 0, a tie is allowed, and without any
    decided rows the odds are 0. Null pages add no words. Equal rows get equal verdicts. Very long hosts and paths are
    judged whole; other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    words = materialize(
        pages.select(F.explode(page_words(F.col(text_col))).alias("word"))
        .where(F.length("word").between(1, LONGEST))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    cuts = host_words(urls.select("host").where("host <> ''").distinct(), words)
    ready = materialize(urls.join(cuts, "host", "left").withColumns({"rule": rule, "verdict": verdict}))
    weights = spark.sparkContext.broadcast(fit(ready))

    @F.pandas_udf("double")
    def odds(host_words: pd.Series, path: pd.Series) -> pd.Series:
        w = weights.value
        found = (buckets_of(h, p) for h, p in zip(host_words, path, strict=True))
        return pd.Series([float(w[b].sum()) if b else 0.0 for b in found])

    out = ready.withColumn("log_odds", odds("host_words", "path"))
    said = F.coalesce(F.col("verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", said.alias("verdict"), "host_words", "log_odds")
