"""Quality rules: base rules and a hashed n-gram log-likelihood ratio against the raw corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import id_type, map_rows

#: Buckets of hashed word unigrams and bigrams (each half of them), a power of two.
BUCKETS = 1 << 17
#: Added to each bucket's count in both multinomials.
PRIOR = 1.0
#: Lowest mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.4
#: Most labelled documents that the trusted target is fitted on.
TARGET_ROWS = 20_000
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than blank and 0x09-0x0D."""
    return text.split() if text else []


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``size`` words that occur at least twice, all occurrences counted, overlaps once."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    width = 1
    while width < size:
        step = min(width, size - width)
        ranks = np.unique(ranks[: len(ranks) - step] * (len(words) + 1) + ranks[step:], return_inverse=True)[1]
        width += step
    twice = np.bincount(ranks)[ranks] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    edges[starts] += 1
    edges[starts + size] -= 1
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def base_figures(text: bytes | None, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0
    inner = text.translate(None, _SPACE)
    # A code point has one byte that does not continue another: count those.
    chars = len(inner.decode())
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dups = 0
    for line in text.split(b"\n"):
        if line in seen:
            dups += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return chars, symbols, dups, repeated_words(words)


def buckets_of(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all word unigrams (lower half) and bigrams (upper half)."""
    half = buckets // 2
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    pairs = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    mask = np.uint64(half - 1)
    return np.concatenate([mixed & mask, (pairs & mask) + np.uint64(half)]).astype(np.int64)


def ratio_table(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p_target - log p_raw of each bucket; unigrams and bigrams are multinomials of their own."""
    out = np.empty(len(raw))
    half = len(raw) // 2
    for part in (slice(0, half), slice(half, None)):
        t, r = target[part] + prior, raw[part] + prior
        out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def score(words: list[bytes], table: np.ndarray) -> float:
    """Mean log-likelihood ratio of a document's n-grams; 0 without words."""
    return float(table[buckets_of(words, len(table))].mean()) if words else 0.0


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, rows: int = TARGET_ROWS) -> np.ndarray:
    """Ratio table from all documents, with labelled good and non-toxic ones as the trusted target.

    The target is at most ``rows`` labelled ids, the first by CRC of the id; the raw counts cover every document. Each
    task sends one count per bucket that it met. Without labelled documents every ratio is 0.
    """
    ids = (
        labels.where("quality = 1 and coalesce(toxic, 0) = 0")
        .select(F.col("doc_id").alias("i"))
        .dropna()
        .distinct()
        .orderBy(F.crc32(F.col("i").cast("string").cast("binary")), "i")
        .limit(rows)
    )
    trusted = docs.sparkSession.sparkContext.broadcast(frozenset(r["i"] for r in ids.collect()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                every, good = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if words := split_words(text):
                        every.append(buckets_of(words, buckets))
                        if i in trusted.value:
                            good.append(every[-1])
                raw += np.bincount(np.concatenate(every), minlength=buckets)
                target += np.bincount(np.concatenate(good), minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["b", "r", "t"])

    parts = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, "b int, r long, t long")
    sums = parts.groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = sums["b"].to_numpy()
    raw[at], target[at] = sums["r"].to_numpy(), sums["t"].to_numpy()
    return ratio_table(raw, target) if target.any() else np.zeros(buckets)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: base figures, ``base_failed``, the ratio ``score``, ``kept``, and the columns ``carry``.

    A null or blank text has no words, fails the base rule and scores 0. Rows are judged one by one, so repeated rows
    and ties get equal verdicts; null ids are judged like others but never join the target. Carried columns are named ``carry_`` and their
    own name, so they can't clash with the others.
    """
    table = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def per_task():
        ratios = table.value

        def per_row(doc_id, text, *rest):
            words = split_words(text)
            chars, symbols, dups, repeats = base_figures(text, words)
            n = len(words)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            value = score(words, ratios)
            return doc_id, n, chars, symbols, dups, repeats, failed, value, not failed and value >= threshold, *rest

        return per_row

    schema = f"`{id_col}` {id_type(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    cols = docs.select(F.col(id_col), F.col(text_col).alias("body"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    schema += "".join(f", `carry_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_rows(cols, per_task, schema, binary=["body"])
