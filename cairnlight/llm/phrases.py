"""Phrase collocation mining: frequent phrases whose words occur together more often than apart.

A shard is some millions of words of one task. Its generalised suffix automaton, bounded in depth, has for each distinct
substring of the pieces its number of end positions and a suffix link to the substring without its first word. Shards
enumerate their substrings, and counts are reduced globally: words and pairs first, then phrases of three words of which
both pairs are frequent. Links give the shorter phrases that a longer one subsumes.

Null texts have no words, a null language is ``und``. Repeated rows count as often as they occur. Ties in score go to
the more frequent phrase, then to the smaller one in UTF-8 order. Very long texts are read in slices cut at the end of
pieces. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.llm.common import LOWER, UPPER, materialize, slices

MIN_COUNT = 10
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
SUBSUMED_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
#: Words of a shard's automaton.
SHARD_WORDS = 1 << 20
#: Bits of the filter of frequent pairs, which every task gets: 8 MB at any size of the corpus.
FILTER_BITS = 1 << 26

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECES = bytes.maketrans(UPPER.encode() + _ENDS + b"\t", LOWER.encode() + b"." * len(_ENDS) + b" ")
_SCHEMA = "lang string, k int, phrase string, n long"


@dataclass
class Level:
    """Distinct substrings of one length: the longest proper prefix and suffix (both one level up), the last word, and
    the number of end positions."""

    head: np.ndarray
    last: np.ndarray
    link: np.ndarray
    count: np.ndarray


def suffix_automaton(words: np.ndarray, depth: int, keep: Callable[[Level], np.ndarray] | None = None) -> list[Level]:
    """Depth-bounded generalised suffix automaton of pieces.

    ``words`` has numbers from 0, and -1 after each piece. Substrings that ``keep`` rejects (and so all longer ones around
    them) are left out; it sees levels from the second to the last but one. Levels are built in one go for all positions:
    a substring's transition leads from its head by its last word, its link to the substring that ends in the same places
    without the first word.
    """
    size = int(words.max(initial=-1)) + 1
    at = words.astype(np.int64)
    none = np.empty(0, np.int64)
    levels = [Level(none, np.arange(size), none, np.bincount(at[at >= 0], minlength=size))]
    for d in range(2, depth + 1):
        ends = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)) + 1
        codes, number, count = np.unique(at[ends - 1] * size + words[ends], return_inverse=True, return_counts=True)
        link = np.zeros(len(codes), np.int64)
        link[number] = at[ends]
        level = Level(codes // size, codes % size, link, count)
        if keep is not None and d < depth:
            kept = keep(level)
            number = np.where(kept, np.cumsum(kept) - 1, -1)[number]
            level = Level(*(x[kept] for x in (level.head, level.last, level.link, level.count)))
        at = np.full(len(words), -1, np.int64)
        at[ends] = number
        levels.append(level)
    return levels


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Shard:
    """Words of one language that a task has read, as numbers."""

    def __init__(self) -> None:
        self.numbers = _Numbers({b".": -1})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        for part in slices((text or "").encode().translate(_PIECES), b"."):
            words = (part.replace(b".", b" . ") + b" .").split()
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def words(self) -> tuple[np.ndarray, list[bytes]]:
        """Numbers from 0, -1 after pieces, and the words."""
        found = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        # The mark of ends is the first key, so words are numbered from 1.
        return np.where(found > 0, found - 1, -1), [w for w in self.numbers if w != b"."]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    shards: dict[str, _Shard] = {}
    for part in (b.slice(start, 256) for b in batches for start in range(0, b.num_rows, 256)):
        for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            shards.setdefault(lang, _Shard()).add(text)
            if sum(s.size for s in shards.values()) >= SHARD_WORDS:
                yield from ((k, *s.words()) for k, s in shards.items())
                shards = {}
    yield from ((k, *s.words()) for k, s in shards.items())


def _rows(lang: str, k: int, phrases: pa.Array, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(count)
    names = ["lang", "k", "phrase", "n"]
    whole = pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.repeat(pa.scalar(k, pa.int32()), n), phrases.cast(pa.string()), pa.array(count, pa.int64())], names=names)
    for start in range(0, n, 1 << 16):
        yield whole.slice(start, 1 << 16)


def _joined(words: pa.Array, *parts: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(p)) for p in parts), b" ")


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs; the phrase without words counts all words of a language."""
    for lang, numbers, words in _shards(batches):
        one, two = suffix_automaton(numbers, 2)
        names = pa.array(words, pa.binary())
        yield from _rows(lang, 0, pa.array([b""], pa.binary()), one.count.sum(keepdims=True))
        yield from _rows(lang, 1, names, one.count)
        yield from _rows(lang, 2, _joined(names, two.head, two.last), two.count)


def _place(lang, first, second):  # noqa: ANN001, ANN202  for columns as for arrays
    """Bit of a pair in the filter, from CRCs; stays within 64 bits."""
    return (lang * 31 + first * 1_000_003 + second) % FILTER_BITS


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """Bits of all frequent pairs, FILTER_BITS / 8 bytes: a pair outside is not frequent."""
    crc = lambda c: F.crc32(c.cast("binary"))
    first, second = (F.substring_index("phrase", " ", k) for k in (1, -1))
    bit = _place(crc(F.col("lang")), crc(first), crc(second)) + 1
    packed = pairs.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in packed.toLocalIterator():
        start = (row["b"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _long(bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Counts of phrases of three words of which both pairs pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, words in _shards(batches):
            crcs = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            own = zlib.crc32(lang.encode())

            def frequent(level: Level, own: int = own, crcs: np.ndarray = crcs) -> np.ndarray:
                place = _place(own, crcs[level.head], crcs[level.last])
                return (bits.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0

            _, two, three = suffix_automaton(numbers, 3, frequent)
            names = pa.array(words, pa.binary())
            yield from _rows(lang, 3, _joined(names, two.head[three.head], two.last[three.head], three.last), three.count)

    return run


def _reduced(docs: DataFrame, count: Callable, least: int) -> DataFrame:
    rows = docs.mapInArrow(count, _SCHEMA).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return materialize(rows.where((F.col("n") >= least) | (F.col("k") == 0)))


def _after(c: Column | str) -> Column:
    """A phrase without its first word: where its suffix link leads."""
    return F.substr(c, F.instr(c, " ") + 1)


def mine(docs: DataFrame, min_count: int = MIN_COUNT, subsumed_percent: int = SUBSUMED_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    The texts are read twice. Pairs of a shard shuffle once, with map-side sums; of longer phrases only those whose pairs
    pass a filter of fixed size, built from all frequent pairs, so the exact counts after it lose nothing. What follows
    works on phrases with at least ``min_count`` occurrences.
    """
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    short = _reduced(named, _short, min_count)
    pairs = short.where("k = 2")
    bits = docs.sparkSession.sparkContext.broadcast(pair_filter(pairs))
    triples = _reduced(named, _long(bits), min_count)
    phrases = pairs.unionByName(triples).select("lang", "phrase", F.col("n").alias("a"))

    first = F.substring_index("phrase", " ", 1)
    last = F.substring_index("phrase", " ", -1)
    two = F.substring_index("phrase", " ", 2)
    one_cut = F.struct(F.lit(1).alias("cut"), first.alias("left"), _after("phrase").alias("right"))
    two_cut = F.struct(F.lit(2).alias("cut"), two.alias("left"), last.alias("right"))
    cuts = phrases.select("*", F.inline(F.when(two == F.col("phrase"), F.array(one_cut)).otherwise(F.array(one_cut, two_cut))))
    parts = short.where("k > 0").select("lang", "phrase", "n")
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))

    inner = F.explode(F.array(two, _after("phrase")))
    around = triples.select("lang", inner.alias("phrase"), F.col("n").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < subsumed_percent * F.col("a"), F.lit(True)))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    totals = short.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
