"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import discard, id_type, map_rows, materialize

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text that one pass takes; a larger benchmark is searched in several passes. A search takes about
#: 200 times as much memory in each worker.
BLOCK_BYTES = 2_000_000

#: Byte table: A-Z lower-cased, every other byte outside 0-9, a-z and non-ASCII made a blank.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; null has none."""
    return text.translate(_FOLD).split() if text else []


class WordSearch:
    """Finds every occurrence of a set of word sequences of one length.

    A block is the last two words of the search window (one word for patterns of one word). The shift table holds, for
    each block that a pattern has, how far the window may move; any other block allows the largest shift. A shift of
    zero leads to a bucket of patterns with this suffix, split by first word, and these are compared word by word.
    """

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], int]):
        self.length = length
        self.block = min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], int]]]] = {}
        for words, number in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            suffix = self.buckets.setdefault(words[length - self.block :], {})
            suffix.setdefault(words[0], []).append((list(words), number))

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, pattern number) of all occurrences, in order of start."""
        found = []
        length, block, most, shift = self.length, self.block, self.most, self.shift
        end = length
        while end <= len(words):
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift.get(key, most)
            if step:
                end += step
                continue
            start = end - length
            for pattern, number in self.buckets[key].get(words[start], ()):
                if words[start:end] == pattern:
                    found.append((start, number))
            end += 1
        return found


def build_searches(items: list[tuple[object, bytes]], window: int = WINDOW) -> tuple[list[WordSearch], list[list[str]]]:
    """Searches by pattern length, and the item ids (as strings) of each pattern number."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item_id, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            ids = owners[tuple(words[i : i + size])]
            if item_id is not None:
                ids.add(str(item_id))
    by_length: dict[int, dict[tuple[bytes, ...], int]] = defaultdict(dict)
    ids_of = []
    for number, (words, ids) in enumerate(owners.items()):
        by_length[len(words)][words] = number
        ids_of.append(sorted(ids))
    return [WordSearch(n, p) for n, p in sorted(by_length.items())], ids_of


_built: dict[str, tuple[list[WordSearch], list[list[str]]]] = {}


def merge_spans(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans, flattened to start, end, start, end."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def _scan(df: DataFrame, items: list, window: int, more: bool, carry: list[str]) -> DataFrame:
    """One pass over the documents for one block of items; ``more`` keeps the text for the next pass."""
    shared = df.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def per_task():
        if key not in _built:
            _built.clear()
            _built[key] = build_searches(shared.value, window)
        searches, ids_of = _built[key]

        def per_row(doc_id, text, spans, ids, *rest):
            words = words_of(text)
            found = [(s, n, x.length) for x in searches for s, n in x.find(words)]
            if found:
                ids = sorted(set(ids).union(*(ids_of[n] for _, n, _ in found)))
                spans = merge_spans([(s, s + size) for s, _, size in found] + [*zip(spans[::2], spans[1::2], strict=True)])
            kept = text.decode() if more and text is not None else None
            return doc_id, kept, len(words), spans, ids, sum(spans[1::2]) - sum(spans[::2]), sha_of_ids(ids), *rest

        return per_row

    schema = f"id {id_type(df, 'id')}, text string, n_words long, spans array<int>, ids array<string>, n_hit long, sha string"
    schema += "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return map_rows(df.select("id", "text", "spans", "ids", *(F.col(f"`{c}`") for c in carry)), per_task, schema, binary=["text"])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, item_ids, and hit spans in words.

    A null or empty text has no words and hits nothing, an empty benchmark marks nothing. Items with equal ids count
    once; windows of an item whose id is null mark words but add no id. Every input row gives one row; of its other
    columns only those in ``carry`` are kept, named ``carry_`` and their own name. The benchmark is taken in blocks of about ``block_bytes``, so that a search table has a bounded size
    whatever the size of the benchmark.
    """
    sized = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // max(1, block_bytes)))
    out = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.array().cast("array<int>").alias("spans"),
        F.array().cast("array<string>").alias("ids"),
        *(F.col(c).alias(f"carry_{c}") for c in carry),
    )
    carried = [f"carry_{c}" for c in carry]
    before = None
    for b in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else sized
        out = _scan(out, [(r["i"], r["t"].encode()) for r in part.collect()], window, more=b + 1 < blocks, carry=carried)
        if b + 1 < blocks:
            out = materialize(out)
            if before is not None:
                discard(before)
            before = out
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.col("sha").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("ids").alias("item_ids"),
        F.col("spans").alias("hit_spans"),
        *(F.col(f"`{c}`") for c in carried),
    )


def sha_of_ids(ids: list[str]) -> str:
    """Lowercase hex SHA-256 of ids sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
