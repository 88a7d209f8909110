"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import global_positions, id_type, map_rows, materialize

CAPACITY = 1024
#: Id that closes each document.
END_ID = 2
#: Most entries of a task's table of known chunks; it is emptied when full.
CHUNKS = 200_000

#: A blank that a word follows always starts a token, so a text can be cut before it.
_CUT = re.compile(r" (?=\S)")
#: Blanks that do not: before other white space and at the end.
_ODD = re.compile(r" (?:\s|\Z)")


class ChunkEncoder:
    """Byte-level BPE ids as packed unsigned 32-bit numbers, with a table of chunks between blanks.

    The JSON file gives vocabulary, merges and added tokens; the ids equal those that ``tokenizers`` gives for it. The
    string of an added token in a text is that token, and what stands between such strings is encoded by itself.
    """

    def __init__(self, path: str, chunks: int = CHUNKS):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t[k] for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take blanks or whole words only are not supported")
        self._added = {t: array("I", [n]).tobytes() for t, n in added.items()}
        self._parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # Byte-level vocabularies write each byte as a printable character: the printable Latin-1 bytes as
        # themselves, the others as the characters from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}
        self._most = chunks

    def _packed(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if self._parts is None or not self._parts.search(text):
            return self._plain(text)
        return b"".join(self._added.get(x) or self._plain(x) for x in self._parts.split(text) if x)

    def _plain(self, text: str) -> bytes:
        chunks = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        first, known = self._packed(chunks[0]), self._known
        rest = chunks[1:]
        try:
            return first + b"".join([known[c] for c in rest])
        except KeyError:
            pass
        if len(known) > self._most:
            known.clear()
        for c in rest:
            if c not in known:
                known[c] = self._packed(" " + c)
        return first + b"".join([known[c] for c in rest])


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and with ``keep_ids`` the packed ids.

    A null text is an empty one: a single piece with the end id.
    """
    end = array("I", [END_ID]).tobytes()

    def per_task():
        encode = ChunkEncoder(path)

        def per_row(doc_id, text):
            ids = (encode(text) if text else b"") + end
            parts = []
            for n, (start, size) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + size)]
                parts.append((n, start, size, zlib.crc32(own), own if keep_ids else None))
            return doc_id, parts

        return per_row

    schema = f"`{id_col}` {id_type(docs, id_col)}, p array<struct<piece:int,start:long,length:long,ids_crc32:long,ids:binary>>"
    out = map_rows(docs.select(F.col(id_col), F.col(text_col).alias("body")), per_task, schema)
    pieces = out.select(id_col, F.explode("p").alias("p")).select(id_col, "p.*")
    return pieces if keep_ids else pieces.drop("ids")


def fullest(counts: list[int], size: int) -> list[int]:
    """Lengths, each at most as often as ``counts`` has it, whose sum is the largest not over ``size``.

    Subset sums are the bits of an integer; one shift and OR adds a group of equal lengths. The sums after each group
    are kept to read the choice back, longest lengths first.
    """
    mask = (1 << (size + 1)) - 1
    sums, states = 1, []
    for length in range(min(size, len(counts) - 1), 0, -1):
        left = min(counts[length], size // length)
        group = 1
        while left:
            take = min(group, left)
            grown = (sums | sums << (take * length)) & mask
            if grown != sums:
                states.append((sums, take * length, length, take))
                sums = grown
            left -= take
            group *= 2
        if sums >> size & 1:
            break
    at, chosen = sums.bit_length() - 1, []
    for before, shift, length, take in reversed(states):
        if not before >> at & 1:
            at -= shift
            chosen += [length] * take
    return chosen


def plan_bins(counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each) for all pieces counted by length.

    A bin takes the longest length left and the fullest combination for the rest; it is repeated as long as the counts
    allow, so the plan has few entries whatever the number of pieces.
    """
    counts = list(counts)
    plan = []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return plan
        counts[longest] -= 1
        lengths = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        need = Counter(lengths)
        times = min(counts[n] // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * times
        plan.append((times, lengths))


def place(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    Only the histogram of lengths reaches the driver (at most ``capacity`` numbers). Pieces of one length are ranked
    in the order of id, piece and digest, through a global order of all pieces, and take the plan's places by rank.
    """
    spark = pieces.sparkSession
    counts = [0] * (capacity + 1)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    segments, next_bin = [], 0
    used = [0] * (capacity + 1)
    for times, lengths in plan_bins(counts, capacity):
        at = 0
        for length, k in Counter(lengths).items():
            segments.append((length, used[length], k, next_bin, at))
            used[length] += times * k
            at += length * k
        next_bin += times
    table = spark.sparkContext.broadcast(np.array(sorted(segments), np.int64).reshape(-1, 5))
    before = np.concatenate([[0], np.cumsum(counts)])
    firsts = spark.sparkContext.broadcast(before)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, pos: pd.Series) -> pd.DataFrame:
        size, t = length.to_numpy(), table.value
        rank = pos.to_numpy() - firsts.value[size]
        keys = t[:, 0] << 44 | t[:, 1]
        row = t[np.searchsorted(keys, size << 44 | rank, side="right") - 1]
        own = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + own // row[:, 2], "offset": row[:, 4] + own % row[:, 2] * size})

    placed, _ = global_positions(pieces, ["length", id_col, "piece", "start", "ids_crc32"])
    return placed.withColumn("slot", slot("length", "pos")).select(*pieces.columns, "slot.sequence_id", "slot.offset")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece, no text.

    Repeated rows are packed once each. An empty table gives no rows.
    """
    return place(materialize(tokenize(docs, path, id_col, text_col, capacity)), id_col, capacity)


__all__ = ["ChunkEncoder", "cut", "fullest", "pack", "place", "plan_bins", "tokenize"]
