"""Banded edit distance of word sequences, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import discard, materialize


def banded_distance(a: Sequence, b: Sequence, limit: int) -> int | None:
    """Edit distance (insert, delete, replace) if it is at most ``limit``, else None.

    Equal ends are cut off first. Then one column of the band, 2 x limit + 1 rows about the diagonal, is held as bits of
    two integers (where a cell is one above or one below its lower neighbour), and each column takes a few operations.
    """
    first, last_a, last_b = 0, len(a), len(b)
    while first < last_a and first < last_b and a[first] == b[first]:
        first += 1
    while last_a > first and last_b > first and a[last_a - 1] == b[last_b - 1]:
        last_a -= 1
        last_b -= 1
    rows, cols = a[first:last_a], b[first:last_b]
    slope = len(cols) - len(rows)
    if abs(slope) > limit:
        return None
    if not rows or not cols:
        return abs(slope)
    limit = min(limit, max(len(rows), len(cols)))
    places: dict = {}
    for i, w in enumerate(rows):
        places[w] = places.get(w, 0) | 1 << i
    mask = (1 << (2 * limit + 1)) - 1
    top, watched = 1 << (2 * limit), 1 << (limit - slope)
    up, down = (mask >> (limit + 1)) << (limit + 1), 0
    distance = abs(slope)
    for j, w in enumerate(cols, 1):
        up, down = up >> 1 | top, down >> 1
        shift = j - limit - 1
        same = places.get(w, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & mask
        level = (((same & up) + up) ^ up | same | down) & mask
        right_up = down | mask & ~(level | up)
        right_down = (level & up) << 1
        right_up = right_up << 1 | 1
        up = (right_down | ~(level | right_up)) & mask
        down = level & right_up & mask
        if j > slope and not level & watched:
            distance += 1
            if distance > limit:
                return None
    return distance


def similarity_at_least(a: Sequence, b: Sequence, least: float) -> float | None:
    """1 - distance / longer length if that reaches ``least``, else None; two empty sequences are equal."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    distance = banded_distance(a, b, int(longer * (1 - least) + 1e-9))
    return None if distance is None else 1 - distance / longer


#: Most edges whose components one task finds; more go through rounds of joins.
TASK_EDGES = 200_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], names=["node", "comp"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, comp) for all nodes of a written table of ``edges`` (u, v): the smallest node that it is connected with.

    Up to ``task_edges`` edges are united in one task. More take rounds: each node takes the smallest label among its
    neighbours, then the label of that label, until nothing changes; the rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder.
    """
    if edges.count() <= task_edges:
        return materialize(edges.select("u", "v").coalesce(1).mapInArrow(_union, "node binary, comp binary"))
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        of = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = materialize(lower.join(of, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        changed = after.where("comp <> old").limit(1).count()
        discard(labels)
        labels = after.select("node", "comp")
        if not changed:
            discard(both)
            return labels
