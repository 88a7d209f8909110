"""Source divergence audit: how far the term shares of the sources of a language lie apart.

Terms with the same counts in the same sources form one sparse count vector. Every pair of sources is evaluated once per
distinct vector and the value multiplied by the number of its terms; the ranked list of a source's own terms goes back
to the original terms.

Null texts, languages and sources read as ''. A language without kept terms still gives all pairs of its sources, of
value 0. Repeated rows count as often as they occur. Ties go to the smaller item in UTF-8 order. Very long texts are
counted in slices. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.llm.common import LOWER, UPPER, materialize, slices

#: Documents of a language that a term must occur in.
MIN_DOCS = 10
#: Ranks of a source's own terms.
TERM_RANKS = 10
#: Whole numbers stand for shares of 1 by this.
UNIT = 1_000_000_000
#: Entries of counters and of sums that a task holds before it passes them on.
HELD = 400_000
#: Sources of all languages up to which the table of sources goes to every task.
SMALL = 100_000

_LETTERS = (UPPER + LOWER).encode() + bytes(range(128, 256))
_TERMS = bytes(b if b in _LETTERS else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in slices: runs of ASCII letters, lower-cased, and of bytes over 127."""
    for part in slices((text or "").encode().translate(_TERMS), b" "):
        yield part.split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            # The empty term says that the group occurs.
            terms = [b"", *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms)),
                    pa.array([source] * len(terms)),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            seen: set[bytes] = set()
            for terms in terms_of(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def count_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, vector): counts by source of each kept term, sources in order; the empty term lists all sources."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    parts = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # All sources of a term meet, so one shuffle serves both sums.
    by_source = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = by_source.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs"))
    return materialize(vectors.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"))


def languages(vectors: DataFrame) -> DataFrame:
    """(lang, v, total, groups): number of kept terms, all their occurrences, and (source, size) of each source."""
    sizes = vectors.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = sizes.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "size"))).alias("groups"), F.sum("size").alias("total"))
    return materialize(groups.join(vectors.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v")), "lang"))


def shares(counts: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / size), by long division to the base 1,000: exact for sizes under 9 * 10**15."""
    q, r = np.divmod(counts + 2, max(size, 1))
    for _ in range(3):
        more, r = np.divmod(r * 1000, max(size, 1))
        q = q * 1000 + more
    return q + 1


def pair_values(counts: np.ndarray, sizes: np.ndarray, v: int, times: np.ndarray) -> np.ndarray:
    """Sum over vectors (rows) of times * floor((p - q)**2 / (p + q)) for each pair of sources, above the diagonal."""
    n = counts.shape[1]
    p = np.column_stack([shares(counts[:, k], int(sizes[k]) + 2 * v) for k in range(n)])
    out = np.zeros((n, n), np.int64)
    for a in range(n - 1):
        own, rest = p[:, a : a + 1], p[:, a + 1 :]
        out[a, a + 1 :] = times @ ((own - rest) ** 2 // (own + rest))
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, values in sums.items():
            a, b = np.triu_indices(len(values), 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(values[a, b])], names=["lang", "a", "b", "value"])
        sums.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            rows = batch.filter(pa.array([x == lang for x in langs]))
            sizes = np.asarray(rows.column("sizes")[0].as_py(), np.int64)
            step = max(1, HELD // len(sizes))
            for start in range(0, rows.num_rows, step):
                part = rows.slice(start, step)
                counts = part.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sizes))
                got = pair_values(counts, sizes, part.column("v")[0].as_py(), part.column("times").to_numpy(zero_copy_only=False))
                sums[lang] = sums[lang] + got if lang in sums else got
        if sum(x.size for x in sums.values()) > HELD:
            yield from flush()
    yield from flush()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all pairs of sources and of the first terms of each source.

    A term's counts shuffle once, per-task sums of them. Rows after that are terms in at least ``min_docs`` documents and
    distinct vectors; sums of pairs are made within tasks, so no pair of sources is a row for each term.
    """
    vectors = count_vectors(docs, min_docs)
    langs = languages(vectors)
    few = (langs.agg(F.sum(F.size("groups"))).first()[0] or 0) <= SMALL

    def spread(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    kept = vectors.where("term <> ''")
    distinct = kept.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    # A vector of no terms, so that languages without kept terms have their pairs.
    none = langs.select("lang", F.array().cast(distinct.schema["vector"].dataType).alias("vector"), F.lit(0).cast("long").alias("times"))
    of = F.map_from_entries("vector")
    dense = (
        distinct.unionByName(none)
        .join(spread(langs), "lang")
        .select("lang", "times", "v", F.transform("groups", lambda g: F.coalesce(of[g["source"]], F.lit(0))).alias("counts"), F.col("groups.size").alias("sizes"))
    )
    sums = dense.mapInArrow(_pairs, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = (
        sums.select("lang", "value", F.inline(both))
        .join(spread(langs.select("lang", "groups")), "lang")
        .select("lang", F.get("groups", F.col("a"))["source"].alias("source"), F.lit("pair").alias("part"), F.get("groups", F.col("b"))["source"].alias("item"), "value")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    sources = langs.select("lang", "v", "total", F.inline("groups"))
    own = (
        kept.select("lang", F.col("term").alias("item"), F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("all"), F.inline("vector"))
        .where("n > 0")
        .join(spread(sources), ["lang", "source"])
        .select("lang", "source", "item", _share("n", "size").alias("p"), _share("all", "total").alias("q"))
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
        .where(F.col("rank") <= term_ranks)
    )
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(own)


def _share(count: str, size: str) -> F.Column:
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0)) div ({size} + 2 * v)")
