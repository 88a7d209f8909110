"""Sharding along a Hilbert curve over quantised document metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import global_positions

#: Bits of each dimension; a cell index has bits x dimensions.
BITS = 5


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (rows of ``coords``, one column per dimension, values under 2**bits)."""
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def hash_cell(c: Column, bits: int = BITS) -> Column:
    """Cell of a categorical value: values spread by CRC, null in cell 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % (1 << bits), F.lit(0)).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Cell of a positive size: two cells for each doubling, the last cell open."""
    top = F.length(F.bin(size)) - 1
    half = F.floor(size / F.pow(F.lit(2.0), top - 1)) % 2
    return F.least(F.lit((1 << bits) - 1), F.when(top > 0, top * 2 + half).otherwise(0)).cast("int")


def hilbert_shards(df: DataFrame, dims: dict[str, Column], num_shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """Add each dimension's cell, ``curve``, ``shard`` and ``slot`` to ``df``.

    Rows are ordered by curve index, then by the columns ``ties``, and cut into runs whose row counts differ by one at
    most, so a shard covers few cells and files can be pruned by any of the dimensions. Cells are nullable-free
    integers under 2**bits (the columns in ``dims`` decide where nulls go). Rows equal in all of ``ties`` take
    neighbouring places in any order. An empty table gives no rows.
    """

    @F.pandas_udf("long")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    cells = df.withColumns(dims)
    placed, total = global_positions(cells.withColumn("curve", curve(*dims)), ["curve", *ties])
    # Integers only: a shard starts at the first place p with p * num_shards >= shard * total.
    shard = F.expr(f"pos * {num_shards}L div {max(total, 1)}L")
    first = F.expr(f"((pos * {num_shards}L div {max(total, 1)}L) * {total}L + {num_shards - 1}L) div {num_shards}L")
    return placed.withColumns({"shard": shard.cast("int"), "slot": F.col("pos") - first}).drop("pos")


def shard_documents(docs: DataFrame, num_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of documents by source, language and size; keeps ids, cells and digests, not the texts.

    Size is the text's UTF-8 bytes plus 1 (null: 1) and a null text has the CRC of an empty one. Null sources and
    languages share cell 0. Repeated rows each take a place of their own.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    narrow = docs.select(
        F.col(id_col).alias("id"),
        size.alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        hash_cell(F.col("source")).alias("source_cell"),
        hash_cell(F.col("lang")).alias("lang_cell"),
    )
    dims = {"source_cell": F.col("source_cell"), "lang_cell": F.col("lang_cell"), "size_cell": size_cell(F.col("size"))}
    out = hilbert_shards(narrow, dims, num_shards, ["id", "text_crc32", "size"])
    return out.withColumnRenamed("id", id_col)
