"""Embedding matrices with id mappings: found in the accepted layouts, read by ranges of rows, written in place."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnlight.sources.scratch import local_path

#: Names of the files, and of the fields that a mapping may use, in order of preference.
MATRIX_NAMES = ("embeddings.npy", "embedding_matrix.npy", "matrix.npy")
MAPPING_NAMES = ("id_mapping.jsonl", "id_mapping.json", "id_mapping.csv", "evidence_ids.json", "metadata.jsonl")
ID_FIELDS = ("evidence_id", "id", "card_id", "evidence_card_id")
ROW_FIELDS = ("embedding_row", "embedding_index", "index", "row_index")

ROWS = 65_536


@dataclass(frozen=True)
class Artifacts:
    matrix: str
    mapping: str


def discover(root: str, build: str, model: str) -> Artifacts:
    """Matrix and mapping of a model: in the build's folder of the model, under ``models``, or under the model's safe name.

    The first folder with a file wins, for either; none is an error.
    """
    base = os.path.join(local_path(root), "embeddings", build)
    folders = [os.path.join(base, x) for x in (model, os.path.join("models", model), re.sub(r"[^A-Za-z0-9._-]+", "_", model))]

    def first(names: tuple[str, ...]) -> str:
        found = (os.path.join(f, n) for f in folders for n in names if os.path.exists(os.path.join(f, n)))
        path = next(found, None)
        if path is None:
            raise FileNotFoundError(f"none of {', '.join(names)} under {base} for {model}")
        return path

    return Artifacts(first(MATRIX_NAMES), first(MAPPING_NAMES))


@dataclass
class _Rows(InputPartition):
    start: int
    stop: int


class _MatrixReader(DataSourceReader):
    def __init__(self, path: str, step: int) -> None:
        self.path, self.step = path, step

    def partitions(self) -> list[_Rows]:
        matrix = np.load(self.path, mmap_mode="r")
        if matrix.ndim != 2 or matrix.dtype.kind != "f":
            raise ValueError(f"not a matrix of floats: {self.path}, {matrix.dtype} {matrix.shape}")
        return [_Rows(k, min(k + self.step, len(matrix))) for k in range(0, len(matrix), self.step)]

    def read(self, rows: _Rows) -> Iterator[pa.RecordBatch]:
        matrix = np.load(self.path, mmap_mode="r")
        for k in range(rows.start, rows.stop, 4096):
            part = np.ascontiguousarray(matrix[k : min(k + 4096, rows.stop)], np.float32)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), matrix.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), vectors], names=["row", "vector"])


class MatrixSource(DataSource):
    """``npy_matrix``: rows of a matrix file, one task for each range of ``rows`` rows; a task maps its range only."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema) -> _MatrixReader:  # noqa: ANN001
        return _MatrixReader(self.options["path"], int(self.options.get("rows", ROWS)))


def read_matrix(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """(row, vector) of a matrix file."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy_matrix").option("path", local_path(path)).option("rows", rows).load()


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(evidence_id, row) from JSON lines, a JSON document or CSV.

    A record has an id under one of the known names, and its row under one too, else its place in the file. A JSON document
    is a list of ids or records, a map of ids to rows, one of rows to ids, or has one of these under a known key. Records
    without an id are left out.
    """
    if path.endswith(".json"):
        return _document(spark, path)
    if path.endswith(".csv"):
        df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    else:
        df = spark.read.option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    return _records(numbered(df, "_place"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of each row from 0 in the order of its partitions, from one count per partition.

    For rows of files, which every run of the plan deals to the same partitions."""
    p = df.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts, total = [], 0
    for r in sorted(p.groupBy("_p").count().collect()):
        counts.append((r["_p"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(counts, "_p int, _start long")
    return p.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_k")).drop("_p", "_k", "_start")


def _records(df: DataFrame) -> DataFrame:
    named = lambda names: F.coalesce(*(F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in names if c in df.columns), F.lit(None).cast("string"))
    return df.select(named(ID_FIELDS).alias("evidence_id"), F.coalesce(named(ROW_FIELDS).cast("long"), F.col("_place")).alias("row")).where("evidence_id is not null")


def _document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document in one of the accepted shapes, as VARIANT; it is one row, exploded in place."""
    v = F.parse_json("value")
    kind = lambda c: F.regexp_extract(F.schema_of_variant(c), r"^(\w+)", 1)
    whole = spark.read.option("wholetext", True).text(path).select(v.alias("v"))
    keys = ("records", "items", "embeddings", "metadata", "evidence_ids")
    inner = F.coalesce(*(F.try_variant_get("v", f"$.{k}", "variant") for k in keys))
    plain = F.try_variant_get("v", "$", "map<string,variant>")
    scalar = F.forall(F.map_values(plain), lambda x: kind(x).isin("STRING", "BIGINT"))
    body = whole.select(F.when((kind(F.col("v")) == "OBJECT") & ~scalar, inner).otherwise(F.col("v")).alias("v"))
    items = body.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("_place", "x"))
    text = F.when(kind(F.col("x")) == "STRING", F.try_variant_get("x", "$", "string"))
    field = lambda names: F.coalesce(*(F.try_variant_get("x", f"$.{n}", "string") for n in names))
    listed = items.select(F.coalesce(text, field(ID_FIELDS)).alias("evidence_id"), F.coalesce(field(ROW_FIELDS).cast("long"), F.col("_place").cast("long")).alias("row"))
    pairs = body.select(F.explode(F.try_variant_get("v", "$", "map<string,string>")).alias("k", "x"))
    # Of a map either the keys or the values are rows.
    rows_first = F.col("k").rlike(r"^\d+$") & ~F.col("x").rlike(r"^\d+$")
    mapped = pairs.select(F.when(rows_first, F.col("x")).otherwise(F.col("k")).alias("evidence_id"), F.when(rows_first, F.col("k")).otherwise(F.col("x")).try_cast("long").alias("row"))
    return listed.unionByName(mapped.where("row is not null")).where("evidence_id is not null and evidence_id <> ''")


def load(spark: SparkSession, found: Artifacts, rows: int = ROWS) -> DataFrame:
    """(evidence_id, row, vector) of every id of the mapping. An id whose row is beyond the matrix raises, and so does an
    empty mapping; rows of the matrix without an id are left out."""
    mapping = read_mapping(spark, found.mapping)
    matrix = read_matrix(spark, found.matrix, rows)
    if mapping.isEmpty():
        raise ValueError(f"no ids in {found.mapping}")
    said = F.concat(F.lit("row beyond the matrix: "), F.col("row").cast("string"))
    joined = mapping.join(matrix, "row", "left")
    return joined.select("evidence_id", "row", F.when(F.col("vector").isNull(), F.raise_error(said)).otherwise(F.col("vector")).alias("vector"))


def write_matrix(df: DataFrame, vector: str, row: str, path: str, shape: tuple[int, int]) -> None:
    """A matrix file of float32 with each vector at its row: the file is laid out once, and tasks fill their rows."""
    path = local_path(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    np.lib.format.open_memmap(path, "w+", np.float32, shape).flush()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.load(path, mmap_mode="r+"), 0
        for b in batches:
            if b.num_rows:
                out[b.column(0).to_numpy()] = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                n += b.num_rows
        out.flush()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    done = df.select(F.col(row).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(fill, "n long").agg(F.sum("n")).first()[0] or 0
    if done != shape[0]:
        raise ValueError(f"{done} vectors for {shape[0]} rows")
