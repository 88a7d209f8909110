"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_ROW_BITS = (1 << 33) - 1
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, one process (tests) takes a new
    folder of its own, and a cluster raises, as its executors would not see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairnlight-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def materialize(df: DataFrame, compression: str = "snappy", batch_bytes: int = 64_000_000) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends. Shuffle files of the step are of no use once it is written, so Spark is
    told to remove them then. Arrow batches of the step hold ``batch_bytes`` at most.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairnlight-{uuid.uuid4().hex}"
    own = {_BATCH: str(batch_bytes), _CLEANUP: "true"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame from ``materialize`` that no later plan reads."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def global_positions(df: DataFrame, keys: Sequence[str], pos: str = "pos") -> tuple[DataFrame, int]:
    """Add the 0-based place of every row in the order of ``keys``; returns it with the row count.

    Range partitions are sorted on their own; only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    part = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    offsets, total = [], 0
    for r in sorted(part.groupBy("_pid").count().collect()):
        offsets.append((r["_pid"], total))
        total += r["count"]
    starts = spark.createDataFrame(offsets, "_pid int, _start long")
    out = part.join(F.broadcast(starts), "_pid").withColumn(pos, F.col("_start") + F.col("_row"))
    return out.drop("_pid", "_row", "_start"), total


def map_rows(df: DataFrame, row_fn: Callable[[], Callable[..., tuple]], schema: str | T.StructType, binary: Sequence[str] = ()) -> DataFrame:
    """Apply a per-row function over Arrow batches.

    ``row_fn`` builds the function once per task. Columns named in ``binary`` arrive as UTF-8 bytes.
    """
    out_type = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = df.columns
    as_bytes = set(binary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out_type)
        fn = row_fn()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                cols = [
                    (part.column(i).cast(pa.binary()) if name in as_bytes else part.column(i)).to_pylist()
                    for i, name in enumerate(names)
                ]
                rows = [fn(*values) for values in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)],
                    schema=target,
                )

    return df.mapInArrow(run, out_type)


def slices(data: bytes, sep: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, each cut after a ``sep``; longer only where no ``sep`` occurs."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            cut = data.rfind(sep, start, end)
            cut = data.find(sep, end) if cut < 0 else cut
            end = cut + 1 if cut >= 0 else len(data)
        yield data[start:end]
        start = end


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
