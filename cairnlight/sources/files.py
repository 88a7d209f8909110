"""File sources and sinks with fixed schemas and strict errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.functions.text import clean_text

REPORT_NAME = r"([^/]+)_(\d{4})_(AR|SR)\.pdf$"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header and a fixed schema; only ``columns`` are parsed. With ``multi_line`` cells may hold line ends, and
    a file is not split."""
    df = spark.read.schema(schema).options(header=True, mode="FAILFAST", escape='"', multiLine=multi_line, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", lineSep="\n").csv(path)
    return df.select(*columns) if columns else df


def first_index(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of indexes by priority: the row of the first part that has a key wins."""
    every = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_part")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_part", "_r")


def fallback_index(narrative: DataFrame | None, rows: DataFrame | None, combined: DataFrame | None, key: str) -> DataFrame:
    """The split indexes if either exists, else the combined one; first occurrence of an id wins."""
    split = [x for x in (narrative, rows) if x is not None]
    if not split and combined is None:
        raise FileNotFoundError("neither split nor combined index")
    return first_index(split or [combined], key)


def report_names(path: Column) -> Column:
    """struct<company, year, kind> of ``<company>_<year>_<AR or SR>.pdf``, null for other names."""
    ok = path.rlike(REPORT_NAME)
    part = lambda i: F.regexp_extract(path, REPORT_NAME, i)
    return F.when(ok, F.struct(part(1).alias("company"), part(2).cast("int").alias("year"), part(3).alias("kind")))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Report files of a folder: path, company, year, kind, and whether the header is in the first 1,024 bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    return files.select("path", report_names(F.col("path")).alias("r"), head.contains("%PDF-").alias("is_pdf")).select("path", "r.*", "is_pdf")


#: The names under which an inventory may have its columns, in order of preference.
INVENTORY_NAMES = {
    "company": ["company_id", "company", "Company", "company_name"],
    "year": ["source_year", "reporting_year", "report_year", "year", "Year"],
    "kind": ["source_type", "report_type", "type"],
    "file": ["file_name", "filename", "file", "path"],
}


def inventory(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under their first known name each, repeated rows dropped."""
    cols = [F.coalesce(*(F.col(c) for c in options if c in df.columns), F.lit(None)).cast("string").alias(name) for name, options in names.items()]
    return df.select(*cols).dropDuplicates()


def report_inventory(listed: DataFrame, found: DataFrame, names: dict[str, list[str]] = INVENTORY_NAMES) -> DataFrame:
    """(company, year, kind, file, listed): reports of an inventory, then files of ``found`` (path) that it does not list.

    A report is one (company, year, kind, file), file being the last part of a path; of repeats the listed one stays. What
    an inventory leaves out is read from the name of the file. Files with other names are left out.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    named = inventory(listed, names).withColumn("file", base(F.col("file"))).withColumn("r", report_names(F.col("file")))
    named = named.select(F.coalesce("company", "r.company").alias("company"), F.coalesce(F.col("year").try_cast("int"), F.col("r.year")).alias("year"), F.coalesce("kind", "r.kind").alias("kind"), "file", F.lit(True).alias("listed"))
    others = found.select(base(F.col("path")).alias("file"), report_names(base(F.col("path"))).alias("r")).where("r is not null")
    others = others.select("r.company", "r.year", "r.kind", "file", F.lit(False).alias("listed"))
    return named.unionByName(others).groupBy("company", "year", "kind", "file").agg(F.bool_or("listed").alias("listed"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names from a text file, one per line; ``#`` starts a comment."""
    line = clean_text(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("name")).where("name <> ''").distinct()


def write_jsonl(df: DataFrame, path: str) -> None:
    """Staged JSON lines; NaN is an error before anything is written."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if numbers:
        bad = df.select(F.count_if(F.greatest(*(F.isnan(c).cast("int") for c in numbers), F.lit(0)) == 1)).first()[0]
        if bad:
            raise ValueError(f"{bad} rows with NaN")
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header in a fixed order of columns."""
    df.select(*(columns or df.columns)).write.mode("overwrite").options(header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n").csv(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet by keys, one shuffle on them so that a folder has few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The record of each key that was written last."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")
