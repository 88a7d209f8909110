"""Evidence-shaped views of the driver tables, for queries, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of unsupported claims, in the order of the reports.
LABELS = (
    "non_disclosure_statement",
    "contradiction",
    "evidence_conflation",
    "factual_boundary_distortion",
    "inferential_inflation",
    "unsupported_novelty",
)
TYPES = ("csv_metric", "narrative", "pdf_table_row")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence cards: a document is a card, its source a company."""
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc::"), F.col("doc_id")).alias("evidence_id"),
        F.col("source").alias("company_id"),
        (F.lit(2015) + F.col("doc_id") % 9).cast("int").alias("source_year"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 3 + 1).cast("int")).alias("source_type"),
        "text",
        "lang",
        "doc_id",
    )


CARDS = """cards AS (
  SELECT 'doc::' || doc_id AS evidence_id, source AS company_id, CAST(2015 + doc_id % 9 AS INTEGER) AS source_year,
         CASE doc_id % 3 WHEN 0 THEN 'csv_metric' WHEN 1 THEN 'narrative' ELSE 'pdf_table_row' END AS source_type,
         text, lang, doc_id
  FROM documents)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: an order is a case of its customer's nation, in the year of the order."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    # Both are fixed lists: 25 nations, 5 regions.
    place = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        read(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("case_id"),
            F.col("n_name").alias("company"),
            F.year("o_orderdate").alias("year"),
            F.format_string("T%02d", F.col("o_orderkey") % 12).alias("task"),
            F.col("r_name").alias("sector"),
        )
    )


CASES = """cases AS (
  SELECT o_orderkey AS case_id, n_name AS company, CAST(year(o_orderdate) AS INTEGER) AS year,
         'T' || lpad(CAST(o_orderkey % 12 AS VARCHAR), 2, '0') AS task, r_name AS sector
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosure claims with support sets: returned lines are direct, open ones inferred from two cards, the rest unsupported."""
    part, supp = F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey"))
    one = lambda ids, kind: F.array(F.struct(ids.alias("ec_claim_ids"), F.lit(kind).alias("support_type")))
    sets = (
        F.when(F.col("l_returnflag") == "A", one(F.array(part), "direct"))
        .when(F.col("l_returnflag") == "N", one(F.array(part, supp), "inferred"))
        .otherwise(F.array().cast("array<struct<ec_claim_ids:array<string>,support_type:string>>"))
    )
    label = F.when(F.col("l_returnflag") == "R", F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % 6 + 1).cast("int")))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("dc_id"),
        sets.alias("support_sets"),
        label.alias("label"),
        part.alias("part"),
        supp.alias("supp"),
    )


_LABEL_LIST = ", ".join(f"'{x}'" for x in LABELS)
CLAIMS = f"""claims AS (
  SELECT l_orderkey AS case_id, l_orderkey || '-' || l_linenumber AS dc_id, l_returnflag AS flag,
         CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'inferred' ELSE 'unsupported' END AS verdict,
         CASE WHEN l_returnflag = 'R' THEN list_extract([{_LABEL_LIST}], CAST(l_partkey % 6 + 1 AS INTEGER)) END AS label,
         'p' || l_partkey AS part, 's' || l_suppkey AS supp
  FROM lineitem)"""


def inventory(claim_rows: DataFrame) -> DataFrame:
    """Evidence claims of each case: all cards its lines name."""
    return claim_rows.select("case_id", F.explode(F.array("part", "supp")).alias("ec_id")).distinct()


ECS = "ecs AS (SELECT DISTINCT case_id, unnest([part, supp]) AS ec_id FROM claims)"
