"""Queries that write a table to files and read it back: formats, matrices, logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.plans.fixtures import read
from cairnlight.plans.registry import query
from cairnlight.sources import embeddings as E
from cairnlight.sources import files
from cairnlight.sources.scratch import local_path, shared_folder
from cairnlight.streaming import logs


@query("SRC9_embedding_matrix", "SELECT 'vec::' || vec_id AS evidence_id, len(embedding) AS dims, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x)), 4) AS total FROM embeddings")
def src9(spark, sf_dir):
    """All vectors through a matrix file and an id mapping: written in place, found, and read by ranges of 512 rows."""
    root = shared_folder(spark)
    folder = f"{root}/embeddings/build/model"
    v = E.numbered(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "row")
    n, width = v.agg(F.count("*"), F.max(F.size("embedding"))).first()
    E.write_matrix(v, "embedding", "row", f"{folder}/embeddings.npy", (n, width or 0))
    files.write_jsonl(v.select(F.concat(F.lit("vec::"), "vec_id").alias("id"), F.col("row").alias("embedding_row")), f"{folder}/id_mapping.jsonl")
    got = E.load(spark, E.discover(root, "build", "model"), rows=512)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return got.select("evidence_id", F.size("vector").cast("long").alias("dims"), F.round(total, 4).alias("total"))


_EVENTS = "event_type, count(*) AS n, round(sum(value), 2) AS total"


@query("SR1_log_tail", f"SELECT {_EVENTS} FROM events GROUP BY ALL")
def sr1(spark, sf_dir):
    """Events through log files: a stream of their whole lines by byte offsets, small polls, kept as Parquet.

    An unfinished last line in one more file stays unread.
    """
    root = shared_folder(spark)
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    e.select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).write.text(f"{root}/log")
    with open(f"{local_path(root)}/log/part-open.txt", "w") as f:
        f.write('{"event_id": -1, "event_type": "error", "va')
    lines = logs.follow(spark, f"{root}/log/part-*", poll_bytes=1 << 20)
    record = F.from_json("line", "event_id long, event_type string, value double", {"mode": "FAILFAST"})
    q = lines.select(record.alias("r")).select("r.*").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.schema("event_id long, event_type string, value double").parquet(f"{root}/out")
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _kept(spark, df, write, back):
    path = f"{shared_folder(spark)}/table"
    write(df, path)
    return back(path)


_ORDERS = "o_orderkey, o_custkey, o_orderpriority, o_totalprice"


@query("SRC1_SNK1_json_lines", f"SELECT {_ORDERS} FROM orders")
def src1(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(*_ORDERS.split(", "))
    return _kept(spark, o, files.write_jsonl, lambda p: files.read_jsonl(spark, p, o.schema))


@query("SRC2_SNK2_csv", "SELECT doc_id, text, source FROM documents")
def src2(spark, sf_dir):
    """Texts with commas, quotes and line ends through CSV in an explicit order of columns; only three are parsed back."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    order = ["source", "text", "doc_id", "lang"]
    schema = T.StructType([d.schema[c] for c in order])
    return _kept(spark, d, lambda df, p: files.write_csv(df, p, order), lambda p: files.read_csv(spark, p, schema, ["doc_id", "text", "source"], multi_line=True))


@query("SNK3_partitioned", "SELECT n_name AS company, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) = 1996 GROUP BY ALL")
def snk3(spark, sf_dir):
    """Cases in folders by company and year; reading a year back opens that year's folders only."""
    from cairnlight.plans.fixtures import cases

    c = cases(spark, sf_dir).select("case_id", "company", "year")
    got = _kept(spark, c, lambda df, p: files.write_partitioned(df, p, ["company", "year"]), lambda p: spark.read.parquet(p))
    return got.where("year = 1996").groupBy("company", "year").agg(F.count("*").alias("n"))


@query("SNK5_append_latest", "SELECT conv_id, max(turn) AS turn, count(*) + 1 AS records FROM conversations GROUP BY ALL")
def snk5(spark, sf_dir):
    """Records of calls appended in two goes; the last record of a call is the one that counts."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    path = f"{shared_folder(spark)}/calls"
    files.append_records(c.withColumn("seq", F.lit(1)), path)
    files.append_records(c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn")).withColumn("seq", F.lit(2)), path)
    got = files.read_jsonl(spark, path, T.StructType([*c.schema.fields, T.StructField("seq", T.IntegerType())]))
    n = got.groupBy("conv_id").agg(F.count("*").alias("records"))
    return files.latest(got, "conv_id", "seq").select("conv_id", "turn").join(n, "conv_id")


@query("SRC3_first_index", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'narrative' WHEN p_partkey % 3 = 0 THEN 'rows' ELSE 'combined' END AS found FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def src3(spark, sf_dir):
    """Split indexes that share ids, and a combined one that is not looked at while they exist."""
    p = read(spark, sf_dir, "part").select("p_partkey")
    part = lambda k, name: p.where(F.col("p_partkey") % k == 0).withColumn("found", F.lit(name))
    return files.fallback_index(part(2, "narrative"), part(3, "rows"), part(1, "combined"), "p_partkey")


@query("SRC10_selected", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def src10(spark, sf_dir):
    """Customers whose name is in a list of names, one a line, some behind comment marks."""
    # A number sign begins a comment.
    c = read(spark, sf_dir, "customer").select("c_custkey", F.translate("c_name", "#", "-").alias("c_name"))
    path = f"{shared_folder(spark)}/names"
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit(" # chosen"))).otherwise(F.concat(F.lit("# "), "c_name"))
    c.select(line.alias("value")).write.text(path)
    return c.join(files.read_names(spark, path), F.col("c_name") == F.col("name"), "left_semi").select("c_custkey")


@query(
    "SRC7_report_inventory",
    "SELECT 'company' || (o_custkey % 50) AS company, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'AR' ELSE 'SR' END AS kind, max(CAST(o_orderkey % 3 = 0 AS INTEGER)) = 1 AS listed FROM orders GROUP BY ALL",
)
def src7(spark, sf_dir):
    """An inventory under other column names, with repeats, and the files that it does not list."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("company"), F.col("o_custkey") % 50).alias("c"), F.year("o_orderdate").alias("y"), F.when(F.col("o_orderkey") % 2 == 0, "AR").otherwise("SR").alias("k"))
    name = F.concat_ws("_", "c", F.col("y").cast("string"), F.concat("k", F.lit(".pdf")))
    listed = o.where(F.col("o_orderkey") % 3 == 0).select(F.col("c").alias("Company"), F.col("y").cast("string").alias("reporting_year"), F.col("k").alias("report_type"), name.alias("file_name"), "o_orderkey")
    found = o.select(F.concat(F.lit("reports/"), name).alias("path"))
    got = files.report_inventory(listed, found)
    return got.select("company", "year", "kind", "listed")
