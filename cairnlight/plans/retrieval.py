"""Queries: BM25, dense scores, fusion, selection and retrieval summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.operators import retrieval as R
from cairnlight.plans.fixtures import CARDS, cards, read
from cairnlight.plans.registry import query

TOP, PER = 20, 3


def subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: CTEs up to bm(query_id, company_id, evidence_id, score, rank).
BM25 = (
    CARDS
    + r""",
tok AS (SELECT company_id, evidence_id, regexp_extract_all(lower(text), '[A-Za-z]+[0-9]*|[0-9]+(?:\.[0-9]+)?') AS t FROM cards),
pools AS (SELECT company_id, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[A-Za-z]+[0-9]*|[0-9]+(?:\.[0-9]+)?')) AS term FROM benchmark),
post AS (SELECT company_id, evidence_id, dl, term, count(*) AS tf FROM (SELECT company_id, evidence_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT company_id, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avgdl) AS avgdl
        FROM post JOIN pools USING (company_id) GROUP BY ALL),
sc AS (SELECT query_id, company_id, evidence_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
       FROM post JOIN idf USING (company_id, term) JOIN qt USING (term) GROUP BY ALL),
alls AS (SELECT q.item_id AS query_id, c.company_id, c.evidence_id, coalesce(sc.score, 0.0) AS score
         FROM benchmark q CROSS JOIN cards c LEFT JOIN sc ON sc.query_id = q.item_id AND sc.company_id = c.company_id AND sc.evidence_id = c.evidence_id),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, company_id ORDER BY score DESC, evidence_id) AS INTEGER) AS rank
       FROM alls QUALIFY rank <= 20)"""
)

#: dense: ranking by dot product. The vector of a card is the one with its document's id, that of a query the one with its id;
#: cards and queries without one are in no dense list.
DENSE = """,
dv AS (SELECT q.item_id AS query_id, c.company_id, c.evidence_id,
              round(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda x: x[1] * x[2])), 6) AS score
       FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id CROSS JOIN cards c JOIN embeddings e ON e.vec_id = c.doc_id),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, company_id ORDER BY score DESC, evidence_id) AS INTEGER) AS rank
          FROM dv QUALIFY rank <= 20)"""

FUSED = """,
every AS (SELECT query_id, company_id, evidence_id, 'bm25' AS list, rank FROM bm UNION ALL SELECT query_id, company_id, evidence_id, 'dense', rank FROM dense),
sums AS (SELECT query_id, company_id, evidence_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score,
                max(CASE WHEN list = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN list = 'dense' THEN rank END) AS dense_rank
         FROM every GROUP BY ALL),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, company_id ORDER BY rrf_score DESC, evidence_id) AS INTEGER) AS rank FROM sums)"""


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_bm25(cards(spark, sf_dir), subqueries(spark, sf_dir), "company_id", TOP)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of each company by the dot product of their vectors with the query's."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = cards(spark, sf_dir).join(vectors, F.col("doc_id") == F.col("vec_id")).select("company_id", "evidence_id", F.col("embedding").alias("vector"))
    q = subqueries(spark, sf_dir).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("query_vector"))
    return R.rank_dense_pools(own, q, "company_id", TOP)


def fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf_fuse({"bm25": bm25(spark, sf_dir), "dense": dense(spark, sf_dir)}, ["query_id", "company_id"])


@query("RT3_bm25_rank", f"WITH {BM25} SELECT query_id, company_id, evidence_id, round(score, 6) AS score, rank FROM bm")
def rt3(spark, sf_dir):
    return bm25(spark, sf_dir).select("query_id", "company_id", "evidence_id", F.round("score", 6).alias("score"), "rank")


@query(
    "RT1_bm25_index",
    f"WITH {BM25} SELECT company_id, term, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM idf WHERE term IN (SELECT term FROM qt)",
)
def rt1(spark, sf_dir):
    c = cards(spark, sf_dir).select("company_id", "evidence_id", R.bm25_tokens(F.col("text")).alias("t"))
    pools = c.groupBy("company_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    q = subqueries(spark, sf_dir).select(F.explode(R.bm25_tokens(F.col("text"))).alias("term")).distinct()
    df = c.select("company_id", F.explode(F.array_distinct("t")).alias("term")).join(q, "term", "left_semi").groupBy("company_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(pools, "company_id").select("company_id", "term", F.round(idf, 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


@query("RT2_bm25_score", f"WITH {BM25} SELECT query_id, company_id, evidence_id, round(score, 6) AS score FROM sc")
def rt2(spark, sf_dir):
    s = R.all_bm25(cards(spark, sf_dir), subqueries(spark, sf_dir), "company_id")
    return s.select("query_id", "company_id", "evidence_id", F.round("score", 6).alias("score"))


@query("RT6_rrf_fuse", f"WITH {BM25}{DENSE}{FUSED} SELECT query_id, company_id, evidence_id, round(rrf_score, 6) AS rrf_score, bm25_rank, dense_rank, rank FROM fused")
def rt6(spark, sf_dir):
    return fuse(spark, sf_dir).select("query_id", "company_id", "evidence_id", F.round("rrf_score", 6).alias("rrf_score"), "bm25_rank", "dense_rank", "rank")


_STRATA = f"""WITH {BM25}{DENSE}{FUSED},
st AS (SELECT f.*, c.source_type, row_number() OVER (PARTITION BY query_id, f.company_id, source_type ORDER BY rank) AS sr
       FROM fused f JOIN cards c USING (evidence_id) QUALIFY sr <= 3)
SELECT query_id, company_id, source_type, evidence_id, round(rrf_score, 6) AS rrf_score,
       CAST(row_number() OVER (PARTITION BY query_id, company_id ORDER BY source_type, rank) AS INTEGER) AS prompt_rank FROM st"""


@query("retrieval", _STRATA)
def flagship(spark, sf_dir):
    """BM25 and dense lists per query and company, fused, the first of each card type, numbered for a prompt."""
    kinds = cards(spark, sf_dir).select("evidence_id", "source_type")
    out = R.stratified(fuse(spark, sf_dir).join(kinds, "evidence_id"), ["query_id", "company_id"], "source_type", PER)
    return out.select("query_id", "company_id", "source_type", "evidence_id", F.round("rrf_score", 6).alias("rrf_score"), "prompt_rank")


query("WN3_stratified_prompt_rank", _STRATA)(flagship)
query("TK3_stratified_top", _STRATA)(flagship)


@query(
    "RT7_two_level_fusion",
    f"""WITH {BM25}{DENSE}{FUSED},
up AS (SELECT company_id, evidence_id, round(sum(1.0 / (60 + rank)), 9) AS s FROM fused GROUP BY ALL)
SELECT company_id, evidence_id, round(s, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY company_id ORDER BY s DESC, evidence_id) AS INTEGER) AS rank FROM up""",
)
def rt7(spark, sf_dir):
    """Across sub-queries only the ranks of the first fusion count."""
    s = fuse(spark, sf_dir).groupBy("company_id", "evidence_id").agg(F.round(F.sum(1.0 / (R.RRF_K + F.col("rank"))), 9).alias("s"))
    return R.ranked(s, ["company_id"], "s", "evidence_id").select("company_id", "evidence_id", F.round("s", 6).alias("rrf_score"), "rank")


@query("TK1_global_top_k", f"WITH {BM25}{DENSE}{FUSED} SELECT query_id, company_id, evidence_id, rank FROM fused WHERE rank <= 10")
def tk1(spark, sf_dir):
    return fuse(spark, sf_dir).where("rank <= 10").select("query_id", "company_id", "evidence_id", "rank")


@query(
    "WN5_best_channel_rank",
    f"""WITH {BM25} SELECT company_id, evidence_id, min(rank) AS best_rank, arg_min(query_id, rank * 1000000 + query_id) AS best_query FROM bm GROUP BY ALL""",
)
def wn5(spark, sf_dir):
    best = F.min(F.struct("rank", "query_id")).alias("b")
    return bm25(spark, sf_dir).groupBy("company_id", "evidence_id").agg(best).select("company_id", "evidence_id", F.col("b.rank").alias("best_rank"), F.col("b.query_id").alias("best_query"))


@query(
    "AG8_case_retrieval_summary",
    f"""WITH {BM25} SELECT query_id, company_id, count(*) AS n, CAST(count(*) FILTER (source_type = 'narrative') AS BIGINT) AS n_narrative,
 bool_or(source_type = 'csv_metric') AS has_metric, min(source_year) AS first_year, max(source_year) AS last_year
 FROM bm JOIN cards USING (evidence_id, company_id) GROUP BY ALL""",
)
def ag8(spark, sf_dir):
    c = cards(spark, sf_dir).select("evidence_id", "source_type", "source_year")
    return bm25(spark, sf_dir).join(c, "evidence_id").groupBy("query_id", "company_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_type") == "narrative").alias("n_narrative"), F.bool_or(F.col("source_type") == "csv_metric").alias("has_metric"),
        F.min("source_year").alias("first_year"), F.max("source_year").alias("last_year"),
    )


@query(
    "RT10_diagnostics",
    f"""WITH {BM25} SELECT query_id, company_id, string_agg(evidence_id, ',' ORDER BY rank) AS top_ids FROM bm WHERE rank <= 5 GROUP BY ALL""",
)
def rt10(spark, sf_dir):
    top = bm25(spark, sf_dir).where("rank <= 5").groupBy("query_id", "company_id").agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))).alias("a"))
    return top.select("query_id", "company_id", F.array_join("a.evidence_id", ",").alias("top_ids"))


_VEC = """pool AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, label, embedding AS qv FROM embeddings WHERE vec_id < 10)"""


def _vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    pool = e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), "label", F.col("embedding").alias("vector"))
    q = e.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vector"))
    return pool, q


@query(
    "RT4_dense_rank",
    f"""WITH {_VEC}, s AS (SELECT query_id, pool.label, 'v' || vec_id AS id,
 round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), lambda x: x[1] * x[2])), 6) AS score FROM pool JOIN q ON pool.label = q.label)
SELECT query_id, label, id, score, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""",
)
def rt4(spark, sf_dir):
    """Ten query vectors against all vectors with their label."""
    pool, q = _vectors(spark, sf_dir)
    return R.rank_dense(pool, q, "label", 20, "id")


@query(
    "RT4_dense_rank_all",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, 'v' || vec_id AS id,
 round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), lambda x: x[1] * x[2])), 6) AS score FROM embeddings, q)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""",
)
def rt4_all(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all vectors of all labels."""
    e = read(spark, sf_dir, "embeddings")
    pool = e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), F.col("embedding").alias("vector"))
    return R.rank_dense_all(pool, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 20)


@query(
    "RT13_norm_summary",
    """SELECT count(*) AS n, round(min(norm), 5) AS lowest, round(max(norm), 5) AS highest, round(avg(norm), 5) AS mean
 FROM (SELECT sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm FROM embeddings)""",
)
def rt13(spark, sf_dir):
    norm = read(spark, sf_dir, "embeddings").select(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    return norm.agg(F.count("*").alias("n"), F.round(F.min("norm"), 5).alias("lowest"), F.round(F.max("norm"), 5).alias("highest"), F.round(F.avg("norm"), 5).alias("mean"))


@query(
    "RT14_vector_integrity",
    """SELECT count(*) AS n, count(*) - count(DISTINCT vec_id) AS repeated_ids, CAST(count(*) FILTER (len(embedding) <> 64) AS BIGINT) AS bad_shape,
 CAST(count(*) FILTER (abs(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) - 1) > 1e-5) AS BIGINT) AS not_unit FROM embeddings""",
)
def rt14(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    norm = F.sqrt(R.dot(F.col("embedding"), F.col("embedding")))
    return e.agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("vec_id")).alias("repeated_ids"), F.count_if(F.size("embedding") != 64).alias("bad_shape"),
        F.count_if(F.abs(norm - 1) > 1e-5).alias("not_unit"),
    )


@query(
    "RT12_JN12_vector_reuse",
    """WITH t AS (SELECT doc_id, sha256(text) AS h FROM documents), old AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0),
cache AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, CASE WHEN old.h IS NOT NULL THEN 'legacy' WHEN cache.h IS NOT NULL THEN 'cache' ELSE 'pending' END AS origin
FROM t LEFT JOIN old ON t.h = old.h LEFT JOIN cache ON t.h = cache.h""",
)
def rt12(spark, sf_dir):
    """Texts whose vectors an older or a newer cache has; even ids stand for the older, multiples of 3 for the newer."""
    t = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old = t.where("doc_id % 2 = 0").select("h", F.lit("legacy").alias("a")).distinct()
    new = t.where("doc_id % 3 = 0").select("h", F.lit("cache").alias("b")).distinct()
    return t.join(old, "h", "left").join(new, "h", "left").select("doc_id", F.coalesce("a", "b", F.lit("pending")).alias("origin"))


@query(
    "RT8_query_bundle",
    """SELECT item_id AS query_id, 'Find evidence in 2024 for: ' || text AS query_text, sha256('Find evidence in 2024 for: ' || text) AS subquery_hash FROM benchmark""",
)
def rt8(spark, sf_dir):
    from cairnlight.functions.text import render

    t = render("Find evidence in {year} for: {need}", {"year": F.lit(2024), "need": F.col("text")})
    return subqueries(spark, sf_dir).select("query_id", t.alias("query_text"), F.sha2(t, 256).alias("subquery_hash"))


@query(
    "RT9_selection_specs",
    f"""WITH {BM25}, spec AS (SELECT * FROM (VALUES ('global_top_k', 5), ('global_top_k', 10)) s(spec, k))
SELECT spec, k, query_id, count(*) AS n FROM bm JOIN spec ON rank <= k GROUP BY ALL""",
)
def rt9(spark, sf_dir):
    spec = spark.createDataFrame([("global_top_k", 5), ("global_top_k", 10)], "spec string, k int")
    return bm25(spark, sf_dir).join(F.broadcast(spec), F.col("rank") <= F.col("k")).groupBy("spec", "k", "query_id").agg(F.count("*").alias("n"))
