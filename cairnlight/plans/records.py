"""Queries: titles, query bundles, jobs and occurrences by content, diagnostics and result records, comparisons with faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.operators import metrics as M
from cairnlight.operators import records as D
from cairnlight.operators import retrieval as R
from cairnlight.plans.corpus import docs
from cairnlight.plans.evaluation import METRICS, metrics
from cairnlight.plans.evidence import order_claims
from cairnlight.plans.fixtures import CARDS, CASES, CLAIMS, TYPES, cards, cases, claims, read
from cairnlight.plans.registry import query
from cairnlight.plans.retrieval import BM25, DENSE, FUSED, PER, bm25, dense, fuse

# Titles and bundles -------------------------------------------------------------------------------------------------

_DEFAULTS = {"T_7": "Water"}


@query(
    "PRJ5_task_titles",
    """WITH t AS (SELECT p_partkey, 'T_' || (p_partkey % 9) AS id, CASE p_partkey % 4 WHEN 0 THEN ' E1-' || p_size WHEN 1 THEN 'E1' WHEN 2 THEN '' END AS ref,
  CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '  ' END AS title, CASE WHEN p_partkey % 5 < 2 THEN 'e1 rules' END AS name FROM part),
c AS (SELECT p_partkey, id, nullif(trim(coalesce(ref, '')), '') AS ref, coalesce(nullif(trim(coalesce(title, '')), ''), name) AS n FROM t)
SELECT p_partkey, CASE WHEN ref IS NOT NULL AND n IS NOT NULL THEN CASE WHEN starts_with(lower(n), lower(ref)) THEN n ELSE ref || ' ' || n END WHEN n IS NOT NULL THEN n WHEN ref IS NOT NULL THEN ref
  WHEN id = 'T_7' THEN 'Water' ELSE replace(id, '_', ' ') END AS title FROM c""",
)
def prj5(spark, sf_dir):
    """Every step of the cascade: reference and name, one of them, a default title, the id."""
    k = F.col("p_partkey")
    ref = F.when(k % 4 == 0, F.concat(F.lit(" E1-"), "p_size")).when(k % 4 == 1, "E1").when(k % 4 == 2, "")
    title = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "  ")
    name = F.when(k % 5 < 2, "e1 rules")
    return read(spark, sf_dir, "part").select("p_partkey", D.task_title(F.concat(F.lit("T_"), k % 9), ref, [title, name], _DEFAULTS).alias("title"))


_TEMPLATES = [("T00", 1, "b", None, "Totals of {company} in {year}"), ("T00", 2, "a", "trend", "{company}: {sector}, {unknown}"), ("T05", 1, "a", "", "Risks"), ("default", 1, "a", "any", "{company} {year}")]


@query(
    "RT8_query_bundles",
    f"""WITH {CASES}, t AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {p}, '{s}', '{n or ''}', '{x}')" for t, p, s, n, x in _TEMPLATES)}) v(tid, place, sid, need, template)),
q AS (SELECT case_id, task, place, sid, need, replace(replace(replace(template, '{{company}}', company), '{{year}}', CAST(year AS VARCHAR)), '{{sector}}', sector) AS q
  FROM cases JOIN t ON tid = CASE WHEN task IN ('T00', 'T05') THEN task ELSE 'default' END),
b AS (SELECT case_id, task, count(*) AS n, string_agg('{{"evidence_need": "' || need || '", "query_text": "' || q || '", "subquery_hash": "' || sha256(q) || '", "subquery_id": "' || sid || '"}}', ', ' ORDER BY place) AS s FROM q GROUP BY ALL)
SELECT case_id, n AS subqueries, sha256('{{"case_id": ' || case_id || ', "query_bundle_id": "' || case_id || '__query_bundle_v1", "subqueries": [' || s || '], "task_id": "' || task || '"}}') AS query_bundle_hash FROM b""",
)
def rt8_bundles(spark, sf_dir):
    """Templates of the task or the default ones, filled from the case, with the hash of the whole bundle."""
    t = spark.createDataFrame(_TEMPLATES, "task_id string, place int, subquery_id string, evidence_need string, template string")
    b = D.query_bundles(cases(spark, sf_dir).withColumnRenamed("task", "task_id"), t, ["company", "year", "sector"])
    return b.select("case_id", F.size("subqueries").cast("long").alias("subqueries"), "query_bundle_hash")


# Jobs and occurrences -------------------------------------------------------------------------------------------------

_SETTINGS = {"prompt_version": "v3", "prompt_sha256": "p", "schema_version": "s1", "schema_sha256": "s", "model_key": "m", "deployment_name": "d", "request_parameters": "{}"}


@query(
    "DD4_jobs",
    """WITH j AS (SELECT doc_id, sha256('{"dynamic_input":{"disclosure_text":' || CAST(to_json(text) AS VARCHAR) || ',"lang":' || CAST(to_json(lang) AS VARCHAR) || '},"generation_output_id":' || doc_id || '}') AS h FROM documents)
SELECT doc_id, h AS job_input_hash, 'dc_extract_' || substring(sha256('{"deployment_name":"d","job_input_hash":"' || h || '","model_key":"m","prompt_sha256":"p","prompt_version":"v3","request_parameters":"{}","schema_sha256":"s","schema_version":"s1","task":"dc"}'), 1, 32) AS call_id FROM j""",
)
def dd4(spark, sf_dir):
    """One extraction job for every document, with ids that hold for equal calls only."""
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("disclosure_text"), "lang")
    return D.jobs(d, "dc", ["disclosure_text", "lang"], "doc_id", _SETTINGS).select("doc_id", "job_input_hash", "call_id")


@query(
    "DD7_claim_occurrences",
    """WITH c AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, 'The order has "part ' || l_partkey || '" of supplier ' || l_suppkey || '.' AS t FROM lineitem)
SELECT case_id, CAST(i AS INTEGER) AS claim_index, 'dco_' || substring(sha256('{"claim_index":' || i || ',"claim_text":' || CAST(to_json(t) AS VARCHAR) || ',"generation_case_id":' || case_id || '}'), 1, 32) AS occurrence_id FROM c""",
)
def dd7_occurrences(spark, sf_dir):
    """Claims in the order of their source, each with an id of its case, place and text."""
    c = order_claims(spark, sf_dir).select(F.col("case_id").alias("generation_case_id"), F.posexplode("claims").alias("claim_index", "c"))
    c = c.select("generation_case_id", "claim_index", F.col("c.claim_text").alias("claim_text"))
    return D.with_digest(c, "occurrence_id", ["generation_case_id", "claim_index", "claim_text"], "dco").select(F.col("generation_case_id").alias("case_id"), "claim_index", "occurrence_id")


# Results ----------------------------------------------------------------------------------------------------------


def _sums(ids, scores):
    return F.array_join(ids, ",").alias(ids), F.round(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x), 4).alias(scores)


@query(
    "RT10_scored_diagnostics",
    f"""WITH {BM25}{DENSE}, b AS (SELECT query_id, company_id, string_agg(evidence_id, ',' ORDER BY rank) AS bm25_ids, round(sum(score), 4) AS bm25_scores FROM bm WHERE rank <= 5 GROUP BY ALL),
d AS (SELECT query_id, company_id, string_agg(evidence_id, ',' ORDER BY rank) AS dense_ids, round(sum(score), 4) AS dense_scores FROM dense WHERE rank <= 3 GROUP BY ALL)
SELECT query_id, company_id, coalesce(bm25_ids, '') AS bm25_ids, coalesce(bm25_scores, 0) AS bm25_scores, coalesce(dense_ids, '') AS dense_ids, coalesce(dense_scores, 0) AS dense_scores FROM b FULL JOIN d USING (query_id, company_id)""",
)
def rt10_scored(spark, sf_dir):
    """The first ids of both lists with their scores (summed here), empty where a query or pool is in one list only."""
    d = D.diagnostics({"bm25": bm25(spark, sf_dir), "dense": dense(spark, sf_dir)}, ["query_id", "company_id"], {"bm25": 5, "dense": 3})
    return d.select("query_id", "company_id", *_sums("bm25_ids", "bm25_scores"), *_sums("dense_ids", "dense_scores"))


@query(
    "RT11_result_records",
    f"""WITH {BM25}{DENSE}{FUSED}, st AS (SELECT f.*, c.source_type, c.source_year, c.text, row_number() OVER (PARTITION BY query_id, f.company_id, source_type ORDER BY rank) AS sr FROM fused f JOIN cards c USING (evidence_id) QUALIFY sr <= {PER}),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, company_id ORDER BY source_type, rank) AS prompt_rank FROM st)
SELECT query_id, company_id, string_agg(evidence_id, ',' ORDER BY prompt_rank) AS ids, string_agg(rank, ',' ORDER BY prompt_rank) AS final_ranks, {", ".join(f"CAST(count(*) FILTER (source_type = '{t}') AS INTEGER) AS n_{t}" for t in TYPES)},
  count(DISTINCT source_year) AS years, CAST(sum(length(text)) AS BIGINT) AS chars FROM p GROUP BY ALL""",
)
def rt11(spark, sf_dir):
    """Records of the stratified selection of each query and company, with distributions and cards."""
    c = cards(spark, sf_dir)
    chosen = R.stratified(fuse(spark, sf_dir).join(c.select("evidence_id", "source_type"), "evidence_id"), ["query_id", "company_id"], "source_type", PER).drop("source_type")
    r = D.result_records(chosen, c, ["query_id", "company_id"])
    chars = F.aggregate("retrieved_cards", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    return r.select(
        "query_id",
        "company_id",
        F.array_join("retrieved_evidence_ids", ",").alias("ids"),
        F.array_join(F.transform("ranks", lambda x: x["final_rank"].cast("string")), ",").alias("final_ranks"),
        *(F.coalesce(F.try_element_at("evidence_type_distribution", F.lit(t)), F.lit(0)).alias(f"n_{t}") for t in TYPES),
        F.size("source_year_distribution").cast("long").alias("years"),
        chars.alias("chars"),
    )


# Comparisons with faults --------------------------------------------------------------------------------------------


@query("EV7_paired_difference")
def ev7(spark, sf_dir):
    """Mean difference of two scores by case, with an interval over resampled companies; tests compare it with numpy."""
    m = metrics(spark, sf_dir).join(cases(spark, sf_dir).select("case_id", "company"), "case_id")
    mean, low, high = M.paired_difference(m, "company", "support_rate", "eccr")
    return spark.createDataFrame([(mean, low, high)], "mean double, low double, high double")


@query(
    "EV11_aligned_verdicts",
    """WITH s AS (SELECT l_orderkey AS case_id, count(*) AS n, sum(CAST(l_returnflag = 'A' AS INTEGER)) AS ok, arg_max(CAST(l_returnflag = 'A' AS INTEGER), l_linenumber * 1000000000 + l_partkey * 1000 + l_suppkey) AS last FROM lineitem GROUP BY ALL)
SELECT case_id, CASE WHEN case_id % 7 <> 3 THEN round(ok / n, 6) END AS score, CASE WHEN case_id % 7 = 3 THEN n || ' statements, ' || (n - 1) || ' verdicts' END AS error FROM s""",
)
def ev11_aligned(spark, sf_dir):
    """Mean verdict of the statements of a case, an error where the lists differ in length, as in every seventh case here."""
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "A").alias("ok")))).alias("a"))  # noqa: E741
    verdicts = F.when(F.col("case_id") % 7 == 3, F.slice("a.ok", F.lit(1), F.size("a") - 1)).otherwise(F.col("a.ok"))
    score, error = M.aligned_score(F.col("a.l_linenumber"), verdicts)
    return l.select("case_id", F.round(score, 6).alias("score"), error.alias("error"))


@query("EV12_recompute_faults", f"WITH {METRICS} SELECT count(*) AS compared, CAST(count(*) FILTER (case_id % 97 = 5) AS BIGINT) AS different FROM m")
def ev12_faults(spark, sf_dir):
    """Stored rates, some of them changed, against rates from the flat lines within 1e-12."""
    stored = F.col("support_rate") + F.when(F.col("case_id") % 97 == 5, 1e-9).otherwise(0.0)
    a = metrics(spark, sf_dir).select("case_id", stored.alias("stored"))
    b = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.avg((F.col("l_returnflag") != "R").cast("double")).alias("again"))
    return a.join(b, "case_id").agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("stored") - F.col("again")) > 1e-12).alias("different"))


@query(
    "EV14_gate_faults",
    """WITH c AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 17 = 4),
n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 11 = 2) AS types, count(*) FILTER (doc_id % 13 = 6 OR doc_id % 29 = 1) AS years, count(*) - count(DISTINCT doc_id) AS dup FROM c)
SELECT gate, n AS rows, CAST(bad AS BIGINT) AS bad, bad = 0 AS passed FROM n, LATERAL (VALUES ('types', types), ('years', years), ('unique', dup), ('texts', 0)) g(gate, bad)""",
)
def ev14_faults(spark, sf_dir):
    """Gates over cards of which some have an unknown type, a year out of range or none, or an id twice."""
    c = cards(spark, sf_dir)
    c = c.unionByName(c.where(F.col("doc_id") % 17 == 4))
    year = F.when(F.col("doc_id") % 29 == 1, None).when(F.col("doc_id") % 13 == 6, 1999).otherwise(F.col("source_year"))
    c = c.select("evidence_id", F.when(F.col("doc_id") % 11 == 2, "figure").otherwise(F.col("source_type")).alias("source_type"), year.alias("source_year"), "text")
    n = c.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce(F.col("source_type").isin(*TYPES), F.lit(False))).alias("types"),
        F.count_if(~F.coalesce(F.col("source_year").between(2015, 2023), F.lit(False))).alias("years"),
        (F.count("*") - F.count_distinct("evidence_id")).alias("unique"),
        F.count_if(F.col("text").isNull()).alias("texts"),
    )
    return n.unpivot(["rows"], ["types", "years", "unique", "texts"], "gate", "bad").select("gate", "rows", "bad", (F.col("bad") == 0).alias("passed"))


@query(
    "JN6_key_faults",
    f"""WITH {CLAIMS}, a AS (SELECT DISTINCT dc_id FROM claims WHERE flag = 'R'),
b AS (SELECT DISTINCT dc_id FROM claims WHERE flag = 'R' AND case_id % 5 <> 1 OR flag = 'A' AND case_id % 9 = 2)
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (dc_id)) AS matched, (SELECT count(*) FROM a ANTI JOIN b USING (dc_id)) AS only_left, (SELECT count(*) FROM b ANTI JOIN a USING (dc_id)) AS only_right""",
)
def jn6_faults(spark, sf_dir):
    """Unsupported claims against diagnoses, of which some are missing and some belong to supported claims."""
    c = claims(spark, sf_dir).select("case_id", "dc_id", (F.size("support_sets") == 0).alias("open"), F.exists("support_sets", lambda s: s["support_type"] == "direct").alias("direct"))
    a = c.where("open").select(F.col("dc_id").alias("a")).distinct()
    b = c.where((F.col("open") & (F.col("case_id") % 5 != 1)) | (F.col("direct") & (F.col("case_id") % 9 == 2))).select(F.col("dc_id").alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


_CARD = ("company_id", "source_year", "source_type")


@query(
    "JN13_fresh_and_cached",
    f"""WITH {CARDS}, f AS (SELECT * FROM cards WHERE doc_id % 6 <> 1), c AS (SELECT evidence_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE company_id END AS company_id, CASE WHEN doc_id % 10 = 4 THEN 2000 ELSE source_year END AS source_year, source_type FROM cards WHERE doc_id % 7 <> 2)
SELECT CAST(count(*) FILTER (c.evidence_id IS NULL) AS BIGINT) AS only_fresh, CAST(count(*) FILTER (f.evidence_id IS NULL) AS BIGINT) AS only_cached,
  {", ".join(f"CAST(count(*) FILTER (f.evidence_id IS NOT NULL AND c.evidence_id IS NOT NULL AND f.{x} IS DISTINCT FROM c.{x}) AS BIGINT) AS {x}" for x in _CARD)} FROM f FULL JOIN c USING (evidence_id)""",
)
def jn13_both(spark, sf_dir):
    """Fresh against cached cards: those of one side, and by column how many differ, nulls counted as values."""
    c = cards(spark, sf_dir)
    old = c.where("doc_id % 7 <> 2").select("evidence_id", F.when(F.col("doc_id") % 10 == 3, None).otherwise(F.col("company_id")).alias("company_id"), F.when(F.col("doc_id") % 10 == 4, 2000).otherwise(F.col("source_year")).alias("source_year"), "source_type")
    return M.table_difference(c.where("doc_id % 6 <> 1").select("evidence_id", *_CARD), old, "evidence_id", "fresh", "cached")
