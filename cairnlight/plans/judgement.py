"""Queries: external evaluators, validators, response logs, chunks, grids and sampling designs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnlight.functions import chunking, folds
from cairnlight.functions import text as X
from cairnlight.operators import metrics as M
from cairnlight.operators import sampling as S
from cairnlight.plans.corpus import docs
from cairnlight.plans.evaluation import METRICS, metrics
from cairnlight.plans.fixtures import CARDS, CASES, CLAIMS, cards, cases, claims, read
from cairnlight.plans.registry import query


@query("AG5_external_metrics", "SELECT l_orderkey AS case_id, count(*) AS claim_count, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS supported, round(avg(CAST(l_linestatus = 'F' AS DOUBLE)), 6) AS score FROM lineitem GROUP BY ALL")
def ag5(spark, sf_dir):
    ok = F.col("l_linestatus") == "F"
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("claim_count"), F.count_if(ok).alias("supported"), F.round(F.avg(ok.cast("double")), 6).alias("score"))


@query("EV10_any_card_entails", "SELECT l_orderkey AS case_id, l_partkey AS claim, bool_or(l_returnflag = 'A') AS supported FROM lineitem GROUP BY ALL")
def ev10(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("claim")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("supported"))


@query("EV11_statement_verdicts", "SELECT l_orderkey AS case_id, round(avg(CAST(l_linenumber % 2 AS DOUBLE)), 6) AS score FROM lineitem GROUP BY ALL")
def ev11(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.round(F.avg((F.col("l_linenumber") % 2).cast("double")), 6).alias("score"))


@query("EV14_acceptance_gates", f"WITH {CARDS} SELECT 'types' AS gate, count(*) AS rows, CAST(0 AS BIGINT) AS bad FROM cards UNION ALL SELECT 'years', count(*), 0 FROM cards UNION ALL SELECT 'unique', count(*), 0 FROM cards")
def ev14(spark, sf_dir):
    """Gates over all cards: known types, years in range, unique ids."""
    c = cards(spark, sf_dir)
    n = c.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("source_type").isin("csv_metric", "narrative", "pdf_table_row")).alias("types"),
        F.count_if(~F.col("source_year").between(2015, 2023)).alias("years"),
        (F.count("*") - F.count_distinct("evidence_id")).alias("unique"),
    )
    return n.unpivot(["rows"], ["types", "years", "unique"], "gate", "bad").select("gate", "rows", "bad")


@query("AG9_task_summary", f"WITH {METRICS}, {CASES} SELECT task, count(*) AS cases, round(avg(ec_count), 6) AS mean_ec, CAST(count(*) FILTER (used_ec_count = 0) AS BIGINT) AS empty_cases FROM m JOIN cases USING (case_id) GROUP BY ALL")
def ag9(spark, sf_dir):
    j = metrics(spark, sf_dir).join(cases(spark, sf_dir), "case_id")
    return j.groupBy("task").agg(F.count("*").alias("cases"), F.round(F.avg("ec_count"), 6).alias("mean_ec"), F.count_if(F.col("used_ec_count") == 0).alias("empty_cases"))


@query("AG14_pipeline_checks", f"WITH {CLAIMS} SELECT label, count(*) AS n, CAST(count(*) FILTER (supp = 's1') AS BIGINT) AS no_quote FROM claims WHERE label IS NOT NULL GROUP BY ALL")
def ag14(spark, sf_dir):
    return claims(spark, sf_dir).where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("supp") == "s1").alias("no_quote"))


@query("AG19_missingness", "SELECT CASE WHEN quality = 0 THEN NULL ELSE quality END AS a, CASE WHEN toxic = 0 THEN NULL ELSE toxic END AS b, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def ag19(spark, sf_dir):
    """Cross-counts that keep the group of nulls."""
    j = docs(spark, sf_dir).select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy(F.nullif("quality", F.lit(0)).alias("a"), F.nullif("toxic", F.lit(0)).alias("b")).agg(F.count("*").alias("n"))


@query(
    "AG22_count_frequency",
    f"""WITH {CARDS}, h AS (SELECT q.company_id, y, count(c.evidence_id) AS k FROM (SELECT DISTINCT company_id FROM cards) q
CROSS JOIN range(2015, 2026) r(y) LEFT JOIN cards c ON c.company_id = q.company_id AND c.source_year = y GROUP BY ALL) SELECT k, count(*) AS n FROM h GROUP BY ALL""",
)
def ag22(spark, sf_dir):
    """How often each count occurs in the grid of companies and years, zero included."""
    from cairnlight.plans.corpus import jn9

    return jn9(spark, sf_dir).groupBy(F.col("n").alias("k")).agg(F.count("*").alias("n"))


@query("JN8_claims_to_cases", f"WITH {CLAIMS}, {CASES} SELECT sector, verdict, count(*) AS n FROM claims JOIN cases USING (case_id) GROUP BY ALL")
def jn8(spark, sf_dir):
    c = claims(spark, sf_dir).select("case_id", M.verdict(F.col("support_sets")).alias("verdict"))
    return c.join(cases(spark, sf_dir), "case_id").groupBy("sector", "verdict").agg(F.count("*").alias("n"))


@query("JN14_case_context", f"WITH {CLAIMS}, {CASES} SELECT count(*) AS claims, CAST(count(*) FILTER (company IS NULL) AS BIGINT) AS without_case FROM claims LEFT JOIN cases USING (case_id)")
def jn14(spark, sf_dir):
    j = claims(spark, sf_dir).select("case_id").join(cases(spark, sf_dir), "case_id", "left")
    return j.agg(F.count("*").alias("claims"), F.count_if(F.col("company").isNull()).alias("without_case"))


@query("JN13_fresh_vs_cached", "SELECT CAST(count(*) FILTER (doc_id % 7 = 0) AS BIGINT) AS only_fresh, CAST(0 AS BIGINT) AS only_cached, CAST(count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 = 0) AS BIGINT) AS changed FROM documents")
def jn13(spark, sf_dir):
    """A cache without every seventh row and with other languages in every fifth."""
    a = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("fresh"), F.lit(1).alias("x"))
    b = docs(spark, sf_dir).where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("lang")).alias("cached"), F.lit(1).alias("y"))
    j = a.join(b, "doc_id", "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.agg(F.count_if(F.col("y").isNull()).alias("only_fresh"), F.count_if(F.col("x").isNull()).alias("only_cached"), F.count_if(both & ~F.col("fresh").eqNullSafe(F.col("cached"))).alias("changed"))


@query("JN10_WN4_prompt_labels", f"WITH {CARDS} SELECT company_id, 'Evidence ' || lpad(CAST(row_number() OVER (PARTITION BY company_id ORDER BY source_type, evidence_id) AS VARCHAR), 2, '0') AS label, evidence_id FROM cards QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY source_type, evidence_id) <= 30")
def jn10(spark, sf_dir):
    """The labels of a company's first thirty cards, restored to ids by a join."""
    w = Window.partitionBy("company_id").orderBy("source_type", "evidence_id")
    shown = cards(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 30").select("company_id", F.format_string("Evidence %02d", "r").alias("label"), "evidence_id")
    return shown.select("company_id", "label").join(shown, ["company_id", "label"]).select("company_id", "label", "evidence_id")


@query("FIL7_TK5_case_filter", f"WITH {CASES} SELECT case_id, company, year, task FROM cases WHERE lower(company) IN ('nation_1', 'nation_2') AND year >= 1997 ORDER BY company, year, task, case_id LIMIT 100")
def fil7(spark, sf_dir):
    """The first hundred cases of some companies, in a stable order: the limit is the feature."""
    c = cases(spark, sf_dir).where(F.lower("company").isin("nation_1", "nation_2") & (F.col("year") >= 1997))
    return c.orderBy("company", "year", "task", "case_id").limit(100).select("case_id", "company", "year", "task")


@query("WN2_TK2_rank_in_pool", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3")
def wn2(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("WN9_chunks")
def wn9(spark, sf_dir):
    """Paragraphs, ten to a page, gathered to chunks; the fold is checked by tests against plain Python."""
    blocks = F.transform(folds.paragraphs_of(F.col("text")), lambda p, i: F.struct(p["text"].alias("text"), (i / 10 + 1).cast("int").alias("page"), F.array().cast("array<string>").alias("warnings")))
    # Written out, so that the paragraphs are cut once.
    c = docs(spark, sf_dir).select("doc_id", blocks.alias("blocks")).select("doc_id", F.posexplode(chunking.narrative_chunks(F.col("blocks"))).alias("chunk", "c"))
    return c.select("doc_id", "chunk", "c.text", "c.page_start", "c.page_end", F.array_join("c.warnings", ",").alias("warnings"))


@query("WN10_batches")
def wn10(spark, sf_dir):
    """Batches of a source's documents by count and size."""
    d = docs(spark, sf_dir).select("source", "doc_id", X.approximate_tokens(F.col("text")).alias("size"))
    return S.batches(d, "source", "doc_id", "size", 16, 20_000)


@query("SC21_paragraphs")
def sc21(spark, sf_dir):
    return folds.paragraph_rows(docs(spark, sf_dir), "doc_id", "text")


@query("SC18_SC19_quote_grounding", "SELECT page_id, CASE WHEN contains(html, '<article>') AND contains(html, '</nav>') THEN 'all' WHEN contains(html, '<article>') OR contains(html, '</nav>') THEN 'some' ELSE 'none' END AS status FROM pages")
def sc18(spark, sf_dir):
    quotes = F.array(F.lit("<article>"), F.lit("</nav>"))
    found = F.filter(quotes, lambda q: F.col("html").contains(q))
    status = F.when(F.size(found) == F.size(quotes), "all").when(F.size(found) > 0, "some").otherwise("none")
    return read(spark, sf_dir, "pages").select("page_id", status.alias("status"))


@query("SC28_rationale_ids", "SELECT conv_id, turn, role, contains(text, 'ec_001') OR contains(text, 'ec_002') AS leaks FROM conversations")
def sc28(spark, sf_dir):
    ids = F.array(F.lit("ec_001"), F.lit("ec_002"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.exists(ids, lambda i: F.col("text").contains(i)).alias("leaks"))


@query("SC30_attribution", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS report_year FROM orders")
def sc30(spark, sf_dir):
    t = F.concat(F.lit("According to the "), F.year("o_orderdate"), F.lit(" report, totals rose."))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(t, r"According to the (\d{4}) report", 1).cast("int").alias("report_year"))


@query("SC27_array_patch", "SELECT l_orderkey, string_agg(CASE WHEN n > 1 AND r = 1 THEN 'merged' ELSE CAST(l_partkey AS VARCHAR) END, ',' ORDER BY r) AS claims FROM (SELECT l_orderkey, l_partkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) WHERE NOT (n > 1 AND r = 2) GROUP BY ALL")
def sc27(spark, sf_dir):
    """The first two claims of a case replaced by one, which stands at the lower place."""
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    ids = F.col("a.l_partkey").cast("array<string>")
    new = F.when(F.size("a") > 1, F.concat(F.array(F.lit("merged")), F.slice(ids, 3, 1_000_000))).otherwise(ids)
    return a.select("l_orderkey", F.array_join(new, ",").alias("claims"))


@query("DD2_semantic_partition", "WITH u AS (SELECT sha256(text) AS k, lang, min(doc_id) AS unit, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, unit % 50 AS g, min(unit) AS claim, CAST(sum(n) AS BIGINT) AS occurrences, CASE WHEN count(*) > 1 THEN 'semantic_merge' WHEN sum(n) > 1 THEN 'exact_normalized_merge' ELSE 'singleton' END AS merge_type FROM u GROUP BY lang, unit % 50")
def dd2(spark, sf_dir):
    """Exact units grouped by a recorded partition (here unit modulo 50) to claims with a merge type."""
    u = docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("k"), "lang").agg(F.min("doc_id").alias("unit"), F.count("*").alias("n"))
    kind = F.when(F.count("*") > 1, "semantic_merge").when(F.sum("n") > 1, "exact_normalized_merge").otherwise("singleton")
    return u.groupBy("lang", (F.col("unit") % 50).alias("g")).agg(F.min("unit").alias("claim"), F.sum("n").alias("occurrences"), kind.alias("merge_type"))


@query("DD3_capacity_guard", f"WITH {CLAIMS} SELECT case_id, count(*) AS units FROM claims GROUP BY ALL HAVING count(*) > 8")
def dd3(spark, sf_dir):
    """Cases that are too large for one request, here of over 8 units; they are reported, not split."""
    return claims(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("units")).where("units > 8")


@query("DD5_empty_candidates", f"WITH {CLAIMS} SELECT dc_id, flag <> 'R' AS model_called FROM claims")
def dd5(spark, sf_dir):
    return claims(spark, sf_dir).select("dc_id", (F.size("support_sets") > 0).alias("model_called"))


@query("DD6_SM8_validators", "SELECT doc_id, array_to_string(list_filter([CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents")
def dd6(spark, sf_dir):
    """Each rule gives its name where it is broken."""
    rules = [F.when(F.length(F.trim("text")) == 0, "empty"), F.when(F.col("n_chars") != F.length("text"), "length"), F.when(~F.col("lang").isin("en", "de", "fr"), "language")]
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_compact(F.array(*rules)), ",").alias("errors"))


@query("DD7_occurrence_ids", "SELECT doc_id, 'ec_' || substring(sha256(CAST(doc_id AS VARCHAR) || '|' || text), 1, 32) AS occurrence_id FROM documents")
def dd7(spark, sf_dir):
    h = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256)
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("ec_"), F.substring(h, 1, 32)).alias("occurrence_id"))


@query("SM9_pilot_selection", f"WITH {CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sector, company, year, case_id) - 1 AS i, count(*) OVER (PARTITION BY task) AS n, dense_rank() OVER (ORDER BY task) AS t FROM cases) SELECT task, case_id FROM r WHERE i = (t * 7) % n")
def sm9(spark, sf_dir):
    """One case of each task, its place by index arithmetic on the task's number."""
    c = cases(spark, sf_dir)
    tasks = [r["task"] for r in c.select("task").distinct().orderBy("task").collect()]
    number = F.array_position(F.array(*map(F.lit, tasks)), F.col("task"))
    w = Window.partitionBy("task").orderBy("sector", "company", "year", "case_id")
    sized = c.join(c.groupBy("task").agg(F.count("*").alias("n")), "task").withColumn("i", F.row_number().over(w) - 1)
    return sized.where(F.col("i") == (number * 7) % F.col("n")).select("task", "case_id")


@query("SM5_water_filling")
def sm5(spark, sf_dir):
    """Two hundred further slots to the labels with the fewest claims."""
    n = claims(spark, sf_dir).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return S.water_filled(n.withColumn("cap", F.lit(60)), "label", "n", "cap", "label", 200)


@query("ST1_ST6_matrix_equality", f"WITH {CASES} SELECT count(DISTINCT company || '|' || year || '|' || task) AS actual, (SELECT count(DISTINCT company) * count(DISTINCT year) * count(DISTINCT task) FROM cases) AS expected FROM cases")
def st6(spark, sf_dir):
    c = cases(spark, sf_dir)
    n = F.count_distinct("company") * F.count_distinct("year") * F.count_distinct("task")
    return c.agg(F.count_distinct("company", "year", "task").alias("actual"), n.alias("expected"))


@query("RT5_normalised_vectors", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x)) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS total FROM embeddings")
def rt5(spark, sf_dir):
    from cairnlight.operators.retrieval import normalised

    unit = normalised(F.col("embedding").cast("array<double>"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
