"""Queries: verdicts, case metrics, group summaries, distributions, agreement and rank statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.operators import metrics as M
from cairnlight.plans.fixtures import CASES, CLAIMS, ECS, LABELS, cases, claims, inventory, read
from cairnlight.plans.registry import query

RATES = ("support_rate", "sensitivity_rate", "eccr", "inference_rate")

_COUNTS = ", ".join(f"CAST(count(*) FILTER (label = '{x}') AS BIGINT) AS {x}" for x in LABELS)
METRICS = f"""{CLAIMS}, {ECS},
per AS (SELECT case_id, count(*) AS dc_count, CAST(count(*) FILTER (verdict = 'direct') AS BIGINT) AS supported_direct,
  CAST(count(*) FILTER (verdict = 'inferred') AS BIGINT) AS supported_inferred, CAST(count(*) FILTER (verdict = 'unsupported') AS BIGINT) AS unsupported,
  CAST(count(*) FILTER (verdict = 'inferred') AS BIGINT) AS multi_ec_required, {_COUNTS} FROM claims GROUP BY ALL),
edge AS (SELECT case_id, dc_id, part AS ec_id, verdict FROM claims WHERE flag <> 'R' UNION ALL SELECT case_id, dc_id, supp, verdict FROM claims WHERE flag = 'N'),
used AS (SELECT case_id, count(DISTINCT ec_id) AS u FROM edge GROUP BY ALL),
tot AS (SELECT case_id, count(*) AS ec_count FROM ecs GROUP BY ALL),
m AS (SELECT per.*, ec_count, coalesce(u, 0) AS used_ec_count,
  CAST(supported_direct + supported_inferred AS DOUBLE) / dc_count AS support_rate,
  CAST(supported_direct + supported_inferred AS DOUBLE) / nullif(dc_count - non_disclosure_statement, 0) AS sensitivity_rate,
  CAST(coalesce(u, 0) AS DOUBLE) / ec_count AS eccr,
  CAST(supported_inferred AS DOUBLE) / nullif(supported_direct + supported_inferred, 0) AS inference_rate
  FROM per JOIN tot USING (case_id) LEFT JOIN used USING (case_id))"""
_ROUND = ", ".join(f"round({x}, 6) AS {x}" for x in RATES)


def metrics(spark, sf_dir) -> DataFrame:
    c = claims(spark, sf_dir)
    return M.case_metrics(c, inventory(c), LABELS)


def joined(spark, sf_dir) -> DataFrame:
    return metrics(spark, sf_dir).join(cases(spark, sf_dir), "case_id")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("AG4_case_metrics", f"WITH {METRICS} SELECT * EXCLUDE ({', '.join(RATES)}), {_ROUND} FROM m")
def ag4(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return m.select(*(c for c in m.columns if c not in RATES), *r6(*RATES))


@query("EV1_verdict", f"WITH {CLAIMS} SELECT dc_id, verdict FROM claims")
def ev1(spark, sf_dir):
    return claims(spark, sf_dir).select("dc_id", M.verdict(F.col("support_sets")).alias("verdict"))


@query("EV2_SC32_rates", f"WITH {METRICS} SELECT case_id, {_ROUND} FROM m")
def ev2(spark, sf_dir):
    return metrics(spark, sf_dir).select("case_id", *r6(*RATES))


@query("EV3_multi_required", f"WITH {CLAIMS} SELECT dc_id, flag = 'N' AS multi_required FROM claims")
def ev3(spark, sf_dir):
    return claims(spark, sf_dir).select("dc_id", M.multi_required(F.col("support_sets")).alias("multi_required"))


@query(
    "EV4_reuse_concentration",
    f"""WITH {METRICS}, deg AS (SELECT case_id, ec_id, count(DISTINCT dc_id) AS d FROM edge GROUP BY ALL), t AS (SELECT case_id, sum(d) AS s FROM deg GROUP BY ALL)
SELECT case_id, max(d) AS max_degree, round(CAST(count(*) FILTER (d > 1) AS DOUBLE) / count(*), 6) AS reuse_rate, round(sum((d / s) * (d / s)), 6) AS hhi
FROM deg JOIN t USING (case_id) GROUP BY ALL""",
)
def ev4(spark, sf_dir):
    """Degree of each used card, share of cards used by several claims, and concentration of the edges."""
    deg = M.edges(claims(spark, sf_dir)).groupBy("case_id", "ec_id").agg(F.count_distinct("dc_id").alias("d"))
    s = F.sum("d")
    # sum((d / s)^2) = sum(d^2) / s^2: one aggregation.
    return deg.groupBy("case_id").agg(
        F.max("d").alias("max_degree"), F.round(F.count_if(F.col("d") > 1) / F.count("*"), 6).alias("reuse_rate"), F.round(F.sum(F.col("d") * F.col("d")) / (s * s), 6).alias("hhi")
    )


@query(
    "AG12_EV5_label_composition",
    f"""WITH {METRICS}, l AS (SELECT label, count(*) AS n, count(DISTINCT case_id) AS cases FROM claims WHERE label IS NOT NULL GROUP BY ALL)
SELECT label, n, round(100.0 * n / (SELECT count(*) FROM claims), 6) AS of_all, round(100.0 * n / (SELECT count(*) FROM claims WHERE label IS NOT NULL), 6) AS of_unsupported,
round(100.0 * cases / (SELECT count(DISTINCT case_id) FROM claims), 6) AS of_cases FROM l""",
)
def ag12(spark, sf_dir):
    c = claims(spark, sf_dir)
    whole = c.agg(F.count("*").alias("a"), F.count("label").alias("u"), F.count_distinct("case_id").alias("k"))
    own = c.where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))
    return own.crossJoin(F.broadcast(whole)).select(
        "label", "n", *(F.round(100.0 * F.col(x) / F.col(y), 6).alias(z) for x, y, z in (("n", "a", "of_all"), ("n", "u", "of_unsupported"), ("cases", "k", "of_cases")))
    )


_DIMS = ["sector", "task", "year"]
_UNION = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS member, count(*) AS n, {', '.join(f'round(avg({x}), 6) AS {x}' for x in RATES)} FROM j GROUP BY {d}" for d in _DIMS
)


@query("AG6_group_summary", f"WITH {METRICS}, {CASES}, j AS (SELECT * FROM m JOIN cases USING (case_id)) {_UNION}")
def ag6(spark, sf_dir):
    return M.stacked_means(joined(spark, sf_dir), _DIMS, list(RATES)).select("dimension", "member", "n", *r6(*RATES))


@query(
    "AG7_macro_micro",
    f"""WITH {METRICS}, {CASES} SELECT task, round(avg(support_rate), 6) AS macro, round(CAST(sum(supported_direct + supported_inferred) AS DOUBLE) / sum(dc_count), 6) AS micro
FROM m JOIN cases USING (case_id) GROUP BY ALL""",
)
def ag7(spark, sf_dir):
    n = F.sum(F.col("supported_direct") + F.col("supported_inferred"))
    return joined(spark, sf_dir).groupBy("task").agg(F.round(F.avg("support_rate"), 6).alias("macro"), F.round(M.ratio(n, F.sum("dc_count")), 6).alias("micro"))


_CROSS = ", ".join(f"('{x}')" for x in LABELS)


@query(
    "AG13_task_label_crosstab",
    f"""WITH {CLAIMS}, {CASES}, x AS (SELECT task, label, count(*) AS n FROM claims JOIN cases USING (case_id) WHERE label IS NOT NULL GROUP BY ALL),
grid AS (SELECT task, l.label FROM (SELECT DISTINCT task FROM x) CROSS JOIN (VALUES {_CROSS}) l(label))
SELECT grid.task, grid.label, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY grid.task), 6) AS share FROM grid LEFT JOIN x USING (task, label)""",
)
def ag13(spark, sf_dir):
    c = claims(spark, sf_dir).where("label is not null").select("case_id", "label").join(cases(spark, sf_dir), "case_id")
    wide = c.groupBy("task").pivot("label", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(x) for x in LABELS), F.lit(0))
    shares = wide.select("task", *((F.col(x) / total).alias(x) for x in LABELS))
    return shares.unpivot("task", list(LABELS), "label", "share").withColumn("share", F.round("share", 6))


@query(
    "AG27_dominant_label",
    f"""WITH {CLAIMS}, {CASES}, x AS (SELECT task, label, count(*) AS n FROM claims JOIN cases USING (case_id) WHERE label IS NOT NULL GROUP BY ALL)
SELECT task, label, n, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY task) AS BIGINT) AS total FROM x)
QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC, label) = 1""",
)
def ag27(spark, sf_dir):
    c = claims(spark, sf_dir).where("label is not null").select("case_id", "label").join(cases(spark, sf_dir), "case_id")
    x = c.groupBy("task", "label").agg(F.count("*").alias("n"))
    best = x.groupBy("task").agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("b"), F.sum("n").alias("total"))
    return best.select("task", F.col("b.label").alias("label"), (-F.col("b.k")).alias("n"), "total")


@query(
    "AG15_company_year_heatmap",
    f"""WITH {METRICS}, {CASES} SELECT company, year, count(*) AS n, round(avg(support_rate), 6) AS support_rate FROM m JOIN cases USING (case_id) GROUP BY ALL""",
)
def ag15(spark, sf_dir):
    return joined(spark, sf_dir).groupBy("company", "year").agg(F.count("*").alias("n"), F.round(F.avg("support_rate"), 6).alias("support_rate"))


@query(
    "AG26_two_level_mean",
    f"""WITH {METRICS}, {CASES}, y AS (SELECT company, year, avg(support_rate) AS v FROM m JOIN cases USING (case_id) GROUP BY ALL),
c AS (SELECT company, avg(v) AS mean, max(v) - min(v) AS spread FROM y GROUP BY ALL) SELECT company, round(mean, 6) AS mean, round(spread, 6) AS spread FROM c""",
)
def ag26(spark, sf_dir):
    y = joined(spark, sf_dir).groupBy("company", "year").agg(F.avg("support_rate").alias("v"))
    return y.groupBy("company").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v") - F.min("v"), 6).alias("spread"))


@query(
    "WN12_year_difference",
    f"""WITH {METRICS}, {CASES}, y AS (SELECT company, year, avg(support_rate) AS v FROM m JOIN cases USING (case_id) GROUP BY ALL)
SELECT company, year, round(v - lag(v) OVER (PARTITION BY company ORDER BY year), 6) AS diff FROM y""",
)
def wn12(spark, sf_dir):
    y = joined(spark, sf_dir).groupBy("company", "year").agg(F.avg("support_rate").alias("v"))
    return y.select("company", "year", F.round(F.col("v") - F.lag("v").over(Window.partitionBy("company").orderBy("year")), 6).alias("diff"))


@query("AG16_stage_completeness", f"WITH {METRICS} SELECT 'inference' AS stage, count(inference_rate) AS completed, count(*) AS planned FROM m UNION ALL SELECT 'sensitivity', count(sensitivity_rate), count(*) FROM m UNION ALL SELECT 'support', count(support_rate), count(*) FROM m")
def ag16(spark, sf_dir):
    flags = metrics(spark, sf_dir).select(*(F.col(f"{x}_rate").isNotNull().alias(x) for x in ("inference", "sensitivity", "support")))
    return flags.unpivot([], ["inference", "sensitivity", "support"], "stage", "ok").groupBy("stage").agg(F.count_if("ok").alias("completed"), F.count("*").alias("planned"))


@query("AG21_median", f"WITH {METRICS} SELECT round(median(dc_count), 6) AS median_claims, round(median(support_rate), 6) AS median_rate, max(dc_count) AS most FROM m")
def ag21(spark, sf_dir):
    return metrics(spark, sf_dir).agg(F.round(F.median("dc_count"), 6).alias("median_claims"), F.round(F.median("support_rate"), 6).alias("median_rate"), F.max("dc_count").alias("most"))


@query(
    "AG24_histogram",
    f"WITH {METRICS} SELECT CAST(least(floor(round(support_rate * 20, 9)), 19) AS INTEGER) AS bin, count(*) AS n FROM m GROUP BY ALL",
)
def ag24(spark, sf_dir):
    b = F.least(F.floor(F.round(F.col("support_rate") * 20, 9)), F.lit(19)).cast("int")
    return metrics(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query(
    "AG25_quartile_span",
    f"""WITH {METRICS} SELECT round(quantile_cont(support_rate, 0.75) - quantile_cont(support_rate, 0.25), 6) AS span, round(quantile_cont(support_rate, 0.1), 6) AS p10,
round(quantile_cont(support_rate, 0.9), 6) AS p90, CAST(count(*) FILTER (support_rate >= 1) AS BIGINT) AS full_support, CAST(count(*) FILTER (support_rate <= 0.25) AS BIGINT) AS low FROM m""",
)
def ag25(spark, sf_dir):
    p = lambda q: F.percentile("support_rate", F.lit(q))
    return metrics(spark, sf_dir).agg(
        F.round(p(0.75) - p(0.25), 6).alias("span"), F.round(p(0.1), 6).alias("p10"), F.round(p(0.9), 6).alias("p90"),
        F.count_if(F.col("support_rate") >= 1).alias("full_support"), F.count_if(F.col("support_rate") <= 0.25).alias("low"),
    )


@query(
    "AG28_EV7_pair_counts",
    f"""WITH {METRICS} SELECT CAST(count(*) FILTER (support_rate > eccr) AS BIGINT) AS above, CAST(count(*) FILTER (support_rate < eccr) AS BIGINT) AS below,
CAST(count(*) FILTER (support_rate = eccr) AS BIGINT) AS tied, CAST(count(*) FILTER (abs(support_rate - eccr) <= 0.05) AS BIGINT) AS near, round(avg(support_rate - eccr), 6) AS mean_difference FROM m""",
)
def ag28(spark, sf_dir):
    x, y = F.col("support_rate"), F.col("eccr")
    return metrics(spark, sf_dir).agg(
        F.count_if(x > y).alias("above"), F.count_if(x < y).alias("below"), F.count_if(x == y).alias("tied"), F.count_if(F.abs(x - y) <= 0.05).alias("near"),
        F.round(F.avg(x - y), 6).alias("mean_difference"),
    )


@query(
    "EV8_spearman",
    f"""WITH {METRICS}, {CASES}, j AS (SELECT sector, support_rate AS x, eccr AS y FROM m JOIN cases USING (case_id)),
r AS (SELECT sector, rank() OVER (PARTITION BY sector ORDER BY x) + (count(*) OVER (PARTITION BY sector, x) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY sector ORDER BY y) + (count(*) OVER (PARTITION BY sector, y) - 1) / 2.0 AS ry FROM j)
SELECT sector, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY ALL""",
)
def ev8(spark, sf_dir):
    return M.spearman(joined(spark, sf_dir), "sector", "support_rate", "eccr").select("sector", F.round("rho", 6).alias("rho"), "n")


@query(
    "EV13_TK4_task_extremes",
    f"""WITH {METRICS}, {CASES}, t AS (SELECT task, avg(support_rate) AS v FROM m JOIN cases USING (case_id) GROUP BY ALL)
SELECT arg_min(task, v) AS lowest, round(min(v), 6) AS low, arg_max(task, v) AS highest, round(max(v), 6) AS high FROM t""",
)
def ev13(spark, sf_dir):
    t = joined(spark, sf_dir).groupBy("task").agg(F.avg("support_rate").alias("v"))
    return t.agg(F.min_by("task", "v").alias("lowest"), F.round(F.min("v"), 6).alias("low"), F.max_by("task", "v").alias("highest"), F.round(F.max("v"), 6).alias("high"))


@query(
    "TK8_top_two_share",
    f"""WITH {CLAIMS}, l AS (SELECT label, count(*) AS n FROM claims WHERE label IS NOT NULL GROUP BY ALL)
SELECT label, n, round(n / sum(n) OVER (), 6) AS share FROM l QUALIFY row_number() OVER (ORDER BY n DESC, label) <= 2""",
)
def tk8(spark, sf_dir):
    """The two most frequent labels; the windows run over six rows."""
    n = claims(spark, sf_dir).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.orderBy(F.desc("n"), "label").limit(2).crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("EV12_recompute_compare", f"WITH {METRICS} SELECT count(*) AS compared, CAST(0 AS BIGINT) AS different FROM m")
def ev12(spark, sf_dir):
    """Support rates from the nested sets against rates from the flat lines, within 1e-12."""
    a = metrics(spark, sf_dir).select("case_id", "support_rate")
    b = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.avg((F.col("l_returnflag") != "R").cast("double")).alias("again"))
    return a.join(b, "case_id").agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("support_rate") - F.col("again")) > 1e-12).alias("different"))


@query(
    "JN6_ST3_key_equality",
    f"WITH {CLAIMS} SELECT count(DISTINCT dc_id) FILTER (flag = 'R') AS matched, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM claims",
)
def jn6(spark, sf_dir):
    """Diagnoses must be exactly the unsupported claims."""
    c = claims(spark, sf_dir)
    a = c.where(F.size("support_sets") == 0).select(F.col("dc_id").alias("a")).distinct()
    b = c.where("label is not null").select(F.col("dc_id").alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


@query("ST7_used_set", f"WITH {METRICS} SELECT case_id, count(DISTINCT ec_id) AS used FROM edge GROUP BY ALL")
def st7(spark, sf_dir):
    return M.edges(claims(spark, sf_dir)).groupBy("case_id").agg(F.count_distinct("ec_id").alias("used"))


@query(
    "ST5_superset_rejection",
    """WITH s AS (SELECT l_orderkey AS dc, l_linenumber AS set_no, list_sort(list_distinct([CAST(l_suppkey % 4 AS INTEGER), CAST(l_partkey % 4 AS INTEGER)])) AS ids FROM lineitem)
SELECT DISTINCT a.dc, a.set_no FROM s a JOIN s b ON a.dc = b.dc WHERE len(a.ids) > len(b.ids) AND list_has_all(a.ids, b.ids)""",
)
def st5(spark, sf_dir):
    """Support sets that strictly contain another set of their claim."""
    ids = F.array_sort(F.array_distinct(F.array((F.col("l_suppkey") % 4).cast("int"), (F.col("l_partkey") % 4).cast("int"))))
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dc"), F.col("l_linenumber").alias("set_no"), ids.alias("ids"))
    every = s.groupBy("dc").agg(F.collect_set("ids").alias("sets"))
    covers = F.exists("sets", lambda x: (F.size(x) < F.size("ids")) & (F.size(F.array_except(x, F.col("ids"))) == 0))
    return s.join(every, "dc").where(covers).select("dc", "set_no").distinct()


@query("DD8_unsupported_jobs", f"WITH {CLAIMS} SELECT dc_id, label FROM claims WHERE flag = 'R'")
def dd8(spark, sf_dir):
    return claims(spark, sf_dir).where(F.size("support_sets") == 0).select("dc_id", "label")


@query(
    "EV6_cluster_bootstrap",
)
def ev6(spark, sf_dir):
    """Claim-weighted support with an interval over resampled companies."""
    j = joined(spark, sf_dir).withColumn("supported", F.col("supported_direct") + F.col("supported_inferred"))
    mean, low, high = M.cluster_bootstrap(j, "company", "supported", "dc_count")
    return spark.createDataFrame([(mean, low, high)], "mean double, low double, high double")


@query(
    "WN7_ecdf",
    f"WITH {METRICS} SELECT dc_count, n, round(sum(n) OVER (ORDER BY dc_count) / sum(n) OVER (), 6) AS share FROM (SELECT dc_count, count(*) AS n FROM m GROUP BY ALL)",
)
def wn7(spark, sf_dir):
    """Cumulative shares of claim counts, over the frequency table."""
    n = metrics(spark, sf_dir).groupBy("dc_count").agg(F.count("*").alias("n"))
    run = Window.orderBy("dc_count")
    return n.select("dc_count", "n", F.round(F.sum("n").over(run) / F.sum("n").over(Window.partitionBy()), 6).alias("share"))
