"""Contracts of inputs: rows that break a rule, and plans that raise on the first one.

A raising plan does its check in the pass that makes its rows: nothing is collected, and no second job runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Card types a pool may have; the last only where Markdown tables are asked for.
CARD_TYPES = ("csv_metric", "narrative", "pdf_table_row")
MARKDOWN = "pdf_table_markdown"
PDF_TYPES = ("narrative", "pdf_table_row", MARKDOWN)
SUPPORT_TYPES = ("direct", "inferred")


def failing(broken: Column, message: Column, value: Column) -> Column:
    """``value``, or an error with ``message`` where ``broken`` holds."""
    return F.when(broken, F.raise_error(message)).otherwise(value)


def unique(df: DataFrame, keys: list[str], ok: str | None = None) -> DataFrame:
    """``df``, which raises if a key repeats. One shuffle on the keys, which a join on them takes over.

    With ``ok`` the check is a column of that name, which what follows must look at for the check to run.
    """
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_r"))
    said = F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*keys)))
    name = ok or "_ok"
    checked = one.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), failing(F.col("_n") > 1, said, F.lit(True)).alias(name))
    return checked if ok else checked.where(name).drop(name)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], complete: bool = False) -> DataFrame:
    """Left join in which a key of ``right`` occurs once, or it raises; with ``complete``, a row without a match raises too.

    Rows are kept by what the check gives, so it runs whatever columns are asked for later.
    """
    out = left.join(unique(right, keys, "_ok"), keys, "left")
    said = F.concat(F.lit("no match: "), F.to_json(F.struct(*keys)))
    kept = failing(F.col("_ok").isNull(), said, F.col("_ok")) if complete else F.coalesce("_ok", F.lit(True))
    return out.where(kept).drop("_ok")


def boundary(packages: DataFrame, cards: DataFrame, markdown: bool = False) -> DataFrame:
    """(case_id, evidence_id, outcome) of every allowed card of each case.

    ``packages``: case_id, company_id, csv_years, pdf_years, evidence_id (one row for each allowed id). ``cards``:
    evidence_id (unique), company_id, source_type, evidence_type, source_year as text. The first rule broken is the
    outcome: missing, wrong_company, invalid_year, csv_year, pdf_year, markdown, unknown_source, type; else eligible.
    """
    c = cards.select("evidence_id", F.col("company_id").alias("_own"), "source_type", "evidence_type", F.col("source_year").try_cast("int").alias("_year"), F.lit(True).alias("_card"))
    kind, source = F.coalesce("evidence_type", F.lit("")), F.coalesce("source_type", F.lit(""))
    csv = (source == "csv") | (kind == "csv_metric")
    pdf = ~csv & ((source == "pdf") | kind.isin(*PDF_TYPES))
    outside = lambda years: ~F.coalesce(F.array_contains(years, F.col("_year")), F.lit(False))
    outcome = (
        F.when(F.col("_card").isNull(), "missing")
        .when(~F.col("_own").eqNullSafe(F.col("company_id")), "wrong_company")
        .when(F.col("_year").isNull(), "invalid_year")
        .when(csv & outside(F.col("csv_years")), "csv_year")
        .when(pdf & outside(F.col("pdf_years")), "pdf_year")
        .when(pdf & (kind == MARKDOWN) & F.lit(not markdown), "markdown")
        .when(~csv & ~pdf, "unknown_source")
        .when(~kind.isin(*CARD_TYPES, MARKDOWN), "type")
        .otherwise("eligible")
    )
    return packages.join(c, "evidence_id", "left").select("case_id", "evidence_id", outcome.alias("outcome"))


def eligible_pool(packages: DataFrame, cards: DataFrame, markdown: bool = False) -> DataFrame:
    """(case_id, evidence_id) of the eligible cards. Missing ids are left out; every other broken rule raises."""
    b = boundary(packages, cards, markdown)
    bad = ~F.col("outcome").isin("eligible", "missing")
    said = F.concat(F.lit("boundary: "), F.col("outcome"), F.lit(" "), F.col("evidence_id"), F.lit(" in case "), F.col("case_id").cast("string"))
    return b.withColumn("outcome", failing(bad, said, F.col("outcome"))).where("outcome = 'eligible'").select("case_id", "evidence_id")


def kernel_violations(ec: DataFrame, dc: DataFrame, support: DataFrame, diagnosis: DataFrame, candidates: DataFrame | None, labels: tuple[str, ...]) -> DataFrame:
    """(case_id, rule, n): rules of the case metrics that a case breaks, with the number of records that do.

    ``ec``: case_id, ec_id; ``dc``: case_id, dc_id; ``support``: case_id, dc_id, support_sets; ``diagnosis``: case_id,
    dc_id, label; ``candidates``: case_id, dc_id, candidate_ids. Records are of the case that holds them. Each table is
    shuffled once, by case; what is compared meets in one row of the case, and no pair of records is made.
    """
    tables = {
        "ecs": ec.select("case_id", F.col("ec_id").alias("ecs")),
        "dcs": dc.select("case_id", F.col("dc_id").alias("dcs")),
        "support": support.select("case_id", F.struct("dc_id", "support_sets").alias("support")),
        "diagnoses": diagnosis.select("case_id", F.struct("dc_id", "label").alias("diagnoses")),
    }
    if candidates is not None:
        tables["candidates"] = candidates.select("case_id", F.struct("dc_id", "candidate_ids").alias("candidates"))
    # Full joins would shuffle the lists of all tables before them again, each time.
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables.values())
    case = every.groupBy("case_id").agg(*(F.collect_list(name).alias(name) for name in tables))
    of = lambda c: c["dc_id"]
    repeats = lambda a: F.size(a) - F.size(F.array_distinct(a))
    count = lambda a, f: F.size(F.filter(a, f))
    flat = F.flatten(F.transform("support", lambda s: F.transform(s["support_sets"], lambda x: F.struct(s["dc_id"].alias("dc_id"), x["ec_claim_ids"].alias("ids"), x["support_type"].alias("kind")))))
    case = case.withColumn("sets", flat)
    support_ids, diagnosed = of(F.col("support")), of(F.col("diagnoses"))
    open_ = of(F.filter("support", lambda s: F.size(s["support_sets"]) == 0))
    foreign = lambda ids: F.size(F.array_except(ids, F.col("ecs"))) > 0
    rules = {
        "no_claims": F.when((F.size("dcs") == 0) | (F.size("ecs") == 0), 1).otherwise(0),
        "duplicate_ec": repeats(F.col("ecs")),
        "duplicate_dc": repeats(F.col("dcs")),
        "duplicate_support": repeats(support_ids),
        "duplicate_diagnosis": repeats(diagnosed),
        "claim_without_support": F.size(F.array_except("dcs", support_ids)),
        "foreign_support": F.size(F.array_except(support_ids, F.col("dcs"))),
        "empty_set": count(F.col("sets"), lambda s: F.coalesce(F.size(s["ids"]), F.lit(0)) == 0),
        "repeated_card": count(F.col("sets"), lambda s: repeats(s["ids"]) > 0),
        "foreign_card": count(F.col("sets"), lambda s: foreign(s["ids"])),
        "support_type": count(F.col("sets"), lambda s: ~F.coalesce(s["kind"].isin(*SUPPORT_TYPES), F.lit(False))),
        "diagnosis_of_supported": F.size(F.array_except(diagnosed, open_)),
        "unsupported_without_diagnosis": F.size(F.array_except(open_, diagnosed)),
        "unknown_label": count(F.col("diagnoses"), lambda d: ~F.coalesce(d["label"].isin(*labels), F.lit(False))),
    }
    if candidates is not None:
        given = F.map_from_entries(F.transform(F.filter("candidates", lambda c, i: F.array_position(of(F.col("candidates")), c["dc_id"]) == i + 1), lambda c: F.struct(c["dc_id"], c["candidate_ids"])))
        rules |= {
            "claims_of_candidates": F.size(F.array_except("dcs", of(F.col("candidates")))) + F.size(F.array_except(of(F.col("candidates")), F.col("dcs"))),
            "repeated_candidate": count(F.col("candidates"), lambda c: repeats(c["candidate_ids"]) > 0),
            "foreign_candidate": count(F.col("candidates"), lambda c: foreign(c["candidate_ids"])),
            "card_not_a_candidate": count(F.col("sets"), lambda s: F.size(F.array_except(s["ids"], F.coalesce(given[s["dc_id"]], F.array().cast("array<string>")))) > 0),
        }
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("rule"), v.cast("long").alias("n")) for k, v in rules.items())), lambda r: r["n"] > 0)
    return case.select("case_id", F.inline(found))


def raising(df: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """``df``, which raises at a row whose ``key`` breaks a rule."""
    first = violations.groupBy(key).agg(F.min(F.concat_ws(": ", "rule", F.col("n").cast("string"))).alias("_why"))
    out = df.join(first, key, "left")
    said = F.concat(F.col("_why"), F.lit(" in "), F.col(key).cast("string"))
    ok = failing(F.col("_why").isNotNull(), said, F.lit(True))
    return out.withColumn("_ok", ok).where("_ok").select(*df.columns)
