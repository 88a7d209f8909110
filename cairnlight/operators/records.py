"""Content-addressed jobs and occurrences, query bundles, titles, and the records of a retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.functions.canonical import json_digest, json_text
from cairnlight.functions.text import clean_text


def content_id(prefix: str, basis: Column, kind: T.StructType) -> Column:
    """``prefix_`` and 32 digits of the SHA-256 of the basis as canonical JSON."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(json_digest(basis, kind), 1, 32))


def typed(df: DataFrame, names: list[str]) -> tuple[Column, T.StructType]:
    """A struct of columns and its type, for a digest."""
    return F.struct(*names), T.StructType([df.schema[n] for n in names])


def with_digest(df: DataFrame, name: str, names: list[str], prefix: str | None = None) -> DataFrame:
    """``df`` with the digest of columns under ``name``, as an id with a prefix or as the whole SHA-256."""
    c, kind = typed(df, names)
    return df.withColumn(name, content_id(prefix, c, kind) if prefix else json_digest(c, kind))


def jobs(inputs: DataFrame, task: str, dynamic: list[str], output_id: str, settings: dict[str, str]) -> DataFrame:
    """``inputs`` with the dynamic input of a model call, its hash, and the id of the call.

    The hash is of the output's id and the dynamic input; the call's id is of the task, that hash and all settings
    (versions and digests of prompt and schema, model, deployment, parameters). So equal calls have equal ids, and any
    change gives others.
    """
    c, kind = typed(inputs, dynamic)
    df = inputs.withColumns({"dynamic_input": c, "task": F.lit(task)} | {k: F.lit(v) for k, v in settings.items()})
    key = F.struct(F.col(output_id).alias("generation_output_id"), F.col("dynamic_input"))
    shape = T.StructType([T.StructField("generation_output_id", inputs.schema[output_id].dataType), T.StructField("dynamic_input", kind)])
    df = df.withColumn("job_input_hash", json_digest(key, shape))
    return with_digest(df, "call_id", ["task", "job_input_hash", *settings], f"{task}_extract").drop(*settings)


def task_title(task_id: Column, reference: Column, names: list[Column], defaults: dict[str, str]) -> Column:
    """Reference and the first name given, not twice if the name begins with it; else one of them, a default, or the id."""
    given = lambda c: F.nullif(clean_text(c), F.lit(""))
    ref, name = given(reference), F.coalesce(*map(given, names))
    known = F.lit(None).cast("string")
    for k, v in defaults.items():
        known = F.when(task_id == k, v).otherwise(known)
    both = F.when(F.startswith(F.lower(name), F.lower(ref)), name).otherwise(F.concat(ref, F.lit(" "), name))
    return F.coalesce(both, name, ref, known, F.replace(task_id, F.lit("_"), F.lit(" ")))


def query_bundles(cases: DataFrame, templates: DataFrame, values: list[str]) -> DataFrame:
    """(case_id, task_id, query_bundle_id, subqueries, query_bundle_hash) of each case.

    ``templates``: task_id, place, subquery_id, evidence_need, template. A task has its own templates or those of
    ``default``; none raises. ``{value}`` stands for a column of the case, and is filled once. Templates are few and join
    the cases by task.
    """
    own = templates.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("place", "subquery_id", "evidence_need", "template"))).alias("_own"))
    other = own.where("task_id = 'default'").select(F.col("_own").alias("_default"))
    df = cases.join(F.broadcast(own), "task_id", "left").join(F.broadcast(other), F.lit(True), "left")
    said = F.concat(F.lit("no template for "), F.col("task_id"))
    df = df.withColumn("_all", F.coalesce("_own", "_default", F.raise_error(said).cast(own.schema["_own"].dataType)))

    def text(template: Column) -> Column:
        # Cut at the braces, so that a brace inside a value stays as it is.
        parts = F.split(template, r"(?=\{\w+\})|(?<=\})")
        named = F.create_map(*(x for v in values for x in (F.lit("{" + v + "}"), F.col(v).cast("string"))))
        return F.array_join(F.transform(parts, lambda p: F.coalesce(named[p], p)), "")

    def subquery(t: Column) -> Column:
        q = text(t["template"])
        return F.struct(t["subquery_id"].alias("subquery_id"), F.coalesce(t["evidence_need"], F.lit("")).alias("evidence_need"), q.alias("query_text"), F.sha2(q, 256).alias("subquery_hash"))

    df = df.withColumn("subqueries", F.transform("_all", subquery)).withColumn("query_bundle_id", F.concat(F.col("case_id").cast("string"), F.lit("__query_bundle_v1")))
    c, kind = typed(df, ["case_id", "query_bundle_id", "task_id", "subqueries"])
    return df.withColumn("query_bundle_hash", F.sha2(json_text(c, kind), 256)).select("case_id", "task_id", "query_bundle_id", "subqueries", "query_bundle_hash")


def diagnostics(lists: dict[str, DataFrame], keys: list[str], top: dict[str, int], id_col: str = "evidence_id") -> DataFrame:
    """(keys, <list>_ids, <list>_scores for each list): the first ids of each ranked list and their scores, in order.

    Every list is cut before it is gathered; keys that a list lacks have empty arrays.
    """
    out = None
    for name, df in lists.items():
        a = df.where(F.col("rank") <= top[name]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).alias("i"), F.col("score").alias("s")))).alias("a"))
        part = a.select(*keys, F.col("a.i").alias(f"{name}_ids"), F.col("a.s").alias(f"{name}_scores"))
        out = part if out is None else out.join(part, keys, "full_outer")
    kinds = {f.name: f.dataType for f in out.schema.fields if f.name not in keys}
    return out.withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in kinds.items()})


def result_records(selected: DataFrame, cards: DataFrame, keys: list[str]) -> DataFrame:
    """One record for each key of ``selected`` (evidence_id, rank, prompt_rank, rrf_score): ids and places in prompt order,
    counts by type and by year, and the cards themselves. ``cards``: evidence_id, source_type, source_year, text."""
    j = selected.join(cards.select("evidence_id", "source_type", "source_year", "text"), "evidence_id")
    card = F.struct("prompt_rank", "rank", "evidence_id", "rrf_score", "source_type", "source_year", "text")
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(card)).alias("a"))

    def counts(field: str) -> Column:
        values = F.col(f"a.{field}")
        return F.map_from_arrays(F.array_sort(F.array_distinct(values)), F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.size(F.filter(values, lambda x: x == v))))

    return g.select(
        *keys,
        F.col("a.evidence_id").alias("retrieved_evidence_ids"),
        F.transform("a", lambda x: F.struct(x["prompt_rank"].alias("prompt_rank"), x["rank"].alias("final_rank"), x["rrf_score"].alias("final_rrf_score"))).alias("ranks"),
        counts("source_type").alias("evidence_type_distribution"),
        counts("source_year").alias("source_year_distribution"),
        F.col("a").alias("retrieved_cards"),
    )
