"""Support-graph metrics, grouped summaries and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d as a double, null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def verdict(sets: Column) -> Column:
    """direct if any set is direct, inferred if there are sets, else unsupported."""
    return F.when(F.exists(sets, lambda s: s["support_type"] == "direct"), "direct").when(F.size(sets) > 0, "inferred").otherwise("unsupported")


def multi_required(sets: Column) -> Column:
    """Whether there are sets and all of them need more than one card."""
    return (F.size(sets) > 0) & F.forall(sets, lambda s: F.size(s["ec_claim_ids"]) > 1)


def edges(claims: DataFrame) -> DataFrame:
    """(case_id, dc_id, ec_id, support_type) of all support sets."""
    sets = claims.select("case_id", "dc_id", F.explode("support_sets").alias("s"))
    return sets.select("case_id", "dc_id", F.explode("s.ec_claim_ids").alias("ec_id"), "s.support_type")


def case_metrics(claims: DataFrame, inventory: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Counts and rates of each case. Nested sets are read in place; only distinct used cards need the edge table."""
    kind = verdict(F.col("support_sets"))
    per = claims.withColumn("verdict", kind).groupBy("case_id").agg(
        F.count("*").alias("dc_count"),
        F.count_if(F.col("verdict") == "direct").alias("supported_direct"),
        F.count_if(F.col("verdict") == "inferred").alias("supported_inferred"),
        F.count_if(F.col("verdict") == "unsupported").alias("unsupported"),
        F.count_if(multi_required(F.col("support_sets"))).alias("multi_ec_required"),
        *(F.count_if(F.col("label") == x).alias(x) for x in labels),
    )
    used = edges(claims).groupBy("case_id").agg(F.count_distinct("ec_id").alias("used_ec_count"))
    total = inventory.groupBy("case_id").agg(F.count("*").alias("ec_count"))
    out = per.join(total, "case_id").join(used, "case_id", "left").withColumn("used_ec_count", F.coalesce("used_ec_count", F.lit(0).cast("long")))
    supported = F.col("supported_direct") + F.col("supported_inferred")
    return out.withColumns(
        {
            "support_rate": ratio(supported, F.col("dc_count")),
            "sensitivity_rate": ratio(supported, F.col("dc_count") - F.col(labels[0])),
            "eccr": ratio(F.col("used_ec_count"), F.col("ec_count")),
            "inference_rate": ratio(F.col("supported_inferred"), supported),
        }
    )


def stacked_means(df: DataFrame, dimensions: list[str], values: list[str]) -> DataFrame:
    """One row per dimension and member: row count and null-skipping means, by grouping sets in one pass."""
    member = F.coalesce(*(F.col(d).cast("string") for d in dimensions))
    sets = df.groupingSets([[F.col(d)] for d in dimensions], *dimensions)
    name = F.lit(None).cast("string")
    for d in dimensions:
        name = F.when(F.grouping(d) == 0, d).otherwise(name)
    out = sets.agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values), name.alias("dimension"))
    return out.select("dimension", member.alias("member"), "n", *values)


def average_ranks(counts: DataFrame, group: str, value: str, rank: str) -> DataFrame:
    """(group, value, rank) from a table of distinct pairs of values with their numbers ``n``: ties at their mean rank.

    What is sorted are the distinct values of a group with their frequencies, not its rows.
    """
    freq = counts.groupBy(group, value).agg(F.sum("n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return freq.select(group, value, (before + (F.col("_n") + 1) / 2.0).alias(rank))


def spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rank correlation of complete pairs in each group; null where a side is constant.

    Pairs are counted first; sums of products of ranks, each times its number, give the correlation.
    """
    counts = df.dropna(subset=[x, y]).groupBy(group, x, y).agg(F.count("*").alias("n"))
    whole = counts.join(average_ranks(counts, group, x, "rx"), [group, x]).join(average_ranks(counts, group, y, "ry"), [group, y])
    middle = whole.groupBy(group).agg((F.sum("n") + 1).alias("_2m"))
    n, m = F.col("n"), F.col("_2m") / 2.0
    dx, dy = F.col("rx") - m, F.col("ry") - m
    sums = whole.join(middle, group).groupBy(group).agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"), F.sum("n").alias("n"))
    return sums.select(group, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")


def frequency_quantiles(freq: DataFrame, keys: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """First value whose cumulative share reaches each of ``shares``; no interpolation."""
    order = Window.partitionBy(*keys).orderBy(value)
    total = Window.partitionBy(*keys)
    run = freq.withColumn("share", F.sum(n).over(order) / F.sum(n).over(total))
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("share") >= p, F.col(value))).alias(f"q{round(p * 100)}") for p in shares))


#: Clusters up to which the driver resamples.
MOST_CLUSTERS = 1_000_000


def cluster_bootstrap(df: DataFrame, cluster: str, total: str, count: str, draws: int = 2000, seed: int = 20260921) -> tuple[float, float, float]:
    """Ratio of sums, with a percentile interval over resampled clusters; nulls without any row.

    Sums per cluster come from the cluster and go to the driver in sorted order, a checked number of them; draws are made
    one after another, so that one draw's places are held at a time.
    """
    import numpy as np

    rows = df.groupBy(cluster).agg(F.sum(total).alias("t"), F.sum(count).alias("c")).orderBy(cluster).limit(MOST_CLUSTERS + 1).collect()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"over {MOST_CLUSTERS} clusters")
    if not rows:
        return float("nan"), float("nan"), float("nan")
    t, c = np.array([r["t"] for r in rows], float), np.array([r["c"] for r in rows], float)
    rng, means = np.random.default_rng(seed), np.empty(draws)
    for k in range(draws):
        pick = rng.integers(0, len(rows), len(rows))
        means[k] = t[pick].sum() / c[pick].sum()
    low, high = np.quantile(means, [0.025, 0.975])
    return float(t.sum() / c.sum()), float(low), float(high)


def paired_difference(df: DataFrame, cluster: str, x: str, y: str, draws: int = 2000, seed: int = 20260921) -> tuple[float, float, float]:
    """Mean of x - y over rows that have both, with an interval over resampled clusters."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(cluster, (F.col(x) - F.col(y)).alias("_d"), F.lit(1).alias("_one"))
    return cluster_bootstrap(pairs, cluster, "_d", "_one", draws, seed)


def aligned_score(statements: Column, verdicts: Column) -> tuple[Column, Column]:
    """(mean verdict, error): the error says how many there are of each where the lists differ in length, or that there are
    none; then the mean is null."""
    n, m = F.coalesce(F.size(statements), F.lit(0)), F.coalesce(F.size(verdicts), F.lit(0))
    error = F.when(n != m, F.concat(n.cast("string"), F.lit(" statements, "), m.cast("string"), F.lit(" verdicts"))).when(n == 0, "no statements")
    ok = F.aggregate(verdicts, F.lit(0), lambda s, v: s + F.coalesce(v.cast("int"), F.lit(0)))
    return F.when(error.isNull(), F.try_divide(ok.cast("double"), n.cast("double"))), error


def table_difference(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """One row: keys of one side only, and for each column how many keys of both sides have another value; nulls are equal."""
    columns = [c for c in a.columns if c != key]
    x = a.select(key, F.struct(*columns).alias("_a"))
    y = b.select(key, F.struct(*columns).alias("_b"))
    j = x.join(y, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(
        F.count_if(F.col("_b").isNull()).alias(f"only_{left}"),
        F.count_if(F.col("_a").isNull()).alias(f"only_{right}"),
        *(F.count_if(both & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(c) for c in columns),
    )
