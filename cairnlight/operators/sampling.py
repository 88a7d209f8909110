"""Quotas and reproducible draws."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.functions.canonical import quoted


def hamilton(counts: dict[str, int], size: int) -> dict[str, int]:
    """One for each stratum, the others in proportion to n - 1 by largest remainder, ties alphabetically."""
    if not len(counts) <= size <= sum(counts.values()):
        raise ValueError(f"{size} places do not fit {len(counts)} strata with {sum(counts.values())} members")
    spare, weight = size - len(counts), sum(n - 1 for n in counts.values())
    parts = {k: divmod(spare * (n - 1), weight) if weight else (0, 0) for k, n in counts.items()}
    quota = {k: 1 + whole for k, (whole, _) in parts.items()}
    by_rest = sorted(counts, key=lambda k: (-parts[k][1], k))
    for k in by_rest[: size - sum(quota.values())]:
        quota[k] += 1
    return quota


def hash_rank(df: DataFrame, strata: list[str], keys: list[str], seed: str, purpose: str, take: int, tie: str) -> DataFrame:
    """First ``take`` rows of each stratum in the order of a SHA-256 of seed, purpose and keys."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(purpose), *(F.col(k).cast("string") for k in keys)), 256)
    w = Window.partitionBy(*strata).orderBy(digest, tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= take)


def _stream(key: str) -> random.Random:
    """Generator of a text: its SHA-256, read as a whole number, is the seed."""
    return random.Random(int(hashlib.sha256(key.encode()).hexdigest(), 16))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def drawn_places(key: pd.Series, size: pd.Series, take: pd.Series) -> pd.Series:
    """Places from 0 that the stream of ``key`` draws from a sorted list of ``size``, in order; they depend on nothing else."""
    return pd.Series([_stream(k).sample(range(int(n)), min(int(n), int(t))) for k, n, t in zip(key, size, take, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def shuffled_places(key: pd.Series, size: pd.Series) -> pd.Series:
    """The places 0 to ``size`` - 1 as the stream of ``key`` shuffles a sorted list of that size."""

    def one(k: str, n: int) -> list[int]:
        places = list(range(n))
        _stream(k).shuffle(places)
        return places

    return pd.Series([one(k, int(n)) for k, n in zip(key, size, strict=True)])


def stream_key(seed: int, *namespace: Column) -> Column:
    """Name of a stream: the JSON list of the seed and the texts, non-ASCII characters escaped."""
    return F.concat(F.lit(f"[{seed}"), *(F.concat(F.lit(", "), ascii_quoted(n)) for n in namespace), F.lit("]"))


def ascii_quoted(text: Column) -> Column:
    """A JSON string in ASCII; characters outside it as escapes of their UTF-16 units."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    escaped = F.lower(F.regexp_replace(units, "(.{4})", r"\\u$1"))
    return F.when(text.rlike(r"[^\x00-\x7F]"), _mixed(text, escaped)).otherwise(quoted(text))


def _mixed(text: Column, escaped: Column) -> Column:
    """Escapes of units over 0x7F; the others as in a plain JSON string."""
    units = F.filter(F.split(escaped, r"\\u"), lambda u: u != "")
    ascii_char = lambda u: quoted(F.decode(F.unhex(F.substr(u, F.lit(3), F.lit(2))), "US-ASCII"))
    plain = lambda u: F.substr(ascii_char(u), F.lit(2), F.length(ascii_char(u)) - 2)
    parts = F.transform(units, lambda u: F.when((F.substr(u, F.lit(1), F.lit(2)) == "00") & (F.substr(u, F.lit(3), F.lit(1)) < "8"), plain(u)).otherwise(F.concat(F.lit("\\u"), u)))
    return F.concat(F.lit('"'), F.array_join(parts, ""), F.lit('"'))


def stream_sample(units: DataFrame, strata: list[str], order: list[str], key: Column, take: Column | int) -> DataFrame:
    """``units`` that the stream of each stratum draws, with place (from 1, in order of the draw), population and probability.

    ``key`` and ``take`` depend on the strata alone, ``order`` is unique within one. Only counts reach Python; units are
    numbered in order and joined with the drawn places, so a stratum is sorted but never held.
    """
    sizes = units.groupBy(*strata).agg(F.count("*").alias("population"))
    places = drawn_places(key, F.col("population"), F.lit(take) if isinstance(take, int) else take)
    drawn = sizes.select(*strata, "population", F.posexplode(places).alias("place", "_k"))
    numbered = units.withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1)
    counts = drawn.groupBy(*strata).agg(F.count("*").alias("_taken"))
    found = numbered.join(drawn, [*strata, "_k"]).join(counts, strata)
    return found.withColumns({"place": F.col("place") + 1, "probability": F.col("_taken") / F.col("population")}).drop("_k", "_taken")


def seeded_draw(df: DataFrame, stratum: str, id_col: str, take: int, seed: str) -> DataFrame:
    """(stratum, id, place): a seeded sample of each stratum's sorted ids."""
    out = stream_sample(df.select(stratum, id_col), [stratum], [id_col], F.concat(F.lit(f"{seed}|"), F.col(stratum)), take)
    return out.select(stratum, id_col, "place")


def hamilton_quotas(counts: DataFrame, stratum: str, n: str, size: int) -> DataFrame:
    """``hamilton`` in the plan, over a table of one row per stratum; sizes that do not fit raise."""
    whole = Window.partitionBy()
    spare, weight = F.lit(size) - F.count("*").over(whole), F.sum(F.col(n) - 1).over(whole)
    fits = (F.count("*").over(whole) <= size) & (F.sum(n).over(whole) >= size)
    share = spare * (F.col(n) - 1)
    base = counts.select("*", spare.alias("_spare"), weight.alias("_weight"), share.alias("_share"), F.when(~fits, F.raise_error(F.lit(f"{size} places do not fit the strata")).cast("boolean")).alias("_bad"))
    base = base.withColumns({"_q": F.coalesce(F.expr("try_divide(_share - _share % nullif(_weight, 0), _weight)").cast("long"), F.lit(0).cast("long")), "_rest": F.coalesce(F.expr("_share % nullif(_weight, 0)"), F.lit(0).cast("long"))})
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), stratum))
    left = F.col("_spare") - F.sum("_q").over(whole)
    return base.where("_bad is null").withColumn("quota", 1 + F.col("_q") + F.when(rank <= left, 1).otherwise(0)).select(stratum, "quota")


def floor_one_quotas(counts: DataFrame, label: str, n: str, rank: str, size: int) -> DataFrame:
    """Shares of ``size`` in proportion to ``n``, rounded down but at least 1; then one more for the largest deficits, or
    one less for the largest excesses of those above 1, until the sum is ``size``. Ties by ``rank``.

    Every step taken is a row: a label's further steps rank by what its deficit is by then, so the first rows in order
    are the steps of the loop. Whole numbers stand for the fractions.
    """
    whole = Window.partitionBy()
    total = F.sum(n).over(whole)
    t = counts.select("*", total.alias("_t")).withColumn("_q", F.greatest(F.lit(1), F.floor(F.expr(f"{size} * {n} div _t"))))
    t = t.withColumns({"_gap": F.expr(f"{size} * {n} - _q * _t"), "_missing": F.lit(size) - F.sum("_q").over(whole), "_bad": F.when((F.col(n) < 1) | (F.col("_t") < size), F.raise_error(F.lit(f"{size} places do not fit the labels")).cast("boolean"))})
    t = t.where("_bad is null")
    more = F.least(F.col("_missing"), F.col(n) - F.col("_q"))
    steps = F.when(F.col("_missing") > 0, more).otherwise(F.least(-F.col("_missing"), F.col("_q") - 1))
    each = t.select(label, rank, "_missing", "_gap", "_t", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(steps.cast("long") - 1, F.lit(0).cast("long")))).alias("_k"), steps.alias("_steps")).where("_k < _steps")
    at = F.when(F.col("_missing") > 0, -(F.col("_gap") - F.col("_k") * F.col("_t"))).otherwise(F.col("_gap") + F.col("_k") * F.col("_t"))
    taken = each.withColumn("_r", F.row_number().over(Window.orderBy(at, rank, "_k"))).where(F.col("_r") <= F.abs("_missing"))
    change = taken.groupBy(label).agg(F.sum(F.signum("_missing")).cast("long").alias("_change"))
    return t.join(change, label, "left").select(label, (F.col("_q") + F.coalesce("_change", F.lit(0).cast("long"))).alias("quota"))


def water_filled(counts: DataFrame, label: str, have: str, cap: str, rank: str, slots: int) -> DataFrame:
    """Slots given one by one to the label with the least so far that is under its cap, ties by ``rank``: the slots are
    rows at the level they fill, and the lowest ones are taken."""
    most = F.least(F.col(cap).cast("long"), F.lit(slots).cast("long"))
    each = counts.select(label, rank, have, most.alias("_m"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(most - 1, F.lit(0).cast("long")))).alias("_k")).where("_k < _m")
    taken = each.withColumn("_r", F.row_number().over(Window.orderBy(F.col(have) + F.col("_k"), rank))).where(F.col("_r") <= slots)
    got = taken.groupBy(label).agg(F.count("*").alias("slots"))
    return counts.select(label).join(got, label, "left").select(label, F.coalesce("slots", F.lit(0).cast("long")).alias("slots"))


#: Cases up to which one row can carry their shuffled order.
MOST_CASES = 5_000_000


def round_robin_quotas(cases: DataFrame, case: str, kinds: list[str], per_case: int, seed: int) -> DataFrame:
    """(case, kind, quota): ``per_case`` places of each case dealt in turn to shuffled kinds, over shuffled cases.

    Case i of the shuffled order gets the kinds at (i * per_case + j) modulo their number. Streams are named, so another
    number of cases or kinds changes nothing else.
    """
    sorted_cases = cases.select(case).distinct()
    n = sorted_cases.groupBy().agg(F.count("*").alias("n"))
    n = n.select(F.when(F.col("n") > MOST_CASES, F.raise_error(F.lit(f"over {MOST_CASES} cases"))).otherwise(F.col("n")).cast("long").alias("n"))
    order = n.select(F.posexplode(shuffled_places(stream_key(seed, F.lit("card-type-case-order")), F.col("n"))).alias("_i", "_k"))
    numbered = sorted_cases.withColumn("_k", F.row_number().over(Window.orderBy(case)) - 1)
    types = list(kinds)
    _stream(json.dumps([seed, "card-type-order"])).shuffle(types)
    places = F.sequence(F.lit(0), F.lit(per_case - 1))
    dealt = numbered.join(order, "_k").select(case, F.explode(F.transform(places, lambda j: F.get(F.array(*map(F.lit, types)), ((F.col("_i") * per_case + j) % len(types)).cast("int")))).alias("kind"))
    return dealt.groupBy(case, "kind").agg(F.count("*").alias("quota"))


def batches(df: DataFrame, group: str, order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """(group, order, batch): a new batch where the number of items or the sum of sizes would be passed, from 0 in a group.

    The fold needs a group in order, so a group is read by one task, row after row from a sort that may spill; nothing of
    it is held.
    """
    kinds = df.select(group, order).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, batch, n, total = object(), 0, 0, 0
        for part in parts:
            numbers = []
            for g, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if g != current:
                    current, batch, n, total = g, 0, 0, 0
                if n and (n >= most_items or total + s > most_size):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + s
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(numbers, pa.int32())], names=[group, order, "batch"])

    dealt = df.select(group, order, F.coalesce(size, F.lit(0)).alias(size)).repartition(group).sortWithinPartitions(group, order)
    return dealt.mapInArrow(run, T.StructType([*kinds.fields, T.StructField("batch", T.IntegerType())]))
