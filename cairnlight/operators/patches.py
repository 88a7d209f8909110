"""Claims edited by patches that address them by content, replays of such edits, and the comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.functions.canonical import json_text
from cairnlight.operators.validators import let

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CLAIM = _struct(claim_text=_S, source_quotes=T.ArrayType(_S), unresolved_context=T.ArrayType(_S))
CLAIMS = T.ArrayType(CLAIM)
EDITS = T.ArrayType(_struct(replaces=T.ArrayType(_struct(claim_id=_S, expected_claim_text=_S)), claims=CLAIMS))
STAGE = _struct(
    stage=T.IntegerType(), call_id=_S, draft_call_id=_S, settings=_S, call_status=_S, provider_status=_S, draft=CLAIMS, edits=EDITS, additions=CLAIMS, canonical=CLAIMS
)


def claim_ids(label: Column, claims: Column, kind: T.StructType = CLAIM) -> Column:
    """``claim_`` and 16 digits of the SHA-256 of the JSON list of label, place from 1 and claim, for each claim."""

    def one(c: Column, i: Column) -> Column:
        text = F.concat(F.lit("["), json_text(label, T.StringType()), F.lit(", "), (i + 1).cast("string"), F.lit(", "), json_text(c, kind), F.lit("]"))
        return F.concat(F.lit("claim_"), F.substring(F.sha2(text, 256), 1, 16))

    return F.transform(claims, one)


def patched(label: Column, claims: Column, edits: Column, additions: Column) -> Column:
    """Struct of errors and claims: the claims of an edit stand where the first of those it replaces stood, additions last.

    Errors: ``unknown_id``, ``text_differs`` (the addressed claim has another text than the edit expects),
    ``no_or_repeated_reference`` within an edit, ``edited_twice``, ``empty_claim`` in the result. With an error the claims
    are null. Null lists are empty.
    """
    claims, additions = (F.coalesce(c, F.array().cast(CLAIMS)) for c in (claims, additions))
    edits = F.coalesce(edits, F.array().cast(EDITS))
    # What is used more than once is bound to a name: the index of the claims, the places of each edit, result and errors.
    def addressed(e: Column, index: Column) -> Column:
        at = F.transform(e["replaces"], lambda r: F.array_position(index["id"], r["claim_id"]).cast("int"))
        right = F.transform(e["replaces"], lambda r: F.exists(index, lambda x: (x["id"] == r["claim_id"]) & (x["text"] == r["expected_claim_text"])))
        return F.struct(at.alias("at"), right.alias("right"), e["claims"].alias("claims"))

    def with_places(found: Column) -> Column:
        def taken(c: Column, i: Column) -> Column:
            owner = F.filter(found, lambda e: F.array_contains(e["at"], i + 1))
            first = F.get(owner, F.lit(0))
            return F.when(F.size(owner) == 0, F.array(c)).when(F.array_min(first["at"]) == i + 1, first["claims"]).otherwise(F.array().cast(CLAIMS))

        return let(F.concat(F.flatten(F.transform(claims, taken)), additions), lambda result: judged(found, result))

    def judged(found: Column, result: Column) -> Column:
        places = F.flatten(found["at"])
        rules = {
            "unknown_id": F.array_contains(places, 0),
            "text_differs": F.exists(found, lambda e: F.exists(F.arrays_zip(e["at"].alias("at"), e["right"].alias("right")), lambda x: (x["at"] > 0) & ~F.coalesce(x["right"], F.lit(False)))),
            "no_or_repeated_reference": F.exists(found, lambda e: (F.size(e["at"]) == 0) | (F.size(F.array_distinct(e["at"])) < F.size(e["at"]))),
            "edited_twice": F.size(F.array_distinct(places)) < F.size(F.flatten(F.transform(found, lambda e: F.array_distinct(e["at"])))),
            "empty_claim": F.exists(result, lambda c: F.length(F.regexp_replace(F.coalesce(c["claim_text"], F.lit("")), r"(?U)\s+", "")) == 0),
        }
        errors = F.array_compact(F.array(*(F.when(broken, rule) for rule, broken in rules.items())))
        return let(errors, lambda e: F.struct(e.alias("errors"), F.when(F.size(e) == 0, result).alias("claims")))

    index = F.arrays_zip(claim_ids(label, claims).alias("id"), claims["claim_text"].alias("text"))
    return let(index, lambda known: let(F.transform(edits, lambda e: addressed(e, known)), with_places))


def replay(calls: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, stages, errors, claims): the stages of each unit replayed in order from its first recorded output.

    ``calls`` has the columns of ``STAGE`` and ``label``; the stages of a unit are few and fold in one row. Errors carry the
    stage: ``incomplete`` (call or provider), ``lineage`` (the draft is not the stage before), ``settings`` (changed),
    ``draft`` (its input is not what the stage before returned), those of the patch, and ``differs`` where the stored
    output is not the replayed one. Comparison holds nulls equal. After an error the stored output is the next draft.
    """
    fields = STAGE.fieldNames()
    runs = calls.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_runs"), F.min(label).alias("_label"))
    first = F.get("_runs", F.lit(0))

    def say(rule: str, broken: Column, stage: Column) -> Column:
        return F.when(broken, F.array(F.concat(stage.cast("string"), F.lit(f": {rule}")))).otherwise(F.array().cast("array<string>"))

    def step(state: Column, s: Column) -> Column:
        done = patched(F.col("_label"), state["claims"], s["edits"], s["additions"])

        def checked(p: Column) -> Column:
            errors = F.concat(
                state["errors"],
                _incomplete(s, say),
                say("lineage", ~s["draft_call_id"].eqNullSafe(state["call_id"]), s["stage"]),
                say("settings", ~s["settings"].eqNullSafe(state["settings"]), s["stage"]),
                say("draft", ~s["draft"].eqNullSafe(state["claims"]), s["stage"]),
                F.transform(p["errors"], lambda e: F.concat(s["stage"].cast("string"), F.lit(": "), e)),
                say("differs", ~s["canonical"].eqNullSafe(p["claims"]), s["stage"]),
            )
            return F.struct(errors.alias("errors"), s["canonical"].alias("claims"), s["call_id"].alias("call_id"), s["settings"].alias("settings"))

        return F.get(F.transform(F.array(done), checked), F.lit(0))

    start = F.struct(_incomplete(first, say).alias("errors"), first["canonical"].alias("claims"), first["call_id"].alias("call_id"), first["settings"].alias("settings"))
    folded = F.aggregate(F.slice("_runs", F.lit(2), F.greatest(F.size("_runs") - 1, F.lit(0))), start, step)
    out = runs.select(*keys, F.size("_runs").alias("stages"), folded.alias("f"))
    return out.select(*keys, "stages", "f.errors", "f.claims")


def _incomplete(s: Column, say) -> Column:  # noqa: ANN001
    return say("incomplete", ~s["call_status"].eqNullSafe("success") | ~s["provider_status"].eqNullSafe("completed"), s["stage"])


def exact_quotes(claim: Column, source: Column) -> Column:
    """Whether a claim has quotes and all of them are in the source."""
    quotes = claim["source_quotes"]
    return F.coalesce((F.size(quotes) > 0) & F.forall(quotes, lambda q: F.coalesce((q != "") & source.contains(q), F.lit(False))), F.lit(False))


def compared(baseline: DataFrame, revised: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and revised claims of each source unit: counts, those with exact quotes, with unresolved context, and how
    many claims (of equal content, repeats counted) only one side has.

    Both sides have ``keys``, source, settings, call_status and claims. Errors: ``only_baseline`` or ``only_revised``,
    ``source`` or ``settings`` (changed), ``unsuccessful``, ``no_uncertainty`` (a revised claim without its list).
    """
    sides = {"b": baseline, "r": revised}
    cols = ["source", "settings", "call_status", "claims"]
    b, r = (df.select(*keys, F.struct(*cols).alias(name)) for name, df in sides.items())
    both = b.join(r, keys, "full_outer")
    # Columns of their own: an expression inside a function of items would be worked out for each item.
    count = lambda side, f: F.coalesce(F.size(F.filter(F.col(f"{side}.claims"), f)), F.lit(0))
    own = lambda side: F.transform(F.coalesce(F.col(f"{side}.claims"), F.array().cast(CLAIMS)), lambda c: json_text(c, CLAIM))
    both = both.withColumns({f"_{side}": own(side) for side in sides})
    has = {k: F.col(k).isNotNull() for k in sides}
    rules = {
        "only_baseline": ~has["r"],
        "only_revised": ~has["b"],
        "source": has["b"] & has["r"] & ~F.col("b.source").eqNullSafe(F.col("r.source")),
        "settings": has["b"] & has["r"] & ~F.col("b.settings").eqNullSafe(F.col("r.settings")),
        "unsuccessful": F.exists(F.array(*(F.when(has[k], F.coalesce(F.col(f"{k}.call_status"), F.lit(""))) for k in sides)), lambda s: s != "success"),
        "no_uncertainty": F.exists("r.claims", lambda c: c["unresolved_context"].isNull()),
    }
    return both.select(
        *keys,
        count("b", lambda c: F.lit(True)).alias("baseline_claims"),
        count("r", lambda c: F.lit(True)).alias("revised_claims"),
        count("b", lambda c: exact_quotes(c, F.col("b.source"))).alias("baseline_exact"),
        count("r", lambda c: exact_quotes(c, F.col("r.source"))).alias("revised_exact"),
        count("r", lambda c: F.size(c["unresolved_context"]) > 0).alias("revised_unresolved"),
        _surplus(F.col("_b"), F.col("_r")).alias("removed"),
        _surplus(F.col("_r"), F.col("_b")).alias("added"),
        F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), rule) for rule, broken in rules.items()))).alias("errors"),
    )


def _surplus(a: Column, b: Column) -> Column:
    """How many items of ``a`` are left when each of ``b`` takes one equal item away."""
    times = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    each = F.transform(F.array_distinct(a), lambda x: F.greatest(times(a, x) - times(b, x), F.lit(0)))
    return F.aggregate(each, F.lit(0), lambda s, n: s + n)
