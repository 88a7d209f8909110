"""Validators of model replies: nested JSON as VARIANT, checked in the plan; every broken rule gives ``path: rule``.

A reply is valid if its list of errors is empty. Text that is no JSON, and null, break the rule ``object`` at ``$``. What
lies inside a part of the wrong shape is not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlight.operators.grounding import occurrences

#: Fixed values of the reply contracts.
NO_CLAIM_REASONS = ("no_evaluable_factual_proposition", "insufficient_context_or_extraction_noise")
CONTEXT_FIELDS = ("company_name", "source_year", "target_reporting_year")
SUPPORT_TYPES = ("direct", "inferred")

Rule = tuple[Column, Column, str]


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_text(v: Column) -> Column:
    """The string, null for every other kind of value."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def part(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))


def ids_of(v: Column) -> Column:
    """Strings of a list; other items are null."""
    return F.transform(as_list(v), as_text)


def _none() -> Column:
    return F.array().cast("array<string>")


def _error(path: Column, rule: str) -> Column:
    return F.array(F.concat(path, F.lit(f": {rule}")))


def broken(*rules: Rule) -> Column:
    """Errors of all rules whose condition holds."""
    return F.concat(*(F.when(c, _error(path, rule)).otherwise(_none()) for c, path, rule in rules))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once: a list of one binds it to a name. In an expression without a name every
    mention works it out anew."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unless(*rules: Rule, then: Column) -> Column:
    """The error of the first rule whose condition holds, else ``then``: for shapes that later rules rely on."""
    out = None
    for c, path, rule in rules:
        out = F.when(c, _error(path, rule)) if out is None else out.when(c, _error(path, rule))
    return out.otherwise(then)


def each(items: Column, path: Column, check: Callable[[Column, Column], Column]) -> Column:
    """Errors of every item, with its number in the path."""
    return F.flatten(F.transform(items, lambda x, i: check(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))


def _root(reply: Column, names: Sequence[str], then: Callable[[Column], Column]) -> Column:
    return let(as_object(reply), lambda m: unless((m.isNull(), F.lit("$"), "object"), (~_fields(m, names), F.lit("$"), "fields"), then=then(m)))


def _fields(m: Column, names: Sequence[str]) -> Column:
    return F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, sorted(names)))


def _at(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _empty(text: Column) -> Column:
    return text.isNull() | (text == "")


def _repeats(a: Column) -> Column:
    return F.size(F.array_distinct(a)) < F.size(a)


def _written(v: Column) -> Column:
    """Kind and value of an item, for comparison."""
    return F.concat_ws(":", F.schema_of_variant(v), F.try_variant_get(v, "$", "string"))


def _quotes(v: Column, path: Column, source: Column, unique: bool) -> Column:
    items = as_list(v)

    def check(q: Column, at: Column) -> Column:
        text = as_text(q)
        rules = [(_empty(text), at, "empty"), (~source.contains(text), at, "not_in_source")]
        if unique:
            rules.append((F.size(occurrences(source, text)) > 1, at, "not_unique"))
        return unless(*rules, then=_none())

    return unless((items.isNull() | (F.size(items) == 0), path, "empty"), (_repeats(F.transform(items, _written)), path, "duplicates"), then=each(items, path, check))


def _claims(v: Column, path: Column, source: Column, unique: bool, names: Sequence[str], more: Callable[[Column, Column], Column] | None = None) -> Column:
    """Rules of a list of claims: fields, text, quotes, and no claim twice with the same quotes."""
    items = as_list(v)

    def check(x: Column, at: Column) -> Column:
        m = as_object(x)
        text = as_text(part(m, "claim_text"))
        own = F.concat(
            broken((text.isNull() | (_strip(text) == ""), _at(at, "claim_text"), "empty"), ((_strip(text) != "") & (text != _strip(text)), _at(at, "claim_text"), "outer_space")),
            _quotes(part(m, "source_quotes"), _at(at, "source_quotes"), source, unique),
            more(m, at) if more else _none(),
        )
        return unless((m.isNull(), at, "object"), (~_fields(m, names), at, "fields"), then=own)

    def signature(x: Column) -> Column:
        m = as_object(x)
        return F.to_json(F.struct(as_text(part(m, "claim_text")).alias("t"), F.transform(as_list(part(m, "source_quotes")), _written).alias("q")))

    signatures = F.transform(items, signature)
    again = F.filter(F.transform(signatures, lambda s, i: F.when(F.array_position(signatures, s) <= i, i)), lambda i: i.isNotNull())
    twice = F.transform(again, lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]: repeated")))
    return F.concat(each(items, path, check), twice)


def evidence_extraction(reply: Column, records: Column, unique_quotes: bool = False) -> Column:
    """Claims by evidence card. ``records`` are structs of prompt_label and retrieval_text, in the order of the prompt."""

    def results(m: Column) -> Column:
        items, path = as_list(part(m, "evidence_results")), F.lit("$.evidence_results")

        def check(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            o, record = as_object(x), F.get(records, i)
            claims = part(o, "claims")
            own = F.concat(
                broken((~as_text(part(o, "prompt_label")).eqNullSafe(record["prompt_label"]), _at(at, "prompt_label"), "order")),
                unless((as_list(claims).isNull(), _at(at, "claims"), "list"), then=_claims(claims, _at(at, "claims"), record["retrieval_text"], unique_quotes, ("claim_text", "source_quotes"))),
            )
            return unless((o.isNull(), at, "object"), (~_fields(o, ("prompt_label", "claims")), at, "fields"), then=own)

        return unless((items.isNull(), path, "list"), (F.size(items) != F.size(records), path, "length"), then=F.flatten(F.transform(items, check)))

    return _root(reply, ("evidence_results",), results)


def disclosure_extraction(reply: Column, source: Column, metadata: Column, unique_quotes: bool = False) -> Column:
    """Claims of a disclosure. ``metadata`` maps the context fields that the model was given to their values."""

    def resolutions(m: Column, at: Column) -> Column:
        items, path = as_list(part(m, "context_resolutions")), _at(at, "context_resolutions")

        def check(x: Column, at: Column) -> Column:
            o = as_object(x)
            field, form = as_text(part(o, "metadata_field")), as_text(part(o, "surface_form"))
            given = F.try_element_at(metadata, field)
            own = F.concat(
                unless(
                    (~F.coalesce(field.isin(*CONTEXT_FIELDS), F.lit(False)), _at(at, "metadata_field"), "unknown"),
                    (given.isNull(), _at(at, "metadata_field"), "not_supplied"),
                    (~as_text(part(o, "resolved_value")).eqNullSafe(given), _at(at, "resolved_value"), "differs"),
                    then=_none(),
                ),
                unless((_empty(form), _at(at, "surface_form"), "empty"), (~source.contains(form), _at(at, "surface_form"), "not_in_source"), then=_none()),
            )
            return unless((o.isNull(), at, "object"), (~_fields(o, ("surface_form", "resolved_value", "metadata_field")), at, "fields"), then=own)

        return unless((items.isNull(), path, "list"), then=each(items, path, check))

    def root(m: Column) -> Column:
        claims, reason = as_list(part(m, "claims")), part(m, "no_claim_reason")
        given = F.coalesce(as_text(reason).isin(*NO_CLAIM_REASONS), F.lit(False))
        return unless(
            (claims.isNull(), F.lit("$.claims"), "list"),
            ((F.size(claims) > 0) & ~F.is_variant_null(reason), F.lit("$.no_claim_reason"), "not_null"),
            ((F.size(claims) == 0) & ~given, F.lit("$.no_claim_reason"), "unknown"),
            then=_claims(part(m, "claims"), F.lit("$.claims"), source, unique_quotes, ("claim_text", "source_quotes", "context_resolutions"), resolutions),
        )

    return _root(reply, ("claims", "no_claim_reason"), root)


def partition(reply: Column, unit_ids: Column) -> Column:
    """Groups that together have each unit once, each with one of its members as the canonical one."""

    def root(m: Column) -> Column:
        path = F.lit("$.groups")
        named = lambda groups: F.struct(groups.alias("groups"), F.transform(groups, lambda g: ids_of(part(as_object(g), "member_unit_ids"))).alias("members"))
        return let(as_list(part(m, "groups")), lambda groups: let(named(groups), lambda v: rules(v["groups"], v["members"], path)))

    def rules(groups: Column, members: Column, path: Column) -> Column:
        def check(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            return let(as_object(x), lambda o: let(F.struct(as_text(part(o, "canonical_unit_id")).alias("c"), F.get(members, i).alias("ids")), lambda v: group(o, v["c"], v["ids"], i, at)))

        def group(o: Column, canonical: Column, ids: Column, i: Column, at: Column) -> Column:
            before = F.flatten(F.filter(F.slice(members, F.lit(1), i), lambda a: a.isNotNull()))
            own = unless(
                (_empty(canonical), _at(at, "canonical_unit_id"), "empty"),
                (ids.isNull() | (F.size(ids) == 0), _at(at, "member_unit_ids"), "empty"),
                (F.exists(ids, _empty), _at(at, "member_unit_ids"), "invalid_id"),
                (_repeats(ids), _at(at, "member_unit_ids"), "duplicates"),
                (~F.array_contains(ids, canonical), _at(at, "canonical_unit_id"), "not_a_member"),
                (F.size(F.array_except(ids, unit_ids)) > 0, _at(at, "member_unit_ids"), "unknown_id"),
                (F.arrays_overlap(ids, before), _at(at, "member_unit_ids"), "in_other_group"),
                then=_none(),
            )
            return unless((o.isNull(), at, "object"), (~_fields(o, ("canonical_unit_id", "member_unit_ids")), at, "fields"), then=own)

        seen = F.flatten(F.filter(members, lambda a: a.isNotNull()))
        missing = broken((F.size(F.array_except(unit_ids, seen)) > 0, path, "incomplete"))
        return unless((groups.isNull() | (F.size(groups) == 0), path, "empty"), then=F.concat(F.flatten(F.transform(groups, check)), missing))

    return _root(reply, ("groups",), root)


def _claim_id(m: Column, dc_id: Column) -> Column:
    return broken((~as_text(part(m, "dc_claim_id")).eqNullSafe(dc_id), F.lit("$.dc_claim_id"), "differs"))


def _ids(ids: Column, path: Column, known: Column) -> Column:
    """Rules of a list of ids: strings, no repeats, all known."""
    return unless((F.exists(ids, _empty), path, "invalid_id"), (_repeats(ids), path, "duplicates"), (F.size(F.array_except(ids, known)) > 0, path, "unknown_id"), then=_none())


def candidates(reply: Column, dc_id: Column, ec_ids: Column) -> Column:
    def root(m: Column) -> Column:
        ids, path = ids_of(part(m, "candidate_ec_ids")), F.lit("$.candidate_ec_ids")
        return F.concat(_claim_id(m, dc_id), unless((ids.isNull(), path, "list"), then=_ids(ids, path, ec_ids)))

    return _root(reply, ("dc_claim_id", "candidate_ec_ids"), root)


def support(reply: Column, dc_id: Column, ec_ids: Column) -> Column:
    """Support sets of known ids, none twice and none a strict superset of another."""

    def root(m: Column) -> Column:
        sets, path = as_list(part(m, "support_sets")), F.lit("$.support_sets")
        members = F.transform(sets, lambda s: F.array_sort(ids_of(part(as_object(s), "ec_claim_ids"))))

        def check(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            o = as_object(x)
            ids = ids_of(part(o, "ec_claim_ids"))
            own = F.concat(
                broken((~F.coalesce(as_text(part(o, "support_type")).isin(*SUPPORT_TYPES), F.lit(False)), _at(at, "support_type"), "unknown")),
                unless((ids.isNull() | (F.size(ids) == 0), _at(at, "ec_claim_ids"), "empty"), then=_ids(ids, _at(at, "ec_claim_ids"), ec_ids)),
            )
            mine = F.get(members, i)
            larger = F.exists(members, lambda a: (F.size(a) > 0) & (F.size(a) < F.size(mine)) & (F.size(F.array_except(a, mine)) == 0))
            between = broken((F.array_position(members, mine) <= i, at, "repeated"), (larger, at, "superset"))
            return unless((o.isNull(), at, "object"), (~_fields(o, ("ec_claim_ids", "support_type")), at, "fields"), then=F.concat(own, between))

        return F.concat(_claim_id(m, dc_id), unless((sets.isNull(), path, "list"), then=F.flatten(F.transform(sets, check))))

    return _root(reply, ("dc_claim_id", "support_sets"), root)


def diagnosis(reply: Column, dc_id: Column, labels: Sequence[str], forbidden_ids: Column) -> Column:
    """A known label, and a rationale that names no temporary id."""

    def root(m: Column) -> Column:
        text, path = as_text(part(m, "rationale")), F.lit("$.rationale")
        return F.concat(
            _claim_id(m, dc_id),
            broken((~F.coalesce(as_text(part(m, "unsupported_label")).isin(*labels), F.lit(False)), F.lit("$.unsupported_label"), "unknown")),
            unless((text.isNull() | (_strip(text) == ""), path, "empty"), (text != _strip(text), path, "outer_space"), (F.exists(forbidden_ids, lambda i: text.contains(i)), path, "names_id"), then=_none()),
        )

    return _root(reply, ("dc_claim_id", "unsupported_label", "rationale"), root)


CASE_FIELDS = ("case_id", "company_name", "reporting_year", "task", "disclosure_text", "paragraphs", "evidence", "units")
UNIT_FIELDS = ("unit_id", "unit_type", "target_text", "source_refs", "source_quotes")


def packet(case: Column, mapping: Column, quotas: dict[str, int]) -> Column:
    """A blinded case for reviewers: closed sets of fields, and links to what was sampled.

    ``mapping`` are structs of unit_id, case_id, target_text_sha256 and inclusion_probability of the case's units. Every
    unit is in it and it has no other; texts have the digests noted there, refs name paragraphs or evidence, quotes and
    paragraphs are in the disclosure, probabilities over 0 and at most 1, and each type has its quota.
    """

    def root(m: Column) -> Column:
        read = {x: as_list(part(m, x)) for x in ("evidence", "paragraphs", "units")}
        named = F.struct(F.coalesce(as_text(part(m, "disclosure_text")), F.lit("")).alias("text"), as_text(part(m, "case_id")).alias("case_id"), *(v.alias(k) for k, v in read.items()))
        return let(named, listed)

    def listed(v: Column) -> Column:
        names = lambda items, field: F.coalesce(F.transform(items, lambda x: as_text(part(as_object(x), field))), _none())
        refs = F.concat(names(v["paragraphs"], "ref"), names(v["evidence"], "label"))
        return let(F.struct(refs.alias("refs"), names(v["units"], "unit_id").alias("ids"), names(v["units"], "unit_type").alias("kinds")), lambda w: rules(v, w))

    def rules(v: Column, w: Column) -> Column:
        text, case_id, evidence, blocks, units = (v[x] for x in ("text", "case_id", "evidence", "paragraphs", "units"))
        refs, ids, kinds = w["refs"], w["ids"], w["kinds"]
        known = F.transform(mapping, lambda r: r["unit_id"])

        def closed(fields: Sequence[str], then: Callable[[Column, Column], Column] | None = None) -> Callable[[Column, Column], Column]:
            def check(x: Column, at: Column) -> Column:
                return let(as_object(x), lambda o: unless((o.isNull(), at, "object"), (~_fields(o, fields), at, "fields"), then=then(o, at) if then else _none()))

            return check

        def paragraph(o: Column, at: Column) -> Column:
            return broken((~F.coalesce(text.contains(as_text(part(o, "text"))), F.lit(False)), _at(at, "text"), "not_in_source"))

        def unit(o: Column, at: Column) -> Column:
            named = let(as_text(part(o, "unit_id")), lambda own: F.get(F.filter(mapping, lambda r: r["unit_id"] == own), F.lit(0)))
            return let(named, lambda record: linked(o, at, record))

        def linked(o: Column, at: Column, record: Column) -> Column:
            p = record["inclusion_probability"]
            own = broken(
                (~record["case_id"].eqNullSafe(case_id) | F.coalesce(F.size(F.array_except(ids_of(part(o, "source_refs")), refs)) > 0, F.lit(True)), at, "link"),
                (~F.sha2(as_text(part(o, "target_text")), 256).eqNullSafe(record["target_text_sha256"]), _at(at, "target_text"), "digest"),
                (~F.coalesce(F.forall(ids_of(part(o, "source_quotes")), lambda q: text.contains(q)), F.lit(False)), _at(at, "source_quotes"), "not_in_source"),
                (~F.coalesce((p > 0) & (p <= 1), F.lit(False)), at, "probability"),
            )
            return unless((record.isNull(), _at(at, "unit_id"), "unknown"), then=own)

        times = lambda name: F.size(F.filter(kinds, lambda k: k == name))
        counts = [times(name) != n for name, n in quotas.items()]
        other = F.size(F.array_except(kinds, F.array(*map(F.lit, quotas)))) > 0
        lists = unless(*((x.isNull(), F.lit(f"$.{n}"), "list") for x, n in ((evidence, "evidence"), (blocks, "paragraphs"), (units, "units"))), then=F.concat(
            each(evidence, F.lit("$.evidence"), closed(("label", "context"))),
            each(blocks, F.lit("$.paragraphs"), closed(("ref", "text"), paragraph)),
            each(units, F.lit("$.units"), closed(UNIT_FIELDS, unit)),
            broken((_repeats(ids), F.lit("$.units"), "duplicates"), (F.size(F.array_except(known, ids)) > 0, F.lit("$.units"), "incomplete"), (reduce(Column.__or__, counts, other), F.lit("$.units"), "counts")),
        ))
        return lists

    return _root(case, CASE_FIELDS, root)


def in_order(ids: Column, known: Column) -> Column:
    """Ids of a valid reply in the order in which they were given to the model."""
    return F.filter(known, lambda k: F.array_contains(ids, k))
