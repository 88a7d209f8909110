"""Quotes, prompts, replies, patches, streams, contracts and file sources against plain Python and faulty inputs."""

import hashlib
import json
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnlight.functions import canonical, folds
from cairnlight.operators import checks, grounding, patches, prompts, sampling, validators
from cairnlight.sources import embeddings, files
from cairnlight.streaming import logs


def starts(text, quote):
    return [i for i in range(len(text) - len(quote) + 1) if text[i : i + len(quote)] == quote] if quote else []


# Quotes


def test_occurrences(spark):
    r = random.Random(1)
    rows = [("".join(r.choices("ab. \\EQ\n😀é", k=r.randrange(30))), "".join(r.choices("ab. \\EQ\n😀é", k=r.randrange(4)))) for _ in range(300)] + [("a\\Eb\\E", "\\E"), ("", ""), ("x", ""), ("aaaa", "aa")]
    df = spark.createDataFrame(rows, "t string, q string")
    got = df.select("t", "q", grounding.occurrences(F.col("t"), F.col("q")).alias("s")).collect()
    assert all(x["s"] == starts(x["t"], x["q"]) for x in got)


def test_annotation_lattice(spark):
    rows = [(0, "one two one", ["two"]), (1, "one two one", ["two", "one"]), (2, "one two one", ["two", "three", ""]), (3, "one", ["", "one"]), (4, "one", [None]), (5, "one", []), (6, "one", None)]
    d = spark.createDataFrame(rows, "k int, t string, q array<string>").select("k", grounding.annotate(F.col("t"), F.col("q")).alias("s"))
    got = {r["k"]: (r["g"], [tuple(x)[:5] + (x["match_status"],) for x in r["s"]]) for r in d.select("k", "s", grounding.grounding_status(F.col("s")).alias("g")).collect()}
    assert [got[k][0] for k in range(7)] == ["exact_unique", "exact_with_ambiguity", "contains_unmatched_quote", "not_matchable", "not_matchable", "not_provided", "not_provided"]
    assert got[1][1] == [(0, "two", 4, 7, 1, "exact_unique"), (1, "one", 0, 3, 2, "exact_ambiguous")]
    assert got[4][1] == [(0, None, None, None, 0, "not_matchable")]


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_overlap_join(spark, width):
    r = random.Random(2)
    side = lambda n: [(r.randrange(3), i, s := r.randrange(200), s + r.randrange(0, 40)) for i in range(n)]
    a, b = side(60), side(60)
    df = lambda rows, name: spark.createDataFrame(rows, f"k int, {name} int, start int, end int")
    got = grounding.overlap_join(df(a, "x"), df(b, "y"), ["k"], width).select("k", "x", "y").collect()
    want = [(k, x, y) for k, x, s, e in a for j, y, t, u in b if k == j and s < u and t < e and s < e and t < u]
    assert sorted(map(tuple, got)) == sorted(want)


def plain_review(text, quotes):
    given = sorted({q for q in quotes or [] if q and q.strip()})
    found, unresolved, segmented = set(), 0, False
    for q in given:
        lines = [x.strip() for x in q.splitlines() if x.strip()]
        if q in text:
            found.add(q)
        elif len(lines) > 1 and all(x in text for x in lines):
            found |= set(lines)
            segmented = True
        else:
            unresolved += 1
    spans = [(m.start(), m.end()) for q in found for m in re.finditer(re.escape(q), text)]
    whole = not given or unresolved > 0
    refs = [f"Paragraph {i + 1:02d}" for i, (s, e, _) in enumerate(folds.paragraphs(text)) if whole or any(a < e and s < b for a, b in spans)]
    return ("full_disclosure" if whole else "verbatim_line_segments" if segmented else "exact", unresolved, sorted(found), refs)


def test_review_golden_and_random(spark):
    table = "| Indicator | Year |\n|---|---|\n| Incidents | 1 |\n| Fines | 0 |"
    two = "First original paragraph.\n\nSecond original paragraph."
    rows = [(0, table, ["| Indicator | Year |\n|---|---|\n| Fines | 0 |"]), (1, two, ["Invented quotation.", "First original paragraph."]), (2, two, []), (3, two, None), (4, " foo bar", [" foo\n", "  "]), (5, "aaaa", ["aa"])]
    r = random.Random(3)
    for k in range(6, 120):
        text = "".join(r.choice(["a ", "b", "\n", "\n\n", "# h\n", "c d", "\u00e9"]) for _ in range(40))
        at = [r.randrange(len(text)) for _ in range(3)]
        rows.append((k, text, [text[i : i + r.randrange(1, 12)] for i in at[: r.randrange(4)]] + (["a \n b"] if k % 9 == 0 else []) + (["zz"] if k % 11 == 0 else [])))
    got = grounding.review(spark.createDataFrame(rows, "k int, t string, q array<string>"), "k", "t", "q").collect()
    assert {x["k"]: (x["mode"], x["unresolved"], x["quotes"], x["refs"]) for x in got} == {k: plain_review(t, q) for k, t, q in rows}
    first = {x["k"]: x for x in got}
    assert (first[0]["mode"], first[0]["refs"]) == ("verbatim_line_segments", ["Paragraph 01"])
    assert (first[1]["quotes"], first[1]["unresolved"], len(first[1]["refs"])) == (["First original paragraph."], 1, 2)


def test_quoted_in(spark):
    """Quotes with and without an inner word, of several lines, of marks only; nulls and empty texts."""
    r = random.Random(4)
    words = ["alpha", "beta", "be", "gamma7", "x", "é", "---", "(a)", "日本"]
    line = lambda n: " ".join(r.choices(words, k=n))
    docs = [(i, "\n".join(line(r.randrange(1, 9)) for _ in range(r.randrange(6)))) for i in range(80)] + [(90, None), (91, "")]
    docs += [(92, docs[7][1]), (92, docs[7][1]), (92, docs[9][1])]
    quotes = [(i, "\n".join(line(r.randrange(1, 4)) for _ in range(r.randrange(1, 3)))) for i in range(60)] + [(70, None), (71, ""), (72, " \n"), (73, "-"), (74, "alph"), (75, "alpha beta be\n\n  x "), (76, "nowhere at all here")]
    strip = lambda q: [x.strip() for x in (q or "").split("\n") if x.strip()]
    want = [(q, d, "exact" if quote in text else "verbatim_line_segments") for q, quote in quotes for d, text in docs if strip(quote) and text is not None and all(x in text for x in strip(quote))]
    got = grounding.quoted_in(spark.createDataFrame(quotes, "q int, quote string"), spark.createDataFrame(docs, "d int, t string"), "q", "quote", "d", "t")
    rows = [tuple(x) for x in got.collect()]
    assert sorted(rows) == sorted(want) and len(want) > 300
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


# Replies


def test_replies_that_are_no_objects(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "{", "[]", '"x"', "null", "3")], "j string").withColumn("v", F.try_parse_json("j"))
    ids = F.array(F.lit("a"))
    every = [validators.candidates(F.col("v"), F.lit("d"), ids), validators.support(F.col("v"), F.lit("d"), ids), validators.partition(F.col("v"), ids), validators.diagnosis(F.col("v"), F.lit("d"), ("x",), ids)]
    for row in df.select(*every).collect():
        assert all(e == ["$: object"] for e in row)


def test_replies_with_several_errors(spark):
    """All errors of a reply, with paths; what lies in a broken part is not looked at."""

    def errors(check, reply):
        return spark.createDataFrame([(json.dumps(reply),)], "j string").select(check(F.parse_json("j")).alias("e")).first()["e"]

    text = F.lit("Sales rose. Sales rose in 2020.")
    claim = {"claim_text": " Sales rose", "source_quotes": ["Sales rose", "no", 5], "context_resolutions": [{"surface_form": "2020", "resolved_value": "2021", "metadata_field": "source_year"}, 7]}
    extraction = lambda v: validators.disclosure_extraction(v, text, F.create_map(F.lit("source_year"), F.lit("2020")), unique_quotes=True)
    assert errors(extraction, {"claims": [claim, "x"], "no_claim_reason": None}) == [
        "$.claims[0].claim_text: outer_space",
        "$.claims[0].source_quotes[0]: not_unique",
        "$.claims[0].source_quotes[1]: not_in_source",
        "$.claims[0].source_quotes[2]: empty",
        "$.claims[0].context_resolutions[0].resolved_value: differs",
        "$.claims[0].context_resolutions[1]: object",
        "$.claims[1]: object",
    ]
    once = lambda v: validators.disclosure_extraction(v, text, F.create_map(F.lit("source_year"), F.lit("2020")))
    good = {"claim_text": "Sales rose", "source_quotes": ["Sales rose"], "context_resolutions": []}
    assert errors(once, {"claims": [good, {**good, "context_resolutions": []}, {**good, "source_quotes": ["Sales rose in"]}], "no_claim_reason": None}) == ["$.claims[1]: repeated"]
    groups = {"groups": [{"canonical_unit_id": "a", "member_unit_ids": ["a"]}, 3, {"canonical_unit_id": "b", "member_unit_ids": ["b", "a"]}]}
    assert errors(lambda v: validators.partition(v, F.array(*map(F.lit, "abc"))), groups) == ["$.groups[1]: object", "$.groups[2].member_unit_ids: in_other_group", "$.groups: incomplete"]
    sets = {"dc_claim_id": "d", "support_sets": [{"ec_claim_ids": ["b", "a"], "support_type": "direct"}, {"ec_claim_ids": ["a"], "support_type": "inferred"}, {"ec_claim_ids": ["a", "b"], "support_type": "x"}]}
    assert errors(lambda v: validators.support(v, F.lit("d"), F.array(*map(F.lit, "abc"))), sets) == ["$.support_sets[0]: superset", "$.support_sets[2].support_type: unknown", "$.support_sets[2]: repeated", "$.support_sets[2]: superset"]


# Prompts


def card(n, text, shown=True, **other):
    c = {"evidence_id": f"e{n}", "prompt_label": f"Evidence {n:02d}", "source_label": "s", "retrieval_text": text, "retrieval_text_hash": hashlib.sha256(text.encode()).hexdigest(), "shown_in_prompt": shown}
    return tuple({**c, **other}.values())


def test_prompts(spark):
    block = lambda n, t: f"Evidence {n:02d}\n\nSource:\ns\n\nText:\n{t}"
    head, title, other = "Instruction\n\nAsk.\n\nEvidence\n\n", "PDF Narrative Evidence\n\n", f"\n\n{'-' * 50}\n\nCSV Metric Evidence\n\n"
    fine = head + title + block(1, "é one") + "\n\n" + block(2, "two") + other + block(3, "three") + "\n"
    cards = [card(1, "é one"), card(2, "two"), card(9, "hidden", False), card(3, "three")]
    rows = [(0, fine, cards), (1, None, cards), (2, head + title, None), (3, fine.replace("two", "tow"), cards), (4, fine, [card(1, "é one", evidence_id="e2"), *cards[1:]]), (5, fine.replace("CSV Metric", "CSV"), cards)]
    kind = "k int, p string, c array<struct<evidence_id:string,prompt_label:string,source_label:string,retrieval_text:string,retrieval_text_hash:string,shown_in_prompt:boolean>>"
    got = {r["k"]: r["p"] for r in spark.createDataFrame(rows, kind).select("k", prompts.parsed(F.col("p"), F.lit("Ask."), F.col("c")).alias("p")).collect()}
    section = fine[len(head) :]
    assert got[0]["errors"] == [] and got[0]["evidence_ids"] == ["e1", "e2", "e3"]
    assert got[0]["starts"] == [section.index(block(n, t)) for n, t in ((1, "é one"), (2, "two"), (3, "three"))]
    assert got[0]["contexts"][2] == "CSV Metric Evidence\n\n" + block(3, "three") and got[0]["contexts"][1].startswith(title)
    assert got[1]["errors"] == ["layout"] and got[2]["errors"] == ["residue", "no_evidence"]
    assert got[3]["errors"] == ["absent: Evidence 02", "unmapped: Evidence 03"]
    assert got[4]["errors"] == ["duplicate_id"] and got[5]["errors"] == ["unmapped: Evidence 03"]


# Patches


def plain_ids(label, claims):
    return ["claim_" + hashlib.sha256(json.dumps([label, i, c], sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16] for i, c in enumerate(claims, 1)]


def test_canonical_json(spark):
    texts = ["", "é \"q\" \\ / \n\t\b\f\r", "\x0b\x0e\x1f\x1a\x01", "\\u001F \\\\u000B \\\x0b", "😀\u2028\x7f"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert [r[0] for r in df.select(canonical.quoted(F.col("t"))).collect()][:5] == [json.dumps(t, ensure_ascii=False) for t in texts]
    row = spark.createDataFrame([({"b": ["x", None], "a": 3, "c": None, "d": True},)], "r struct<b:array<string>,a:int,c:string,d:boolean>")
    want = {"a": 3, "b": ["x", None], "c": None, "d": True}
    assert row.select(canonical.json_text(F.col("r"), row.schema["r"].dataType)).first()[0] == json.dumps(want, sort_keys=True)
    assert row.select(canonical.json_digest(F.col("r"), row.schema["r"].dataType)).first()[0] == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def claim(text, quotes=("q",), open_=()):
    return {"claim_text": text, "source_quotes": list(quotes), "unresolved_context": list(open_)}


def plain_patch(label, claims, edits, additions):
    ids, owner = plain_ids(label, claims), {}
    for e in edits:
        at = [ids.index(r["claim_id"]) if r["claim_id"] in ids else None for r in e["replaces"]]
        if None in at or not at or len(set(at)) < len(at) or set(at) & set(owner) or any(claims[i]["claim_text"] != r["expected_claim_text"] for i, r in zip(at, e["replaces"], strict=True)):
            return None
        owner |= dict.fromkeys(at, (min(at), e["claims"]))
    out = []
    for i, c in enumerate(claims):
        out += [c] if i not in owner else owner[i][1] if owner[i][0] == i else []
    out += additions
    return None if any(not c["claim_text"].strip() for c in out) else out


def test_patches_against_plain(spark):
    r = random.Random(5)
    rows = []
    for k in range(150):
        claims = [claim(r.choice(["a", "b", "é\n"]), r.sample(["x", 'y"', "ü"], r.randrange(3))) for _ in range(r.randrange(5))]
        ids = plain_ids("Evidence 01", claims) + ["claim_none"]
        texts = [c["claim_text"] for c in claims] + ["zz"]
        pick = lambda: (i := r.randrange(len(ids)), {"claim_id": ids[i], "expected_claim_text": texts[i] if r.random() < 0.9 else "other"})[1]
        edits = [{"replaces": [pick() for _ in range(r.choice([1, 1, 1, 2, 0]))], "claims": [claim(r.choice(["n", "m", " "] if r.random() < 0.2 else ["n", "m"])) for _ in range(r.randrange(3))]} for _ in range(r.randrange(3))]
        rows.append((k, claims, edits, [claim("added")] * r.randrange(2)))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("c", patches.CLAIMS), T.StructField("e", patches.EDITS), T.StructField("a", patches.CLAIMS)])
    got = spark.createDataFrame(rows, schema).select("k", patches.patched(F.lit("Evidence 01"), F.col("c"), F.col("e"), F.col("a")).alias("p")).collect()
    found = {x["k"]: [c.asDict() for c in x["p"]["claims"]] if x["p"]["claims"] is not None else None for x in got}
    want = {k: plain_patch("Evidence 01", c, e, a) for k, c, e, a in rows}
    assert found == want and {v is None for v in want.values()} == {True, False}
    assert all((x["p"]["errors"] == []) == (x["p"]["claims"] is not None) for x in got)


def test_audit_counts_repeats(spark):
    from pyspark.sql import types as T

    s = T.StringType()
    schema = T.StructType([T.StructField("u", s), T.StructField("source", s), T.StructField("settings", s), T.StructField("call_status", s), T.StructField("claims", patches.CLAIMS)])
    old = [("u", "q text", "a", "success", [claim("x"), claim("x"), claim("y", ["none"])]), ("v", None, "a", None, None)]
    new = [("u", "q text", "a", "success", [claim("x"), claim("z", ["q", ""]), claim("z", open_=["year"])]), ("v", "t", "b", "success", [claim("x")])]
    got = {r["u"]: r for r in patches.compared(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["u"]).collect()}
    u = got["u"]
    assert (u["baseline_claims"], u["revised_claims"], u["baseline_exact"], u["revised_exact"], u["revised_unresolved"], u["removed"], u["added"], u["errors"]) == (3, 3, 2, 2, 1, 2, 2, [])
    assert got["v"]["errors"] == ["source", "settings", "unsuccessful"] and got["v"]["added"] == 1


# Streams and quotas


def stream(*key):
    return random.Random(int(hashlib.sha256(json.dumps(list(key)).encode()).hexdigest(), 16))


@pytest.mark.parametrize("parts", [1, 5])
def test_named_streams(spark, parts):
    """Draws depend on seed, case, kind and the size of the pool only, not on partitions or other cases."""
    cases = {"a": 9, "é\"😀": 4, "c": 2, "d": 1}
    rows = [(c, f"u{i:02d}") for c, n in cases.items() for i in range(n)]
    df = spark.createDataFrame(rows, "case string, unit string").repartition(parts)
    got = sampling.stream_sample(df, ["case"], ["unit"], sampling.stream_key(7, F.col("case"), F.lit("claims")), 3)
    want = {(c, u, k, n, min(3, n) / n) for c, n in cases.items() for k, u in enumerate(stream(7, c, "claims").sample([f"u{i:02d}" for i in range(n)], min(3, n)), 1)}
    assert {tuple(r) for r in got.select("case", "unit", "place", "population", "probability").collect()} == want


def test_round_robin(spark):
    cases, kinds = [f"c{i:03d}" for i in range(50)], ["csv", "narrative", "table"]
    order, types, want = sorted(cases), list(kinds), {}
    stream(3, "card-type-case-order").shuffle(order)
    stream(3, "card-type-order").shuffle(types)
    for i, c in enumerate(order):
        for j in range(4):
            key = c, types[(i * 4 + j) % 3]
            want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame([(c,) for c in cases], "case string").repartition(3)
    assert {(r["case"], r["kind"]): r["quota"] for r in sampling.round_robin_quotas(df, "case", kinds, 4, 3).collect()} == want
    assert sampling.round_robin_quotas(df.limit(0), "case", kinds, 4, 3).count() == 0


def plain_floor_one(pools, size):
    total = sum(pools.values())
    ideal = {k: Fraction(size * n, total) for k, n in pools.items()}
    quota = {k: max(1, int(x)) for k, x in ideal.items()}
    while sum(quota.values()) != size:
        if sum(quota.values()) < size:
            quota[max((k for k in pools if quota[k] < pools[k]), key=lambda k: ideal[k] - quota[k])] += 1
        else:
            quota[min((k for k in pools if quota[k] > 1), key=lambda k: ideal[k] - quota[k])] -= 1
    return quota


def test_quotas_in_the_plan(spark):
    r = random.Random(6)
    for _ in range(15):
        names = [f"l{i}" for i in range(r.randrange(1, 7))]
        r.shuffle(names)
        pools = {k: r.choice([1, 1, 2, 5, 40, 900]) for k in names}
        size = r.randrange(len(names), min(60, sum(pools.values())) + 1)
        df = spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(pools.items())], "label string, n long, rank int")
        assert {x["label"]: x["quota"] for x in sampling.floor_one_quotas(df, "label", "n", "rank", size).collect()} == plain_floor_one(pools, size)
        assert {x["label"]: x["quota"] for x in sampling.hamilton_quotas(df, "label", "n", size).collect()} == sampling.hamilton(pools, size)
        caps, slots = {k: r.randrange(5) for k in names}, r.randrange(15)
        filled = df.withColumn("cap", F.element_at(F.create_map(*[F.lit(x) for k, c in caps.items() for x in (k, c)]), F.col("label")))
        assert {x["label"]: x["slots"] for x in sampling.water_filled(filled, "label", "n", "cap", "rank", slots).collect()} == folds.water_fill(pools, caps, slots)
    df = spark.createDataFrame([("a", 2, 0), ("b", 2, 1), ("c", 2, 2)], "label string, n long, rank int")
    for bad in (sampling.hamilton_quotas(df, "label", "n", 2), sampling.hamilton_quotas(df, "label", "n", 7), sampling.floor_one_quotas(df, "label", "n", "rank", 7)):
        with pytest.raises(PySparkException, match="do not fit"):
            bad.collect()


# Contracts


def test_joins_that_raise(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    assert checks.many_to_one(left, right, ["k"], complete=True).count() == 2
    with pytest.raises(PySparkException, match='duplicate key: {"k":1}'):
        checks.many_to_one(left, right.union(right.limit(1)), ["k"]).collect()
    with pytest.raises(PySparkException, match='no match: {"k":2}'):
        checks.many_to_one(left, right.where("k = 1"), ["k"], complete=True).collect()
    # Even where no column of the right side is asked for.
    with pytest.raises(PySparkException, match="duplicate key"):
        checks.many_to_one(left, right.union(right), ["k"]).select("v").write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize(("company", "year", "outcome"), [("b", "2022", "wrong_company"), ("a", "2023", "pdf_year"), ("a", None, "invalid_year"), ("a", "2022", "eligible")])
def test_boundary(spark, company, year, outcome):
    """A card of another company or of a later year raises; a missing one is left out."""
    kind = "case_id string, company_id string, csv_years array<int>, pdf_years array<int>, evidence_id string"
    p = spark.createDataFrame([("x", "a", [2019, 2023], [2019, 2020, 2021, 2022], e) for e in ("one", "gone")], kind)
    c = spark.createDataFrame([("one", company, "pdf", "narrative", year)], "evidence_id string, company_id string, source_type string, evidence_type string, source_year string")
    assert {r["evidence_id"]: r["outcome"] for r in checks.boundary(p, c).collect()} == {"one": outcome, "gone": "missing"}
    if outcome == "eligible":
        assert [tuple(r) for r in checks.eligible_pool(p, c).collect()] == [("x", "one")]
    else:
        with pytest.raises(PySparkException, match=f"boundary: {outcome} one in case x"):
            checks.eligible_pool(p, c).collect()


def test_kernel_checks(spark):
    """A support set with a card of another case; without candidates no rule about them applies."""
    ec = spark.createDataFrame([("a", "e"), ("b", "f")], "case_id string, ec_id string")
    dc = spark.createDataFrame([("b", "d")], "case_id string, dc_id string")
    sets = "case_id string, dc_id string, support_sets array<struct<ec_claim_ids:array<string>,support_type:string>>"
    support = spark.createDataFrame([("b", "d", [(["e"], "direct")])], sets)
    none = spark.createDataFrame([], "case_id string, dc_id string, label string")
    bad = checks.kernel_violations(ec, dc, support, none, None, ("x",))
    assert {tuple(r) for r in bad.collect()} == {("a", "no_claims", 1), ("b", "foreign_card", 1)}
    with pytest.raises(PySparkException, match="foreign_card: 1 in b"):
        checks.raising(dc, bad.where("case_id = 'b'"), "case_id").collect()
    assert checks.raising(dc, bad.where("case_id = 'a'"), "case_id").count() == 1
    null_sets = spark.createDataFrame([("b", "d", None)], sets)
    assert ("b", "unsupported_without_diagnosis") not in {(r["case_id"], r["rule"]) for r in checks.kernel_violations(ec, dc, null_sets, none, None, ("x",)).collect()}


# Files


def test_mappings(spark, tmp_path):
    shapes = {
        "a.json": ["x", "y"],
        "b.json": {"x": 0, "y": 1},
        "c.json": {"0": "x", "1": "y"},
        "d.json": {"records": [{"id": "x"}, {"card_id": "y", "row_index": 1}]},
        "e.json": {"evidence_ids": ["x", "y"]},
        "f.json": [{"evidence_id": "y", "embedding_row": 1}, {"evidence_id": "x", "index": 0}, {"note": 1}],
    }
    for name, value in shapes.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "g.jsonl").write_text('{"evidence_id": "x"}\n{"id": "y", "index": "1"}\n{"id": " "}\n')
    (tmp_path / "h.csv").write_text("evidence_id,embedding_row\nx,0\ny,1\n")
    for name in [*shapes, "g.jsonl", "h.csv"]:
        assert {tuple(r) for r in embeddings.read_mapping(spark, str(tmp_path / name)).collect()} == {("x", 0), ("y", 1)}, name


def test_matrices(spark, tmp_path):
    folder = tmp_path / "embeddings" / "b" / "m_1"
    folder.mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        embeddings.discover(str(tmp_path), "b", "m/1")
    matrix = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(folder / "embeddings.npy", matrix)
    (folder / "id_mapping.json").write_text(json.dumps({f"e{i}": i for i in range(9, 2, -1)}))
    found = embeddings.discover(f"file://{tmp_path}", "b", "m/1")
    df = embeddings.load(spark, found, rows=4)
    assert {r["evidence_id"]: r["vector"] for r in df.collect()} == {f"e{i}": matrix[i].tolist() for i in range(3, 10)}
    assert embeddings.read_matrix(spark, found.matrix, 4).rdd.getNumPartitions() == 3
    (folder / "id_mapping.json").write_text('{"e": 10}')
    with pytest.raises(PySparkException, match="row beyond the matrix: 10"):
        embeddings.load(spark, found).collect()
    np.save(folder / "embeddings.npy", np.zeros(4))
    with pytest.raises(PySparkException, match="not a matrix"):
        embeddings.read_matrix(spark, found.matrix).collect()


def test_complete_end(tmp_path):
    p = tmp_path / "log"
    for text, start, most, want in [("a\nbb\ncc", 0, 100, 5), ("a\nbb\ncc", 0, 3, 2), ("a\nbb\ncc", 2, 1, 5), ("abc", 0, 2, 0), ("", 0, 5, 0), ("a\nbb\ncc", 5, 9, 5), ("x" * 200_000 + "\ny", 0, 10, 200_001)]:
        p.write_text(text)
        assert logs.complete_end(str(p), start, most) == want, text[:9]


def test_log_stream(spark, tmp_path):
    """Unfinished lines wait, polls are bounded, a cut file is read from its start, and a restart goes on where it stopped."""
    log, out, point = tmp_path / "a.log", str(tmp_path / "out"), str(tmp_path / "cp")
    lines = [f"line {i} é" for i in range(200)]
    log.write_text("\n".join(lines) + "\npart")
    (tmp_path / "b.log").write_text("other\n")

    def run(poll):
        q = logs.follow(spark, f"file://{tmp_path}/*.log", poll).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).start()
        q.processAllAvailable()
        return q

    def seen():
        return sorted(r["line"] for r in spark.read.schema("path string, offset long, line string").parquet(out).collect())

    q = run(100)
    assert seen() == sorted([*lines, "other"])
    assert max(p["numInputRows"] for p in q.recentProgress) < 30
    with log.open("a") as f:
        f.write("ial\nnext\n")
    q.processAllAvailable()
    q.stop()
    assert seen() == sorted([*lines, "other", "partial", "next"])
    with log.open("a") as f:
        f.write("after restart\n")
    q = run(100)
    assert seen() == sorted([*lines, "other", "partial", "next", "after restart"])
    with log.open("r+") as f:
        f.truncate(0)
        f.write("fresh\n")
    q.processAllAvailable()
    q.stop()
    assert seen() == sorted([*lines, "other", "partial", "next", "after restart", "fresh"])


def test_report_inventory(spark):
    listed = spark.createDataFrame([("acme", "2020", "AR", "x/acme_2020_AR.pdf"), ("acme", "2020", "AR", "acme_2020_AR.pdf"), (None, None, None, "beta_2021_SR.pdf")], "company_id string, year string, report_type string, file string")
    found = spark.createDataFrame([("r/acme_2020_AR.pdf",), ("r/acme_2019_AR.pdf",), ("r/readme.pdf",)], "path string")
    got = {tuple(r) for r in files.report_inventory(listed, found).collect()}
    assert got == {("acme", 2020, "AR", "acme_2020_AR.pdf", True), ("beta", 2021, "SR", "beta_2021_SR.pdf", True), ("acme", 2019, "AR", "acme_2019_AR.pdf", False)}


# Records and statistics


def test_query_bundles(spark):
    from cairnlight.operators import records

    cases = spark.createDataFrame([(1, "T1", "{year} Ltd", 2020), (2, "T2", "b", 2021)], "case_id int, task_id string, company string, year int")
    kind = "task_id string, place int, subquery_id string, evidence_need string, template string"
    templates = spark.createDataFrame([("T1", 1, "s", None, "{company} in {year}, {other}{year}")], kind)
    row = records.query_bundles(cases.where("case_id = 1"), templates, ["company", "year"]).first()
    assert [s["query_text"] for s in row["subqueries"]] == ["{year} Ltd in 2020, {other}2020"]
    payload = {"case_id": 1, "query_bundle_id": "1__query_bundle_v1", "task_id": "T1", "subqueries": [s.asDict() for s in row["subqueries"]]}
    assert row["query_bundle_hash"] == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    with pytest.raises(PySparkException, match="no template for T2"):
        records.query_bundles(cases, templates, ["company", "year"]).collect()


def test_jobs(spark):
    from cairnlight.operators import records

    df = spark.createDataFrame([(1, "a \"é\"\n"), (1, "a \"é\"\n"), (2, None)], "id int, text string")
    settings = {"model_key": "m", "prompt_version": "v"}
    got = records.jobs(df, "dc", ["text"], "id", settings).collect()
    compact = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    for r in got:
        h = compact({"generation_output_id": r["id"], "dynamic_input": {"text": r["text"]}})
        assert (r["job_input_hash"], r["call_id"]) == (h, "dc_extract_" + compact({"task": "dc", "job_input_hash": h, **settings})[:32])
    other = records.jobs(df, "dc", ["text"], "id", {**settings, "model_key": "n"}).collect()
    assert not {r["call_id"] for r in got} & {r["call_id"] for r in other}


def test_statistics(spark):
    """Bootstrap draws as one matrix of the generator; ranks with ties and constant sides against scipy's definition."""
    from cairnlight.operators import metrics

    r = random.Random(12)
    rows = [(f"c{r.randrange(9)}", f"g{r.randrange(3)}", r.choice([0.0, 0.25, 0.5, 1.0, None]), r.choice([0.0, 0.5, 1.0])) for _ in range(300)] + [("c0", "flat", 1.0, 2.0), ("c1", "flat", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "company string, g string, x double, y double")
    kept = [(c, g, x, y) for c, g, x, y in rows if x is not None]
    names = sorted({c for c, *_ in kept})
    t = np.array([sum(x - y for c, _, x, y in kept if c == n) for n in names])
    k = np.array([sum(c == n for c, *_ in kept) for n in names], float)
    pick = np.random.default_rng(20260921).integers(0, len(names), (2000, len(names)))
    want = (t.sum() / k.sum(), *np.quantile(t[pick].sum(axis=1) / k[pick].sum(axis=1), [0.025, 0.975]))
    assert np.allclose(metrics.paired_difference(df, "company", "x", "y"), want, atol=1e-12)
    assert all(map(np.isnan, metrics.paired_difference(df.limit(0), "company", "x", "y")))

    def ranks(v):
        return [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]

    for row in metrics.spearman(df, "g", "x", "y").collect():
        x, y = zip(*[(a, b) for _, g, a, b in kept if g == row["g"]], strict=True)
        if row["g"] == "flat":
            assert row["rho"] is None and row["n"] == 2
        else:
            assert abs(row["rho"] - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-9 and row["n"] == len(x)
    lists = spark.createDataFrame([([1, 2], [True, False]), ([1], []), ([], []), (None, None)], "s array<int>, v array<boolean>")
    score, error = metrics.aligned_score(F.col("s"), F.col("v"))
    assert [tuple(x) for x in lists.select(score, error).collect()] == [(0.5, None), (None, "1 statements, 0 verdicts"), (None, "no statements"), (None, "no statements")]
