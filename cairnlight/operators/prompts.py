"""Recorded prompts taken apart: the visible cards' blocks are found in order, and nothing else may stand between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlight.operators.validators import let

#: Fixed values of the prompt layout.
GROUP_TITLES = ("PDF Narrative Evidence", "PDF Table Row Evidence", "CSV Metric Evidence")
RULE = "-" * 50
DELIMITER = "\n\nEvidence\n\n"


def block(label: Column, source: Column, text: Column) -> Column:
    """How a card is written into a prompt."""
    return F.concat(label, F.lit("\n\nSource:\n"), source, F.lit("\n\nText:\n"), text)


def visible(cards: Column) -> Column:
    """Cards that the prompt shows, in order; a card of unknown visibility is not shown."""
    return F.filter(cards, lambda c: F.coalesce(c["shown_in_prompt"], F.lit(False)))


def placed(section: Column, blocks: Column) -> Column:
    """Each block's 0-based place behind the one before (null where it is not found there) and the text between; then
    where the last one ends. One pass over the section, whatever the number of blocks."""
    steps = F.array().cast("array<struct<start:int,gap:string>>")

    def step(state: Column, b: Column) -> Column:
        at = F.call_function("locate", b, section, state["end"] + 1) - 1
        found = (at >= 0) & (F.length(b) > 0)
        gap = F.substr(section, state["end"] + 1, at - state["end"])
        item = F.struct(F.when(found, at).alias("start"), F.when(found, gap).alias("gap"))
        return F.struct(F.concat(state["steps"], F.array(item)).alias("steps"), F.when(found, at + F.length(b)).otherwise(state["end"]).alias("end"))

    return F.aggregate(blocks, F.struct(steps.alias("steps"), F.lit(0).alias("end")), step)


def parsed(prompt: Column, instruction: Column, cards: Column) -> Column:
    """Struct of errors, contexts, evidence_ids, prompt_labels and starts of a recorded prompt.

    ``cards`` are structs of evidence_id, prompt_label, source_label, retrieval_text, retrieval_text_hash and
    shown_in_prompt. A context is a block under the title of its group. Errors: ``layout`` if the prompt does not begin
    with the instruction and the delimiter; by card ``hash``, ``absent`` (or out of order), ``unmapped`` (other text
    before it), ``no_group`` (no title yet); ``residue`` behind the last block, ``no_evidence``, ``duplicate_label`` and
    ``duplicate_id``. Null prompts and instructions break the layout, null cards are none.
    """
    shown = F.coalesce(visible(cards), cards_type())
    head = F.concat(F.lit("Instruction\n\n"), instruction, F.lit(DELIMITER))
    fits = F.coalesce(F.startswith(prompt, head), F.lit(False))
    section = F.when(fits, F.substr(prompt, F.length(head) + 1)).otherwise("")
    written = lambda cards: F.transform(cards, lambda c: block(c["prompt_label"], c["source_label"], c["retrieval_text"]))
    read = lambda v, blocks: let(placed(v["section"], blocks), lambda found: _read(v["section"], v["fits"], v["shown"], blocks, found))
    return let(F.struct(section.alias("section"), fits.alias("fits"), shown.alias("shown")), lambda v: let(written(v["shown"]), lambda blocks: read(v, blocks)))


def cards_type() -> Column:
    return F.array().cast("array<struct<evidence_id:string,prompt_label:string,source_label:string,retrieval_text:string,retrieval_text_hash:string,shown_in_prompt:boolean>>")


def _title(gap: Column) -> Column:
    """What stands between two blocks, without outer blanks and a rule before it."""
    return F.regexp_replace(_strip(gap), f"^{RULE}\n\n", "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _read(section: Column, fits: Column, shown: Column, blocks: Column, found: Column) -> Column:
    # One struct per card, so that what is looked up once is not worked out again for each use.
    rows = F.transform(
        F.arrays_zip(shown.alias("card"), blocks.alias("block"), found["steps"].alias("step")),
        lambda x: F.struct(x["card"].alias("card"), x["block"].alias("block"), x["step"]["start"].alias("start"), _title(x["step"]["gap"]).alias("title")),
    )
    return let(rows, lambda r: let(_grouped(r), lambda kept: _judged(section, fits, shown, found, kept)))


def _grouped(rows: Column) -> Column:
    groups = F.aggregate(
        rows,
        F.array().cast("array<string>"),
        lambda g, r: F.concat(g, F.array(F.when(F.length(r["title"]) > 0, r["title"]).otherwise(F.get(g, F.size(g) - 1)))),
    )
    return F.transform(F.arrays_zip(rows.alias("r"), groups.alias("group")), lambda x: F.struct(x["r"]["card"].alias("card"), x["r"]["block"].alias("block"), x["r"]["start"].alias("start"), x["r"]["title"].alias("title"), x["group"].alias("group")))


def _judged(section: Column, fits: Column, shown: Column, found: Column, kept: Column) -> Column:
    def by_card(rule: str, broken) -> Column:  # noqa: ANN001
        return F.transform(F.filter(kept, broken), lambda k: F.concat(F.lit(f"{rule}: "), F.coalesce(k["card"]["prompt_label"], F.lit(""))))

    def whole(rule: str, broken: Column) -> Column:
        return F.when(broken, F.array(F.lit(rule))).otherwise(F.array().cast("array<string>"))

    labels, ids = shown["prompt_label"], shown["evidence_id"]
    errors = F.when(~fits, F.array(F.lit("layout"))).otherwise(
        F.concat(
            by_card("hash", lambda k: ~k["card"]["retrieval_text_hash"].eqNullSafe(F.sha2(k["card"]["retrieval_text"], 256))),
            by_card("absent", lambda k: k["start"].isNull()),
            by_card("unmapped", lambda k: (F.length(k["title"]) > 0) & ~k["title"].isin(*GROUP_TITLES)),
            by_card("no_group", lambda k: k["start"].isNotNull() & k["group"].isNull()),
            whole("residue", F.length(_strip(F.substr(section, found["end"] + 1))) > 0),
            whole("no_evidence", F.size(shown) == 0),
            whole("duplicate_label", F.size(F.array_distinct(labels)) < F.size(labels)),
            whole("duplicate_id", F.size(F.array_distinct(ids)) < F.size(ids)),
        )
    )
    contexts = F.transform(kept, lambda k: F.concat(k["group"], F.lit("\n\n"), k["block"]))
    return F.struct(errors.alias("errors"), contexts.alias("contexts"), ids.alias("evidence_ids"), labels.alias("prompt_labels"), F.transform(kept, lambda k: k["start"]).alias("starts"))
