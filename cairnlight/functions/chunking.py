"""Texts cut into chunks by words: the cuts are places found by one fold over sizes, the chunks are slices between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlight.functions.text import clean_text, looks_like_table, word_count

#: A single chunk of over so many times the limit is cut by words.
SLACK = 1.5


def slices(items: Column, begins: Column) -> Column:
    """The parts of a list that begin at the ascending 0-based places ``begins``."""
    ends = F.slice(F.concat(begins, F.array(F.size(items))), F.lit(2), F.size(begins))
    return F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.slice(items, x["b"] + 1, x["e"] - x["b"]))


def packed(sizes: Column, most: int) -> Column:
    """Places at which a greedy packing begins a new part: where the running size would pass ``most``."""

    def step(s: Column, x: Column) -> Column:
        begins = (s["at"] == 0) | (s["total"] + x > most)
        return F.struct(
            F.when(begins, F.concat(s["places"], F.array(s["at"]))).otherwise(s["places"]).alias("places"),
            F.when(begins, x).otherwise(s["total"] + x).alias("total"),
            (s["at"] + 1).alias("at"),
        )

    return F.aggregate(sizes, F.struct(F.array().cast("array<int>").alias("places"), F.lit(0).alias("total"), F.lit(0).alias("at")), step)["places"]


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), clean_text)
    return F.filter(parts, lambda s: s != "")


def split_long_text(text: Column, max_words: int) -> Column:
    """Sentences packed to at most ``max_words`` words; longer sentences stand alone, and a text of one such part is cut
    every ``max_words`` words if it is over SLACK times as long."""
    found = F.transform(F.array(sentences(text)), lambda s: F.struct(s.alias("s"), packed(F.transform(s, word_count), max_words).alias("at")))
    parts = F.flatten(F.transform(found, lambda x: F.transform(slices(x["s"], x["at"]), lambda p: F.array_join(p, " "))))

    def by_words(p: Column) -> Column:
        words = F.split(p, " ")
        begins = F.sequence(F.lit(0), F.size(words) - 1, F.lit(max_words))
        return F.transform(slices(words, begins), lambda w: F.array_join(w, " "))

    return F.flatten(F.transform(F.array(parts), lambda p: F.when((F.size(p) == 1) & (word_count(F.get(p, F.lit(0))) > SLACK * max_words), by_words(F.get(p, F.lit(0)))).otherwise(p)))


def _groups(sizes: Column, least: int, most: int) -> Column:
    """Places at which a chunk begins: after a block of over ``most`` words and before it, and where ``least`` words are
    reached."""

    def step(s: Column, x: Column) -> Column:
        alone = x > most
        begins = s["closed"] | alone
        total = F.when(begins, x).otherwise(s["total"] + x)
        return F.struct(
            F.when(begins, F.concat(s["places"], F.array(s["at"]))).otherwise(s["places"]).alias("places"),
            total.alias("total"),
            (s["at"] + 1).alias("at"),
            (alone | (total >= least)).alias("closed"),
        )

    start = F.struct(F.array().cast("array<int>").alias("places"), F.lit(0).alias("total"), F.lit(0).alias("at"), F.lit(True).alias("closed"))
    return F.aggregate(sizes, start, step)["places"]


def narrative_chunks(blocks: Column, least: int = 40, most: int = 250, min_chars: int = 80, include_short: bool = False) -> Column:
    """Chunks of page blocks (structs of text, page, warnings): structs of text, page_start, page_end and warnings.

    Blocks gather until ``least`` words are reached. A block of over ``most`` words closes what has gathered, and its parts
    stand by themselves. A chunk of under ``min_chars`` characters is dropped, unless ``include_short``; one that is short
    in characters or words is marked, as is text that looks like a table and a chunk over several pages. Parts of a long
    block are marked by words only and never dropped.
    """
    clean = F.transform(blocks, lambda b: F.struct(clean_text(b["text"]).alias("text"), b["page"].alias("page"), F.coalesce(b["warnings"], F.array().cast("array<string>")).alias("warnings")))
    full = F.transform(F.filter(clean, lambda b: b["text"] != ""), lambda b: F.struct(b["text"].alias("text"), b["page"].alias("page"), b["warnings"].alias("warnings"), word_count(b["text"]).alias("words")))

    def marks(text: Column, given: Column, short: Column, pages: Column) -> Column:
        own = F.array(F.when(short, "very_short_chunk"), F.when(looks_like_table(text), "possible_table_text"), F.when(pages > 1, "page_break_joined"))
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(given, own))))

    def chunks(g: Column) -> Column:
        first = F.get(g, F.lit(0))
        pages = F.transform(g, lambda b: b["page"])
        given = F.flatten(F.transform(g, lambda b: b["warnings"]))
        start, end = F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end")
        parts = F.transform(split_long_text(first["text"], most), lambda p: F.struct(p.alias("text"), start, end, marks(p, given, word_count(p) < least, F.lit(1)).alias("warnings")))

        def whole(text: Column) -> Column:
            short = (F.length(text) < min_chars) | (word_count(text) < least)
            return F.struct(text.alias("text"), start, end, marks(text, given, short, F.size(F.array_distinct(pages))).alias("warnings"))

        joined = F.array(clean_text(F.array_join(F.transform(g, lambda b: b["text"]), " ")))
        kept = joined if include_short else F.filter(joined, lambda t: F.length(t) >= min_chars)
        return F.when(first["words"] > most, parts).otherwise(F.transform(kept, whole))

    grouped = F.transform(F.array(full), lambda f: F.transform(slices(f, _groups(F.transform(f, lambda b: b["words"]), least, most)), chunks))
    return F.flatten(F.flatten(grouped))
