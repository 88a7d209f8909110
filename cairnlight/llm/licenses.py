"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import materialize

#: Least cosine of a line or a whole text with a template.
LEAST_COSINE = 0.6
#: A text is a licence file if at least this share of its words stands in matching lines.
FILE_SHARE = 0.5
#: A template of over so many words is also compared with runs of lines of about its length.
LONG_WORDS = 20
#: File names that make a matching text a licence file.
FILE_NAMES = r"(?i)^(un)?(licen[cs]e|copying|notice)([.-].*)?$"

#: Licence, then wordings of its statements and texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_py(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits, as ``words`` takes them."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def idf(n_docs: int, df: int) -> float:
    return math.log((1 + n_docs) / (1 + df)) + 1


class Weights:
    """Normalised TF-IDF vectors of the templates, and the words that any match must share with one of them.

    A text that only shares a template's lightest words cannot exceed their part of its norm, so the words that keep
    this part under the least cosine may be left aside when looking for candidates.
    """

    def __init__(self, templates: list[tuple[str, str]], n_docs: int, df: dict[str, int], least: float):
        self.rows: list[tuple[str, str, str, float]] = []
        self.idf = {w: idf(n_docs, df.get(w, 0)) for _, t in templates for w in words_py(t)}
        self.other = idf(n_docs, 0)
        self.must: set[str] = set()
        for name, text in templates:
            vector = {w: n * self.idf[w] for w, n in Counter(words_py(text)).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            self.rows += [(name, text, w, v / norm) for w, v in vector.items()]
            light = 0.0
            for w, v in sorted(vector.items(), key=lambda x: (x[1], x[0])):
                light += (v / norm) ** 2
                if light >= (least - 1e-9) ** 2:
                    self.must.add(w)


def _reaching(known: Column, squares: Column, least: float) -> Callable[[Column], Column]:
    def reaches(own: Column) -> Column:
        return F.aggregate(F.array_intersect(own, known), F.lit(0.0), lambda a, w: a + F.element_at(squares, w)) >= least * least - 1e-9

    return reaches


def _runs_from(lines: Column, size: int) -> Callable[[Column], Column]:
    def run(i: Column) -> Column:
        # Each line has a word at least.
        none = F.array().cast("array<string>")
        return F.aggregate(F.slice(lines, i, F.lit(size)), none, lambda a, x: F.when(F.size(a) >= size, a).otherwise(F.concat(a, x)))

    return run


def blocks(text: Column, weights: Weights, least: float) -> Column:
    """Runs of lines, as arrays of words, that can reach the least cosine with a long template.

    From each line on, a run goes until it has as many words as the template. Both vectors are normalised, so a cosine
    is at most the root of the sum of the template's squared weights over the words that a run has; only runs, and
    before them whole texts, whose sum reaches the square of the least cosine are kept.
    """
    lines = F.filter(F.transform(F.split(F.lower(text), "\n"), words), lambda x: F.size(x) > 0)
    out = F.array().cast("array<array<string>>")
    for template in dict.fromkeys(t for _, t, _, _ in weights.rows):
        size = len(words_py(template))
        if size <= LONG_WORDS:
            continue
        squares = {w: v * v for _, t, w, v in weights.rows if t == template}
        known, of = F.array(*map(F.lit, squares)), F.create_map(*(F.lit(x) for pair in squares.items() for x in pair))

        reaches, run = _reaching(known, of, least), _runs_from(lines, size)
        runs = F.filter(F.transform(F.sequence(F.lit(1), F.size(lines)), run), reaches)
        out = F.concat(out, F.when(reaches(words(text)), runs).otherwise(F.array().cast("array<array<string>>")))
    return F.array_distinct(out)


def directory(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "(?s)/[^/]*$", "")).otherwise("")


def scan(
    files: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    least: float = LEAST_COSINE,
) -> DataFrame:
    """Per file: id, path, ``license``, ``score``, ``origin`` (own, inherited or none) and ``from_dir``.

    Word frequencies come from all texts. Every line, every run of lines as long as a long template (``blocks``) and every
    whole text that can reach the least cosine is compared with all templates; the best cosine wins, the first licence in alphabetical order on a tie. A file without an own
    match takes the licence of the nearest directory above it that has a licence file (by name, or by the share of its
    words in matching lines; the best cosine wins among several). Null texts match nothing, a null path is the root,
    an empty table gives no rows, and repeated rows get one row each.
    """
    spark = files.sparkSession
    vocabulary = sorted({w for _, t in templates for w in words_py(t)})
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = files.select(F.explode(F.array_intersect(words(text), F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    weights = Weights(templates, files.count(), {r["w"]: r["count"] for r in seen.collect()}, least)

    must = rf"(?<![a-z0-9])({'|'.join(sorted(weights.must))})(?![a-z0-9])"
    line = F.filter(F.split(F.lower(text), "\n"), lambda x: x.rlike(must))
    hit = F.lower(text).rlike(must)
    units = F.when(hit, F.concat(F.transform(F.concat(F.array(text), line), words), blocks(text, weights, least)))
    rows = materialize(
        files.select(
            F.col(id_col).alias("id"),
            F.coalesce(path, F.lit("")).alias("path"),
            units.alias("units"),
            F.when(hit, F.size(line)).alias("lines"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    known = spark.createDataFrame(weights.rows, "license string, template string, word string, weight double")
    own_idf = spark.createDataFrame(sorted(weights.idf.items()), "word string, idf double")
    terms = (
        rows.where("units is not null")
        .select("row", F.posexplode("units").alias("unit", "words"))
        .select("row", "unit", F.explode("words").alias("word"))
        .groupBy("row", "unit", "word")
        .agg(F.count("*").alias("n"))
    )
    # Both tables have as many rows as the templates have words.
    terms = terms.join(F.broadcast(own_idf), "word", "left").withColumn("v", F.col("n") * F.coalesce("idf", F.lit(weights.other)))
    vectors = terms.groupBy("row", "unit").agg(
        F.sum("n").alias("n_words"),
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "v"))).alias("known"),
    )
    dots = (
        vectors.select("row", "unit", "n_words", "norm", F.explode("known").alias("t"))
        .select("row", "unit", "n_words", "norm", "t.word", "t.v")
        .join(F.broadcast(known), "word")
        .groupBy("row", "unit", "n_words", "norm", "license", "template")
        .agg((F.sum(F.col("v") * F.col("weight")) / F.col("norm")).alias("cosine"))
    )
    best = (
        dots.withColumn("cosine", F.round("cosine", 9))
        .where(F.col("cosine") >= least)
        .groupBy("row", "unit", "n_words")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    )
    sizes = F.size(F.get("units", F.lit(0)))
    # Runs of lines overlap, so the longest one counts, not their sum.
    single = (F.col("unit") > 0) & (F.col("unit") <= F.col("lines"))
    own = best.join(rows.select("row", "lines"), "row").groupBy("row").agg(
        F.min("b").alias("b"),
        F.greatest(F.sum(F.when(single, F.col("n_words"))), F.max(F.when(F.col("unit") > F.col("lines"), F.col("n_words")))).alias("in_lines"),
        F.min("unit").alias("first"),
    )
    matched = rows.where("units is not null").join(own, "row").withColumn("size", sizes)
    base = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    is_file = (F.col("first") == 0) | base.rlike(FILE_NAMES) | (F.coalesce("in_lines", F.lit(0)) >= FILE_SHARE * F.col("size"))
    matched = materialize(
        matched.select("row", directory(F.col("path")).alias("dir"), F.col("b.license").alias("license"), (-F.col("b.c")).alias("score"), is_file.alias("is_file"))
    )
    licensed = matched.where("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("c"), "license")).alias("d"))
    # Ancestors of distinct directories only: a directory with a third of all files is looked up once.
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    dirs = rows.select(directory(F.col("path")).alias("dir")).distinct()
    near = (
        dirs.select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "up"))
        .join(licensed.withColumnRenamed("dir", "up"), "up")
        .groupBy("dir")
        .agg(F.max_by(F.struct("up", "d"), "depth").alias("near"))
    )
    out = (
        rows.select("id", "path", "row", directory(F.col("path")).alias("dir"))
        .join(matched.select("row", "license", "score"), "row", "left")
        .join(near, "dir", "left")
    )
    own_license = F.col("license").isNotNull()
    inherited = F.col("near").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("license", "near.d.license").alias("license"),
        F.coalesce("score", -F.col("near.d.c")).alias("score"),
        F.when(own_license, "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(own_license, F.col("dir")).otherwise(F.col("near.up")).alias("from_dir"),
    )
