"""Secret scans: patterns, and a randomness test battery with false-discovery control. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import materialize

#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Pattern of each base kind.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: What the battery tests: runs of 16 or more characters of the usual encodings, with padding.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Pieces of a candidate that are tested besides the whole: between the separators that an encoding cannot have.
PIECES = [CANDIDATE, r"[A-Za-z0-9_-]{16,}={0,2}", r"[A-Za-z0-9+/]{16,}={0,2}", r"[A-Za-z0-9]{16,}={0,2}"]
#: Encoding, pattern, alphabet in code order, and the sum of squared letter shares of words written in it.
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef", 0.2),
    ("upper_hex", r"^[0-9A-F]+$", "0123456789ABCDEF", 0.2),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065),
    ("base36", r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.065),
    ("base62", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.06),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.06),
    ("base64url", r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.06),
]
#: A candidate is not random if the three tests together have a smaller p-value.
BATTERY_LEVEL = 0.001
#: Share of ordinary words that may be among the reported candidates of a class of encoding and length.
FALSE_SHARE = 0.05
#: p-values are counted in eighths of a decade, down to 1e-20.
_BINS, _PER_DECADE = 160, 8
MASK = "[SECRET]"
#: Matches that are appended one by one.
_BLOCK = 128


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, kind, token>>, in code points.

    What lies between the matches, from ``split``, gives their places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    row = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("token"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>")
    first = F.struct(F.lit(0).cast("int").alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["gap"])
        e = s + F.length(x["token"])
        one = F.struct(s.alias("start"), e.alias("end"), F.lit(kind).alias("kind"), x["token"].alias("token"))
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    # Appending copies, so a block of matches is built by itself, and only blocks are appended to the whole.
    def block(a: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(row, i * _BLOCK + 1, F.lit(_BLOCK)), F.struct(a["at"].alias("at"), none.alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(a["out"], F.array(own["out"])).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int"))
    nested = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<array<struct<start:int,end:int,kind:string,token:string>>>").alias("out"))
    few = F.aggregate(row, first, step, lambda a: a["out"])
    many = F.flatten(F.aggregate(blocks, nested, block, lambda a: a["out"]))
    return F.when(text.rlike(pattern), F.when(F.size(found) <= _BLOCK, few).otherwise(many)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds; matches that are too short are dropped after matching."""
    assign = F.filter(
        match_spans(text, PATTERNS["assign"], "assign"),
        lambda m: F.length(F.regexp_extract(m["token"], PATTERNS["assign"], 2)) >= LEAST["assign"],
    )
    access = F.filter(match_spans(text, PATTERNS["access"], "access"), lambda m: F.length(m["token"]) >= LEAST["access"])
    return F.concat(assign, access, match_spans(text, PATTERNS["hex"], "hex"))


def upper_tail(z: Column) -> Column:
    """P(normal > z): a rational approximation in the middle, the asymptotic series beyond 3."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    middle = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = density / x * (1 - 1 / (x * x) + 3 / (x * x * x * x))
    p = F.when(x > 3, far).otherwise(middle)
    return F.greatest(F.when(z < 0, 1 - p).otherwise(p), F.lit(1e-300))


def upper_point(p: Column) -> Column:
    """The z with P(normal > z) = p, by a rational approximation."""
    q = F.greatest(F.least(p, 1 - p), F.lit(1e-300))
    u = F.sqrt(-2 * F.log(q))
    z = u - (2.515517 + u * (0.802853 + u * 0.010328)) / (1 + u * (1.432788 + u * (0.189269 + u * 0.001308)))
    return F.when(p <= 0.5, z).otherwise(-z)


def battery(tokens: DataFrame) -> DataFrame:
    """Add ``encoding``, ``n``, ``stratum``, ``p_random`` and ``p_word`` to rows with a ``token``.

    Under uniform random characters of the inferred alphabet: chi-squared of the character counts (Wilson-Hilferty),
    Wald-Wolfowitz runs about the middle of the alphabet, and lag-one serial correlation of the codes. Fisher's method
    joins them to ``p_random``.

    ``p_word`` is the largest chance that a word of this length and alphabet has so small a joint statistic: the sum of
    the three logarithms is at least the one of chi-squared, so it is the chance that a word's chi-squared, whose
    non-centrality grows with the length, stays below the value that would make up the whole sum. A token that the
    battery rejects as random at ``BATTERY_LEVEL`` has 1. ``stratum`` is the class of encoding and length. Tokens of
    digits only, or without an encoding, are dropped.
    """
    bare = F.regexp_replace("token", "=+$", "")
    name, alphabet, share = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for n, pattern, letters, s in reversed(ENCODINGS):
        fits = F.col("bare").rlike(pattern)
        name, alphabet, share = F.when(fits, n).otherwise(name), F.when(fits, letters).otherwise(alphabet), F.when(fits, s).otherwise(share)
    df = tokens.withColumn("bare", bare).where(~F.col("bare").rlike(r"^\d*$"))
    df = df.withColumns({"encoding": name, "alphabet": alphabet, "share": share}).where("encoding is not null")
    df = df.withColumns({"n": F.length("bare").cast("double"), "a": F.length("alphabet").cast("double")})
    # The split also leaves an empty string at the end.
    df = df.withColumn("chars", F.filter(F.split("bare", ""), lambda c: c != ""))
    df = df.withColumn("x", F.expr("transform(chars, c -> cast(locate(c, alphabet) - 1 as double))"))
    df = df.withColumn("squares", F.expr("aggregate(array_distinct(x), 0D, (s, v) -> s + pow(size(filter(x, y -> y = v)), 2))"))
    df = df.withColumns(
        {
            "chi2": F.expr("a / n * squares - n"),
            "high": F.expr("cast(size(filter(x, v -> v >= a / 2)) as double)"),
            "runs": F.expr("1D + size(filter(sequence(1, size(x) - 1), i -> (x[i] >= a / 2) <> (x[i - 1] >= a / 2)))"),
            "mean": F.expr("aggregate(x, 0D, (s, v) -> s + v) / n"),
        }
    )
    df = df.withColumns(
        {
            "var": F.expr("aggregate(x, 0D, (s, v) -> s + (v - mean) * (v - mean))"),
            "lagged": F.expr("aggregate(sequence(1, size(x) - 1), 0D, (s, i) -> s + (x[i] - mean) * (x[i - 1] - mean))"),
            "pairs": F.expr("2 * high * (n - high)"),
        }
    )
    df = df.withColumns(
        {
            "z1": F.expr("(pow(chi2 / (a - 1), 1 / 3D) - (1 - 2 / (9 * (a - 1)))) / sqrt(2 / (9 * (a - 1)))"),
            "z2": F.expr("case when pairs > n then (runs - 1 - pairs / n) / sqrt(pairs * (pairs - n) / (n * n * (n - 1))) else 8D end"),
            "z3": F.expr("case when var > 0 then (lagged / var + 1 / n) * sqrt(n) else 8D end"),
            "extra": F.expr("(n - 1) * (a * share - 1)"),
        }
    )
    df = df.withColumns(
        {
            "p1": upper_tail(F.col("z1")),
            "p2": F.least(2 * upper_tail(F.abs("z2")), F.lit(1.0)),
            "p3": F.least(2 * upper_tail(F.abs("z3")), F.lit(1.0)),
        }
    )
    df = df.withColumn("half", -F.log("p1") - F.log("p2") - F.log("p3"))
    df = df.withColumn("zt", upper_point(F.exp(-F.col("half"))))
    df = df.withColumn("most", F.expr("(a - 1) * pow(greatest(1 - 2 / (9 * (a - 1)) + zt * sqrt(2 / (9 * (a - 1))), 0D), 3)"))
    joined = upper_tail(F.expr("(a - 1 + extra - most) / sqrt(2 * (a - 1) + 4 * extra)"))
    df = df.withColumn("p_random", F.expr("exp(-half) * (1 + half + half * half / 2)"))
    kinds = F.array(*(F.lit(n) for n, *_ in ENCODINGS))
    return df.withColumns(
        {
            "p_word": F.when(F.col("p_random") >= BATTERY_LEVEL, F.least(joined, F.lit(1.0))).otherwise(1.0),
            "stratum": (F.array_position(kinds, F.col("encoding")) * 100 + F.least(F.floor(F.log2("n") * 2), F.lit(40))).cast("int"),
        }
    ).drop(*"bare alphabet share a chars x squares chi2 high runs mean var lagged pairs z1 z2 z3 extra p1 p2 p3 half zt most".split())


def cutoffs(tested: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """Lowest bin of ``p_word`` that is reported in each class, by Benjamini-Hochberg over binned p-values of all tokens.

    The table of counts has at most one row for each class and bin. A bin counts with its largest p-value, so the
    control errs on the safe side; a class without an acceptable bin is left out.
    """
    rows = tested.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect()
    out = {}
    for s in sorted({r["stratum"] for r in rows}):
        own = {r["bin"]: r["n"] for r in rows if r["stratum"] == s}
        total, above = sum(own.values()), 0
        for b in sorted(own, reverse=True):
            above += own[b]
            if 10 ** (-b / _PER_DECADE) * total <= share * above:
                out[s] = b
    return out


def pieces(m: Column, base: Column) -> Column:
    """Spans to test in a candidate: what ``PIECES`` find in it where no base span is."""
    size = F.length(m["token"])

    def blank(t: Column, b: Column) -> Column:
        s, e = F.greatest(b["start"] - m["start"], F.lit(0)), F.least(b["end"] - m["start"], size)
        return F.concat(F.substring(t, F.lit(1), s), F.repeat(F.lit(" "), e - s), F.substring(t, e + 1, size))

    inside = F.filter(base, lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"]))
    bare = F.aggregate(inside, m["token"], blank)
    found = F.array_distinct(F.concat(*(match_spans(bare, p, "random") for p in PIECES)))
    return F.transform(found, lambda x: F.struct((x["start"] + m["start"]).alias("start"), (x["end"] + m["start"]).alias("end"), x["token"].alias("token")))


def scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, false_share: float = FALSE_SHARE) -> DataFrame:
    """Each row's columns ``carry`` with ``found``: array<struct<start, end, rank>> in code points, end exclusive.

    Base kinds come from patterns. A candidate's pieces outside them, the whole and those between separators, are each
    reported as ``random`` if ``p_word``, which joins the three tests, is below the cutoff of its encoding and length; a
    piece inside another reported one is left out. Null and empty texts have no spans.
    Repeated rows are scanned one by one, yet all count as candidates of their class. Only rows with candidates are
    joined with the findings, by a row number that is written down first.
    """
    carry = docs.columns if carry is None else carry
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)]
    rows = materialize(
        docs.select(*kept, base_spans(text).alias("base"), match_spans(text, CANDIDATE, "random").alias("more"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    # Only now, when the spans are written: as one plan, the patterns would be matched anew for every candidate.
    whole = rows.where(F.size("more") > 0).select("row", "base", F.explode("more").alias("m"))
    tokens = whole.select("row", F.explode(pieces(F.col("m"), F.col("base"))).alias("m")).select("row", "m.*")
    # Written before any filter on the figures, which would be pushed down and repeat their expressions.
    tested = materialize(battery(tokens).select("row", "start", "end", "stratum", "p_random", "p_word"))
    bins = F.least(F.floor(-F.log10("p_word") * _PER_DECADE), F.lit(_BINS)).cast("int")
    tested = tested.withColumn("bin", bins)
    least = cutoffs(tested, false_share)
    passes = F.lit(False)
    for s, b in least.items():
        passes = passes | ((F.col("stratum") == s) & (F.col("bin") >= b))
    random = F.struct("start", "end", F.lit(KINDS.index("random")).alias("rank"))
    new = tested.where(passes).groupBy("row").agg(F.collect_list(random).alias("new"))
    within = lambda x, y: (x != y) & (y["start"] <= x["start"]) & (x["end"] <= y["end"])
    new = new.withColumn("new", F.filter("new", lambda x: ~F.exists("new", lambda y: within(x, y))))
    listed = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), (F.array_position(listed, b["kind"]) - 1).cast("int").alias("rank")))
    names = [F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)]
    plain = rows.where(F.size("more") == 0).select(*names, base.alias("found"))
    none = F.array().cast("array<struct<start:int,end:int,rank:int>>")
    joined = rows.where(F.size("more") > 0).join(new, "row", "left").select(*names, F.concat(base, F.coalesce("new", none)).alias("found"))
    return plain.unionByName(joined).withColumn("found", F.array_sort("found"))


def spans_text(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, by start, then kind, comma-joined."""
    listed = F.array(*map(F.lit, KINDS))
    own = F.filter(found, lambda s: s["rank"].isin([KINDS.index(k) for k in kinds]))
    order = F.array_sort(F.transform(own, lambda s: F.struct(s["start"], s["rank"], s["end"])))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(listed, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redact(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with every span (sorted by start) replaced by ``mask``; overlapping spans become one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        new = F.when(s["start"] >= a["at"], F.concat(a["out"], gap, F.lit(mask))).otherwise(a["out"])
        return F.struct(new.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    done = F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of the scan masked; ``n_chars``, if there, follows. Null texts stay null."""
    found = scan(docs, text_col)
    new = redact(F.col(text_col), F.col("found"))
    out = found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("found") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
