"""Golden vectors and plain-Python models of the operators."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cairnlight.functions import chunking
from cairnlight.functions import text as X
from cairnlight.operators import metrics as M
from cairnlight.operators import retrieval as R
from cairnlight.operators import sampling as S
from cairnlight.sources import files
from cairnlight.streaming import live


def test_hamilton():
    q = S.hamilton({"a": 1, "b": 2, "c": 47}, 30)
    assert sum(q.values()) == 30 and q["a"] == 1 and q["b"] <= 2
    assert q == S.hamilton({"c": 47, "b": 2, "a": 1}, 30)
    with pytest.raises(ValueError):
        S.hamilton({"a": 2, "b": 2, "c": 2}, 2)


def test_bm25_order(spark):
    cards = spark.createDataFrame([("p", "a", "emissions climate"), ("p", "b", "workforce safety safety")], "pool string, evidence_id string, text string")
    q = spark.createDataFrame([(1, "climate")], "query_id int, text string")
    rows = R.rank_bm25(cards, q, "pool", 10).orderBy("rank").collect()
    assert [r["evidence_id"] for r in rows] == ["a", "b"] and rows[1]["score"] == 0


def test_bm25_against_python(spark):
    rnd = random.Random(1)
    texts = {f"d{i:02d}": " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))) for i in range(30)}
    cards = spark.createDataFrame([("p", k, t) for k, t in texts.items()], "pool string, evidence_id string, text string")
    q = spark.createDataFrame([(1, "a b a h")], "query_id int, text string")
    docs = {k: t.split() for k, t in texts.items()}
    avg, n = sum(map(len, docs.values())) / len(docs), len(docs)
    want = {}
    for k, d in docs.items():
        s = 0.0
        for t in ("a", "b", "h"):
            df, tf = sum(t in x for x in docs.values()), d.count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        want[k] = s
    order = sorted(want, key=lambda k: (-round(want[k], 9), k))[:5]
    rows = R.rank_bm25(cards, q, "pool", 5).orderBy("rank").collect()
    assert [r["evidence_id"] for r in rows] == order
    assert all(abs(r["score"] - want[r["evidence_id"]]) < 1e-6 for r in rows)


def test_bm25_small_and_large_query_side(spark, monkeypatch):
    """Tables in every task and joins give the same lists; null texts and pools without any shared term too."""
    rnd = random.Random(5)
    text = lambda: " ".join(rnd.choice("abcdefghij") * 2 for _ in range(rnd.randint(0, 12)))
    cards = spark.createDataFrame([(f"p{i % 3}", f"e{i:03d}", text() if i % 17 else None) for i in range(120)] + [("q", "z", "none")], "pool string, evidence_id string, text string")
    q = spark.createDataFrame([(i, text()) for i in range(8)] + [(9, "")], "query_id long, text string")
    monkeypatch.setattr(R, "SCORE_CELLS", 100)
    small = sorted(map(tuple, R.rank_bm25(cards, q, "pool", 5).select("query_id", "pool", "evidence_id", "rank").collect()))
    large = sorted(map(tuple, R.rank_bm25_joined(cards, q, "pool", 5).select("query_id", "pool", "evidence_id", "rank").collect()))
    assert small == large and len(small) == 9 * (3 * 5 + 1)
    assert R.rank_bm25(cards.limit(0), q, "pool", 5).count() == R.rank_bm25(cards, q.limit(0), "pool", 5).count() == 0


def test_rows_before_ranking(spark, monkeypatch):
    """What tasks pass on is near the size of the lists, however many pools and batches there are."""
    rows = [(f"p{i % 1500}" if i % 3 else "hot", f"e{i:05d}", "a b" if i % 2 else "b") for i in range(9000)]
    cards = spark.createDataFrame(rows, "pool string, evidence_id string, text string").repartition(4)
    q = spark.createDataFrame([(i, "a b"[: 1 + 2 * (i % 2)]) for i in range(6)], "query_id int, text string")
    ranked = R.ranked
    monkeypatch.setattr(R, "ranked", lambda df, *_: df)
    passed = R.rank_bm25(cards, q, "pool", 5).count()
    monkeypatch.setattr(R, "ranked", ranked)
    lists = R.rank_bm25(cards, q, "pool", 5).count()
    assert lists <= passed <= lists + 4 * 6 * 5


def test_dense(spark):
    pool = spark.createDataFrame([("a", 1, [2.0, 0.0]), ("b", 1, [0.0, 1.0])], "id string, k int, vector array<float>")
    q = spark.createDataFrame([(1, 1, [1.0, 0.0])], "query_id int, k int, query_vector array<float>")
    assert R.rank_dense(pool, q, "k", 5, "id").orderBy("rank").first()["score"] == 2.0
    unit = pool.withColumn("vector", R.normalised(F.col("vector")))
    assert R.rank_dense(unit, q, "k", 5, "id").orderBy("rank").first()["score"] == 1.0


def test_stratified_keeps_unused_places_empty(spark):
    df = spark.range(35).select(F.lit(1).alias("case"), F.lit("narrative").alias("kind"), (F.col("id") + 1).cast("int").alias("rank"))
    assert R.stratified(df, ["case"], "kind", 10).count() == 10


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", 1.0, 1)] * 9 + [("b", 0.0, 1)], "company string, total double, n int")
    assert M.cluster_bootstrap(df, "company", "total", "n", 1000) == (0.9, 0.0, 1.0)


def test_glyph_gate(spark):
    df = spark.createDataFrame([("\ue000" * 240,), ("text \ue000",)], "t string")
    assert [r[0] for r in df.select(X.glyph_reason(F.col("t"))).collect()] == ["unmapped_font_glyphs", None]


def test_render_once(spark):
    row = spark.createDataFrame([("{b}", "x")], "a string, b string").select(X.render("{a} and {b}, {c}", {"a": F.col("a"), "b": F.col("b")}).alias("t")).first()
    assert row["t"] == "{b} and x, {c}"


def test_numbers_and_cells(spark):
    cases = {"(1,234)": 1234.0, "1.234,5": 1.2345, "12 %": 12.0, "": None, "x": None, ".5": 0.5, "+3": 3.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", X.parse_number(F.col("t"))).collect()} == cases
    cells = [("Value", "n/a", "missing"), ("Year", "2023", "year"), ("Unit", "MWh", "unit"), ("V", "(5)", "number"), ("V", "5%", "percent"), ("V", "tCO2e", "unit"), ("V", "hello", "text")]
    df = spark.createDataFrame(cells, "h string, c string, want string")
    assert df.where(X.cell_type(F.col("h"), F.col("c")) != F.col("want")).count() == 0
    assert X.unique_headers(["a", "", "a", None]) == (["a", "unnamed_column_1", "a__2", "unnamed_column_3"], ["duplicate_column_headers", "empty_column_header"])
    assert X.unique_headers(["a  b ", "a b"])[0] == ["a b", "a b__2"]


def test_unicode_text(spark):
    texts = ["Straße  ﬁn", "A B", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.normalize_claim("t")).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts]
    assert [r[0] for r in df.select(X.clean_text(F.col("t"))).collect()] == ["Straße ﬁn", "A B", "", ""]


def test_exact_units(spark):
    """Accents, case folding and compatibility forms count as Python has them; no row is left out."""
    from cairnlight.plans import corpus

    rows = [(1, "de", "Straße  ﬁn"), (2, "de", "STRASSE fin"), (3, "fr", "Été"), (4, "fr", "e\u0301te\u0301"), (5, "en", "\u201cx\u201d y"), (6, "en", "a b"), (7, "de", "a b")]
    want = {}
    for i, lang, t in rows:
        want.setdefault((lang, " ".join(unicodedata.normalize("NFKC", t).casefold().split())), []).append(i)
    got = corpus.exact_units(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()
    assert sorted((r["lang"], r["representative"], r["n"], r["occurrences"]) for r in got) == sorted((k[0], v[0], len(v), ",".join(map(str, v))) for k, v in want.items())
    assert len(got) == 5


def test_rank_dense_all(spark, monkeypatch):
    """Many blocks on either side, ties by id, against a plain sort."""
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    monkeypatch.setattr(R, "POOL_BLOCK", 7)
    rnd = random.Random(2)
    v = [[float(rnd.randrange(-3, 4)) for _ in range(5)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(v)), "n long, vector array<float>")
    pool = df.select(F.concat(F.lit("v"), "n").alias("id"), "vector")
    got = R.rank_dense_all(pool, df.where("n % 3 = 0").select(F.col("n").alias("query_id"), F.col("vector").alias("query_vector")), 6).collect()
    want = []
    for q in range(0, 60, 3):
        best = sorted((-sum(x * y for x, y in zip(v[q], w, strict=True)), f"v{i}") for i, w in enumerate(v))[:6]
        want += [(q, i, -s, k) for k, (s, i) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in got) == sorted(want)


def plain_words(text):
    return len(re.findall(r"\b\S+\b", text))


def plain_parts(text, most):
    """Runs of sentences, as many as fit; found by trying the longest run first."""
    left, out = [" ".join(s.split()) for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()], []
    while left:
        n = max([k for k in range(1, len(left) + 1) if sum(map(plain_words, left[:k])) <= most] or [1])
        out.append(" ".join(left[:n]))
        left = left[n:]
    if len(out) == 1 and plain_words(out[0]) > 1.5 * most:
        w = out[0].split()
        return [" ".join(w[i : i + most]) for i in range(0, len(w), most)]
    return out


def plain_table(t):
    return sum(ch.isdigit() for ch in t) / max(len(t), 1) > 0.18 and (len(re.findall(r"\d+(?:[,.]\d+)*", t)) >= 4 or "|" in t or "\t" in t)


def plain_chunks(blocks, least, most, min_chars):
    blocks = [(" ".join(t.split()), p) for t, p in blocks if t.strip()]
    out, held = [], []
    for k, (text, page) in enumerate(blocks):
        if plain_words(text) <= most:
            held.append((text, page))
        last = k + 1 == len(blocks) or plain_words(blocks[k + 1][0]) > most
        if held and (plain_words(text) > most or last or sum(plain_words(t) for t, _ in held) >= least):
            whole, pages = " ".join(t for t, _ in held), {p for _, p in held}
            marks = ["very_short_chunk"] * (len(whole) < min_chars or plain_words(whole) < least) + ["possible_table_text"] * plain_table(whole) + ["page_break_joined"] * (len(pages) > 1)
            out += [(whole, min(pages), max(pages), sorted(marks))] * (len(whole) >= min_chars)
            held = []
        if plain_words(text) > most:
            out += [(p, page, page, sorted(["very_short_chunk"] * (plain_words(p) < least) + ["possible_table_text"] * plain_table(p))) for p in plain_parts(text, most)]
    return out


def test_long_texts(spark):
    r = random.Random(9)
    texts = ["One two. Three four. Five six.", " ".join(["w"] * 20), "", "  ", "a. b. c. d. e. f. g. h. i.", "one two three four five six seven! a b. c?  d", None]
    texts += ["".join(r.choice(["ab ", "c. ", "d! ", "-- ", "e  ", "f?\n", "g "]) for _ in range(r.randrange(40))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chunking.split_long_text(F.col("t"), 4)).collect()
    assert [r[0] for r in got] == [plain_parts(t or "", 4) for t in texts]


def test_chunks(spark):
    r = random.Random(10)
    word = lambda: r.choice(["alpha", "12", "3,4", "|", "be", "gamma.", "7!"])
    docs = []
    for _ in range(60):
        pages = sorted(r.randrange(1, 4) for _ in range(r.randrange(9)))
        docs.append([(" ".join(word() for _ in range(r.choice([0, 2, 5, 12, 25]))), p, None) for p in pages])
    kind = "k int, b array<struct<text:string,page:int,warnings:array<string>>>"
    got = spark.createDataFrame(list(enumerate(docs)), kind).select("k", chunking.narrative_chunks(F.col("b"), 8, 16, 20).alias("c")).collect()
    for row in got:
        assert [(c["text"], c["page_start"], c["page_end"], c["warnings"]) for c in row["c"]] == plain_chunks([(t, p) for t, p, _ in docs[row["k"]]], 8, 16, 20)
    short = spark.createDataFrame([(0, [("tiny", 1, ["w"])])], kind).select(F.inline(chunking.narrative_chunks(F.col("b"), include_short=True))).first()
    assert tuple(short) == ("tiny", 1, 1, ["very_short_chunk", "w"])


def test_spearman(spark):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in [(1, 2), (2, 1), (2, 3), (4, 4)]], "g string, x double, y double")
    rho = M.spearman(df, "g", "x", "y").first()["rho"]
    assert abs(rho - 0.632455532) < 1e-6


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "id string, v double")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2
    files.write_csv(df, str(tmp_path / "c"), ["v", "id"])
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("v", T.DoubleType()), T.StructField("id", T.StringType())])
    assert files.read_csv(spark, str(tmp_path / "c"), schema, ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        files.write_jsonl(spark.createDataFrame([(float("nan"),)], "v double"), str(tmp_path / "n"))
    (tmp_path / "r").mkdir()
    (tmp_path / "r/acme_2021_AR.pdf").write_bytes(b"%PDF-1.7")
    assert files.read_reports(spark, str(tmp_path / "r")).first()["company"] == "acme"
    (tmp_path / "names").write_text("acme # first\n# none\n\nbeta\n")
    assert files.read_names(spark, str(tmp_path / "names")).count() == 2
    a, b = df.limit(1), df.withColumn("v", F.lit(9.0))
    assert {r["id"]: r["v"] for r in files.fallback_index(a, b, None, "id").collect()}["b"] == 9.0


def test_live_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01", "error", 1.0), (1, "2024-01-01 00:00:01", "error", 1.0), (2, "2024-01-01 00:00:30", "view", 3.0)], "id int, ts string, event_type string, value double")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.json(str(tmp_path / "log"))
    stream = live.first_records(live.tail(spark, str(tmp_path / "log"), rows.schema, 10), ["id"], "ts")
    q = stream.writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2
    top = live.sliding_summary(rows.dropDuplicates()).orderBy(F.desc("n")).first()
    assert top["n"] == 2 and top["errors"] == 1


def test_folds():
    from cairnlight.functions import folds

    assert [p[2] for p in folds.paragraphs("# Head\n\none two\nthree\n\n---\n\nfour")] == ["one two\nthree", "four"]
    text = "a\n\n b c \n\nd"
    assert all(text[s:e] == t for s, e, t in folds.paragraphs(text))
    assert folds.batches([5, 5, 5, 20, 1], 2, 12) == [0, 0, 1, 2, 3]
    assert folds.water_fill({"a": 5, "b": 1, "c": 4}, {"a": 9, "b": 2, "c": 9}, 4) == {"a": 1, "b": 2, "c": 1}
    assert [p[2] for p in folds.paragraphs("#hashtag text\n\n===\n\n## Head\n***\n \n\n a | b ")] == ["#hashtag text", "===", "a | b"]
