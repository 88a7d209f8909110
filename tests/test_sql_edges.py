"""Queries against their SQL, or against themselves in another order of rows, on small tables that the test data lack."""

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cairnlight.operators import retrieval as R
from cairnlight.plans import catalog
from cairnlight.plans import evidence as E
from pyspark.sql import functions as F


def written(folder, **tables):
    folder.mkdir(parents=True, exist_ok=True)
    for name, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), folder / f"{name}.parquet")
    return str(folder)


def rows_of(df):
    return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())


def same_as_sql(spark, folder, name):
    df, c = catalog.QUERIES[name](spark, folder), duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    cols = sorted(df.columns)
    found = c.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert got == sorted(found, key=repr)
    return got


def line(order, number, part, supp, quantity=1.0):
    return {"l_orderkey": order, "l_linenumber": number, "l_partkey": part, "l_suppkey": supp, "l_quantity": quantity, "l_returnflag": "N"}


def test_kernel_tables_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    lines = [line(k, n, 10 * k + n + 100 * again, again + 1) for k in range(1, 35) for n in (1, 2) for again in range(3)]
    one, two = written(tmp_path / "a", lineitem=lines), written(tmp_path / "b", lineitem=lines[::-1])
    for a, b in zip(E.kernel_tables(spark, one), E.kernel_tables(spark, two), strict=True):
        assert rows_of(a) == rows_of(b)
    same_as_sql(spark, one, "AG4_kernel_violations")
    same_as_sql(spark, two, "AG4_kernel_violations")


def test_kernel_violations_shuffle_lines_once(spark, tmp_path):
    """One shuffle of the lines by case serves all tables, and the lists of a case are not shuffled again."""
    lines = [line(k, n, 10 * k + n, n) for k in range(1, 35) for n in (1, 2)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.QUERIES["AG4_kernel_violations"](spark, written(tmp_path, lineitem=lines))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(") - plan.count("ReusedExchange") == 1


def test_first_seen_with_parts_of_a_million(spark, tmp_path):
    lines = [line(1, 1, 1_100_000, 7), line(1, 2, 5_000, 8), line(1, 3, 1, 7), line(2, 1, 3, 9)]
    assert same_as_sql(spark, written(tmp_path, lineitem=lines), "SC34_first_seen") == [("8,7", 1), ("9", 2)]


def test_representative_with_parts_of_a_million(spark, tmp_path):
    lines = [line(1, 1, 1_100_000, 7, 5.0), line(1, 2, 50_000, 8, 4.0), line(2, 1, 3, 9, 2.0), line(2, 2, 2, 9, 2.0)]
    assert same_as_sql(spark, written(tmp_path, lineitem=lines), "TK6_TK7_representative") == [(1, 50_000), (2, 2)]


def test_paragraphs_from_100_on(spark, tmp_path):
    text = "\n\n".join(f"block {k} is here" for k in range(1, 121)) + "\n\nshared end of it all, shared end of it all"
    docs = [{"doc_id": 1, "text": text}, {"doc_id": 2, "text": text.replace("shared", "block")}]
    folder = written(tmp_path, documents=docs, benchmark=[{"item_id": 2, "text": "block 105 is here"}])
    same_as_sql(spark, folder, "SC19_quote_paragraphs")
    assert (2, 0, "Paragraph 105", 1) in {(r[0], r[1], r[2], r[3]) for r in same_as_sql(spark, folder, "SC19_all_paragraphs")}


def test_quotes_by_lines_beside_whole_ones(spark, tmp_path):
    docs = [{"doc_id": k, "text": "First line of it.\nSecond line of it.\n\nA last one."} for k in (2, 4)]
    folder = written(tmp_path, documents=docs, benchmark=[{"item_id": 2, "text": "First line of it.\nSecond line of it."}])
    assert ("full_disclosure" in {r[1] for r in same_as_sql(spark, folder, "SC20_review_excerpts")})
    found = {r["doc_id"]: (r["mode"], r["unresolved"]) for r in catalog.QUERIES["SC20_review_lines"](spark, folder).collect()}
    assert found[2] == ("verbatim_line_segments", 0)


def test_all_bm25_scores_without_a_shuffle(spark, tmp_path, monkeypatch):
    words = "red green blue the of and".split()
    rows = [(f"d{i}", None if i % 11 == 0 else f"c{i % 3}", None if i % 7 == 0 else " ".join(words[j % 6] for j in range(i % 9))) for i in range(60)]
    cards = spark.createDataFrame(rows, "evidence_id string, company_id string, text string").where("company_id is not null")
    queries = spark.createDataFrame([(1, "red the"), (2, "unknown"), (3, "blue blue of")], "query_id long, text string")
    found = lambda df: {(r[0], r[1], r[2]): r[3] for r in df.select("query_id", "company_id", "evidence_id", "score").collect()}
    small, large = R.all_bm25(cards, queries, "company_id"), R.bm25_scores(cards, queries, "company_id")
    assert found(small) == pytest.approx(found(large), abs=1e-8) and found(small)
    assert R.all_bm25(cards.limit(0), queries, "company_id").count() == R.all_bm25(cards, queries.limit(0), "company_id").count() == 0
    folder = written(tmp_path, documents=[{"doc_id": i, "source": p, "text": t, "lang": "en"} for i, (_, p, t) in enumerate(rows) if p], benchmark=[{"item_id": 1, "text": "red the"}])
    plan = catalog.QUERIES["RT2_bm25_score"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    monkeypatch.setattr(R, "TABLE_CELLS", 1)
    assert found(R.all_bm25(cards, queries, "company_id")) == pytest.approx(found(large), abs=1e-8)


def test_a_pool_is_scored_a_few_rows_at_a_time(spark):
    rows = spark.range(5000).selectExpr("'p' AS pool", "id")

    def score(batch):
        if batch.num_rows > 512:
            raise ValueError(batch.num_rows)
        return np.array(batch.column(1).to_pylist(), float)[:, None] % 1000

    best = R._best(rows, score, [1], "long", "pool", "id", 6).orderBy("rank").collect()
    assert [r["id"] for r in best] == [999, 1999, 2999, 3999, 4999, 998]


@pytest.mark.parametrize(("name", "what", "most"), [("SM8_packets", "parsejson", 1), ("DD6_partition_replies", "parsejson", 1), ("SC26_SC27_patches", "sha2(", 2), ("DD9_replay", "sha2(", 2), ("DD10_baseline_audit", "regexp_replace(", 60), ("SC24_FIL10_prompts", "shown_in_prompt", 12)])
def test_costly_values_are_worked_out_once(spark, name, what, most):
    """An expression that a plan mentions many times is worked out as often."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.replace("parse_json", "parsejson").count(what) <= most


def test_texts_reach_python_a_few_at_a_time(spark):
    from cairnlight.functions import folds, text

    docs = spark.createDataFrame([(i, None if i == 3 else f"One {i}.\n\n# Head\n\nTwo.") for i in range(200)] + [(200, "")], "doc_id long, text string")
    spans = folds.paragraph_rows(docs, "doc_id", "text")
    assert "ArrowEvalPython" not in spans._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, spans.where("doc_id in (1, 3, 200)").collect())) == [(1, 0, 0, 6), (1, 1, 16, 20)] and spans.count() == 398
    digests = text.with_claim_digest(docs, "text", "k")
    plain = docs.select("doc_id", F.sha2(text.normalize_claim("text"), 256).alias("k"))
    assert rows_of(digests) == rows_of(plain)
