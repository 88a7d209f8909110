"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm import decontam, divergence, fuzzydup, langid, licenses, neardup, packing, phrases, quality, secretscan, sharding, tokencount, urlfilter
from cairnlight.llm.common import table


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), num_shards=8)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        "source_cell",
        "lang_cell",
        "size_cell",
    )


#: Fixed values of the URL query: action, then host and start of the path.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("host_words", " ").alias("host_words"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()), "text", "lang")
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = secretscan.spans_text(F.col("found"), ("assign", "access", "hex"))
    return out.select(
        "doc_id",
        *(secretscan.count_kind(F.col("found"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(base, 256).alias("base_sha256"),
        secretscan.spans_text(F.col("found")).alias("spans"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzydup.fuzzy_passages(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def base1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: sizes, and that the shards' row counts are at most one apart."""
    out = op1_hilbert_sharding(spark, sf_dir)
    shards = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"))
    law = shards.agg((F.max("n") - F.min("n") <= 1).alias("even"), F.bool_and(F.col("last") + 1 == F.col("n")).alias("gapless"))
    # One row.
    return out.select("doc_id", "size", "law").crossJoin(F.broadcast(law))


def base2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: host, path and rule."""
    return op2_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule")


def base4_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: all but the method's verdict."""
    return op4_quality_rules(spark, sf_dir).drop("kept", "score")


def base8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: numbers of base spans."""
    return op8_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_BASE1_SQL = "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, 'rows' AS law, true AS even, true AS gapless FROM documents"

_BASE2_SQL = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS (SELECT rule, split_part(rule, '/', 1) AS own, substring(rule, instr(rule, '/')) AS prefix FROM (VALUES {", ".join(f"('{t}')" for _, t in URL_RULES)}) v(rule))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
       (SELECT max_by(rule, length(rule)) FROM r WHERE (u.host = own OR ends_with(u.host, '.' || own)) AND starts_with(u.path, prefix)) AS rule
FROM u
"""

_BASE4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)
"""

_BASE8_SQL = r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM documents
"""

_OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
placed AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS k
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size)
), hit AS (SELECT r, i, placed.size, item FROM placed JOIN win ON placed.k = win.k AND placed.size = win.size),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""

_OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
lng AS (SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS size FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_grid AS (SELECT lang, source, term, coalesce(n, 0) AS n, total FROM grp JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS g FROM full_grid),
p AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (CAST(g AS HUGEINT) + 2 * v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (CAST(size AS HUGEINT) + 2 * v) AS q
  FROM sized JOIN lng USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
found AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

_OP13_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k) GROUP BY ALL
), n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r,
         CAST(1000000 AS HUGEINT) * CAST(c.f AS HUGEINT) * CAST(c.f AS HUGEINT) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
gone AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s
  JOIN (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) x
  ON x.lang = s.lang AND x.phrase = s.phrase AND 100 * x.f >= 50 * s.f
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best ANTI JOIN gone USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_url_filters": op2_url_filters,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scans": op8_secret_scans,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scans": op10_license_scans,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_phrase_collocations": op13_phrase_collocations,
    "base1_sizes": base1_sizes,
    "base2_rules": base2_rules,
    "base4_figures": base4_figures,
    "base8_counts": base8_counts,
}

ORACLES: dict[str, str] = {
    "op6_benchmark_decontamination": _OP6_SQL,
    "op11_source_divergence": _OP11_SQL,
    "op13_phrase_collocations": _OP13_SQL,
    "base1_sizes": _BASE1_SQL,
    "base2_rules": _BASE2_SQL,
    "base4_figures": _BASE4_SQL,
    "base8_counts": _BASE8_SQL,
}
