"""Source divergence, token counts and phrases against plain Python, on whole small tables and on edge cases."""

import os
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from cairnlight.llm import divergence, phrases, queries, tokencount
from cairnlight.llm.common import slices

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, phrase string, k int, a int, rank string, vector string"
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (None, "x " * 3000, "fr", None), (5, "\n\t ", None, "b"), (6, "éé ñ 日本 <s> <unk>", "es", "b"), (7, "One. two, ONE two? a\tb", "en", "c")]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "t", 1, "p", 2, 3, "r", "v") for r in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_slices():
    for text in (b"", b"ab", b"a b c d", b"abcdefgh", b"ab cdefghij k", b"   "):
        got = list(slices(text, b" ", 3))
        assert b"".join(got) == text and all(x.endswith(b" ") for x in got[:-1])


# 11


def plain_audit(rows, min_docs):
    """(lang, source, part, item, value, rank) with Python's whole numbers, term by term."""
    rows = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == lang]
        docs = Counter(t for r in here for t in set(r[2]))
        kept = sorted(t for t in docs if docs[t] >= min_docs)
        groups = {s: Counter(t for r in here if r[1] == s for t in r[2] if docs[t] >= min_docs) for s in {r[1] for r in here}}
        whole = sum(groups.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in groups.items():
            pairs = [(-sum(f(share(c, t), share(d, t)) for t in kept), o.encode()) for o, d in groups.items() if o != s]
            terms = [(-f(share(c, t), share(whole, t)), t.encode()) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


def test_op11_edges(spark, edge):
    for least in (1, 2, 10):
        assert sorted(map(tuple, divergence.audit(edge, least).collect())) == plain_audit([r[1:4] for r in EDGE], least)
    assert divergence.audit(edge.limit(0)).count() == 0


def test_op11_ties_and_flushes(spark, monkeypatch):
    """Few words, many equal vectors and equal values; tasks pass on their counts and sums again and again."""
    r = random.Random(4)
    rows = [(" ".join(r.choices(["b", "É", "a", "Bb", "zz z", "c-d", "ee"], k=r.randrange(9))), r.choice(["en", "de", None]), r.choice(["s1", "é", "S1", "z", ""])) for _ in range(300)]
    monkeypatch.setattr(divergence, "HELD", 3)
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3), 5)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 5)


def test_op11_shares_are_exact():
    counts = np.array([0, 1, 7, 10**6, 4 * 10**15], np.int64)
    for size in (10, 999_999_937, 8_999_999_999_999_999):
        ok = [c for c in counts.tolist() if c + 2 <= size]
        assert divergence.shares(np.array(ok, np.int64), size).tolist() == [1 + 10**9 * (c + 2) // size for c in ok]


def test_op11_vector_is_evaluated_once(spark):
    """A thousand terms with equal counts are one row of the pair sums."""
    text = " ".join(f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(1000))
    rows = [(f"{text} only" if i % 2 else text, "en", f"s{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    vectors = divergence.count_vectors(docs).where("term <> ''")
    assert (vectors.count(), vectors.select("vector").distinct().count()) == (1001, 2)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(rows, 10)


# 12


def test_op12(spark, library):
    got = queries.QUERIES["op12_token_counts"](spark, SF).toPandas().set_index("doc_id").sort_index()
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").sort_index()
    want = [len(x) for x in library.encode(docs.text.tolist())]
    assert got.n_tokens.tolist() == want and got.n_bytes.tolist() == [len(t.encode()) for t in docs.text]
    assert got.over_limit.tolist() == [n > 4096 for n in want]


@pytest.mark.parametrize("alphabet", [" ab\n\t▁<s>0x", "aeinorst ", "éñ日本語😀 a\x00", " ", None])
@pytest.mark.parametrize("chunk", [1, 5, 1 << 16])
def test_op12_random_texts(library, alphabet, chunk):
    """All chunk sizes, runs of blanks, the blank's own mark, special strings, characters without a piece."""
    r = random.Random(5)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    t = tokencount.Transducer(MODEL)
    for _ in range(300):
        text = "".join(r.choices(list(alphabet) if alphabet else pieces, k=r.randrange(40)))
        assert t.count(text, chunk) == len(library.encode(text)), text


def test_op12_maps_compose_in_any_order():
    t = tokencount.Transducer(MODEL)
    text = "▁the▁▁▁quick▁brown" + "▁" * 20 + "foxabcdefgh▁x"
    maps = [t.chunk(text[i : i + 3]) for i in range(0, len(text), 3)]
    whole = t.chunk(text)
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = t.compose(left, m)
    for m in reversed(maps[:-1]):
        right = t.compose(m, right)
    scanned = t.scan(maps)
    assert left == right == scanned[-1] and t.tokens(left) == t.tokens(whole)
    assert [t.tokens(m) for m in scanned] == [t.tokens(t.chunk(text[: 3 * i + 3])) for i in range(len(maps))]


def test_op12_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "HELD", 20)
    t = tokencount.Transducer(MODEL)
    for text in pd.read_parquet(f"{SF}/documents.parquet").text.head(20):
        assert t.count(text) == len(library.encode(text))
    assert len(t.held) <= 21


def test_op12_long_text_without_blanks(library):
    r = random.Random(6)
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=200_000))
    assert tokencount.Transducer(MODEL).count(text) == len(library.encode(text))


def test_op12_edges(spark, edge, library):
    got = [tuple(r) for r in tokencount.count_tokens(edge, MODEL, max_tokens=3).collect()]
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 3) for r in EDGE]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert tokencount.count_tokens(edge.limit(0), MODEL).count() == 0


# 13


def plain_phrases(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from counters of all phrases."""
    f, out = {}, []
    for text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * c[q]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_op13_edges(spark, edge):
    for least in (1, 2):
        assert sorted(map(tuple, phrases.mine(edge, least).collect())) == plain_phrases([r[1:3] for r in EDGE], least)
    assert phrases.mine(edge.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1 << 22, 50])
def test_op13_ties_overlaps_and_shards(spark, monkeypatch, shard):
    """Few words: overlapping phrases of one word, equal scores, subsumed pairs; shards end anywhere between texts."""
    r = random.Random(7)
    words = ["a", "A", "b", "ab", "é", "日本", "x|y", "\x00", "b. a", "c\td", "b:", "z z z z"]
    rows = [(" ".join(r.choices(words, k=r.randrange(12))), r.choice(["en", "en", None, "und"])) for _ in range(400)]
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    got = phrases.mine(spark.createDataFrame(rows, "text string, lang string").repartition(3), 4, top=25)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 4, 25)


def test_op13_full_filter_loses_nothing(spark, monkeypatch):
    """Where the filter lets every pair pass, the result is the same."""
    rows = [(r.text, r.lang) for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()]
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "pair_filter", lambda pairs: np.full(phrases.FILTER_BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, phrases.mine(docs).collect())) == plain_phrases(rows)


def test_op13_filter_drops_rare_pairs(spark):
    """Phrases of three words leave a task only where both pairs are frequent."""
    rows = [("new york city", "en")] * 12 + [(f"new york w{i} x{i}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string").select("lang", "text")
    pairs = phrases._reduced(docs, phrases._short, 10).where("k = 2")
    assert {r["phrase"] for r in pairs.collect()} == {"new york", "york city"}
    bits = spark.sparkContext.broadcast(phrases.pair_filter(pairs))
    rows = docs.mapInArrow(phrases._long(bits), phrases._SCHEMA).collect()
    assert {r["phrase"] for r in rows} == {"new york city"}


def test_op13_suffix_links():
    """Links lead to the phrase without its first word, and counts never grow along a substring's extension."""
    r = random.Random(8)
    words = np.array([r.randrange(-1, 5) for _ in range(2000)], np.int32)
    one, two, three = phrases.suffix_automaton(words, 3)
    pairs = list(zip(two.head.tolist(), two.last.tolist(), strict=True))
    assert two.link.tolist() == two.last.tolist()
    assert [pairs[k][0] for k in three.link] == [pairs[k][1] for k in three.head] and [pairs[k][1] for k in three.link] == three.last.tolist()
    assert (three.count <= two.count[three.link]).all() and (two.count <= one.count[two.link]).all()
