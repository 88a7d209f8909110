"""Near-duplicates by Order MinHash over word shingles, verified by banded alignment."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.llm import common
from cairnlight.llm.align import components, similarity_at_least
from cairnlight.llm.common import id_type, map_rows

#: Words in a shingle, sketches of a text, shingles in a sketch.
SHINGLE, SKETCHES, TAKEN = 5, 80, 2
#: Hashes that the sketches of a text are chosen from at a time.
CELLS = 1_000_000
#: Largest bucket whose pairs are rows; a larger one is dealt out in blocks of about ``BLOCK`` texts.
CROWD, BLOCK = 32, 128
#: Rows of blocks, and words of texts, that one call of Python takes, on average.
LOT, LOT_WORDS = 2_000, 4_000
#: Texts with a word up to which they meet in one call; those of a more frequent word are dealt out in blocks.
HOT = 2_048
#: Bytes of a batch that goes to Python.
BATCH_BYTES = 16_000_000
#: Counters of a text's bag of hashed words, and of the texts that have a hashed word.
BAG, COUNTERS = 256, 1 << 21
#: Least similarity: 1 - word edit distance / words of the longer text.
LEAST = 0.8

_rng = np.random.Generator(np.random.PCG64(20_240_101))
_MULTIPLIERS = _rng.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(1 << 62, size=256, dtype=np.uint64)
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


def materialize(df: DataFrame) -> DataFrame:
    return common.materialize(df, batch_bytes=BATCH_BYTES)


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, each joined with how often the same shingle came before."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * _MULTIPLIERS[200 + i]
        out ^= out >> np.uint64(29)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    if not fresh.all():
        starts = np.flatnonzero(fresh)
        label = np.empty(len(out), np.uint64)
        label[order] = np.arange(len(out)) - np.repeat(starts, np.diff(np.append(starts, len(out))))
        out = out + label * _MIX
    return out


def order_sketches(hashes: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN) -> list[int]:
    """For each sketch, a key of its ``taken`` smallest shingles in text order; texts with fewer use all.

    Sketches are taken many at a time, as long as their table of hashes stays under ``CELLS`` cells.
    """
    n, out = len(hashes), []
    for first in range(0, sketches, step := max(1, CELLS // n)):
        j = np.arange(first, min(first + step, sketches))
        v = (hashes ^ _OFFSETS[j, None]) * _MULTIPLIERS[j, None]
        v ^= v >> np.uint64(32)
        v *= _MIX
        at = np.empty((len(j), min(taken, n)), np.int64)
        for t in range(at.shape[1]):
            at[:, t] = v.argmin(axis=1)
            v[np.arange(len(j)), at[:, t]] = np.iinfo(np.uint64).max
        at.sort(axis=1)
        key = (j + 1).astype(np.uint64)
        for t in range(at.shape[1]):
            key = (key ^ hashes[at[:, t]]) * _MIX + _ODD
            key ^= key >> np.uint64(31)
        out += key.view(np.int64).tolist()
    return out


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, node, text) of all rows with a text: the id as text, null as empty, and the digest of the text."""
    return docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
        F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("node"),
        F.col(text_col).alias("text"),
    )


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes whose texts align; ``texts`` has one row for each node."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("right"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "left", "right")

    def per_task():
        return lambda u, v, a, b: (u, v, similarity_at_least(a.split(), b.split(), least))

    return map_rows(both, per_task, "u binary, v binary, similarity double", binary=["left", "right"]).where("similarity is not null")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components."""
    own = pairs.join(comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u", "left")
    own = own.join(comp.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v", "left")
    return own.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = LEAST,
    sketches: int = SKETCHES,
    taken: int = TAKEN,
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, ``representative``, ``n_copies``, ``class_size``, ``keep``, ``node``.

    Equal texts are one node (``node`` is their MD5 digest, null for a null text). Nodes that share a sketch are
    candidates, and are linked if their word alignment reaches ``least``; classes are the connected components, named
    by their smallest id. ``representative`` is the smallest id with the same text, ``n_copies`` the number of rows
    that have it, and ``keep`` is true for one row of each class.

    All members of a bucket are compared with its smallest node. Where more than one component is left, every pair of
    members of different components is compared too: as rows in a bucket of at most ``CROWD``; texts of larger ones are
    looked up by their rarest words (``_crowded``). No candidate is dropped.
    A null text is a class of its own; empty texts are copies of each other; null ids come after all others.
    """
    rows = tagged(docs, id_col, text_col)

    def per_task():
        def per_row(i, key, node, text):
            words = text.split()
            return i, key, node, len(words), order_sketches(shingle_hashes(words), sketches, taken) if words else []

        return per_row

    schema = f"id {id_type(docs, id_col)}, key string, node binary, n int, keys array<long>"
    all_rows = materialize(map_rows(rows, per_task, schema, binary=["text"]).withColumn("row", F.monotonically_increasing_id()))
    first_row = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "key")).alias("first")
    nodes = materialize(
        all_rows.groupBy("node").agg(first_row, F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    buckets = nodes.select("node", "n", F.posexplode("keys").alias("sketch", "bucket"))
    tops = buckets.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("top"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(
        buckets.join(tops, "bucket").select("bucket", "sketch", "node", "n", F.col("top.node").alias("top"), F.col("top.n").alias("top_n"))
    )
    needed = shared.select("node").distinct().join(nodes.select("node", "first.key"), "node")
    texts = materialize(rows.join(needed, ["node", "key"]).select("node", "text").dropDuplicates(["node"]))

    def alike(a: str, b: str) -> Column:
        return F.least(a, b) >= F.greatest(a, b) * F.lit(least) - F.lit(1e-9)

    voted = materialize(
        shared.where((F.col("node") != F.col("top")) & alike("n", "top_n"))
        .groupBy(F.col("node").alias("u"), F.col("top").alias("v"))
        .agg(F.count("*").alias("votes"))
    )
    # Each node's most voted leader first; of the others only those that are still in another component.
    best = voted.groupBy("u").agg(F.max(F.struct("votes", "v")).alias("b")).select("u", F.col("b.v").alias("v"))
    edges = materialize(verified(best, texts, least).select("u", "v"))
    comp = components(edges)
    rest = _apart(voted.join(best, ["u", "v"], "left_anti").select("u", "v"), comp)
    edges, comp = _grown(edges, comp, verified(rest, texts, least))
    left = shared.where(F.col("node") != F.col("top")).select("bucket", "sketch", "node", "n")
    own = left.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = own.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size"))
    left = materialize(own.join(mixed.where("a <> b").select("bucket", "size"), "bucket"))
    few = left.where(F.col("size") <= CROWD).select("bucket", "node", "n", "comp")
    others = few.select("bucket", F.col("node").alias("v"), F.col("n").alias("vn"), F.col("comp").alias("vc"))
    pairs = few.join(others, "bucket").where((F.col("node") > F.col("v")) & (F.col("comp") != F.col("vc")) & alike("n", "vn"))
    pairs = pairs.select(F.col("node").alias("u"), "v")
    edges, comp = _grown(edges, comp, verified(pairs.distinct(), texts, least))
    many = left.where(F.col("size") > CROWD).select("node", "n").distinct()
    if not many.isEmpty():
        edges, comp = _grown(edges, comp, _crowded(many, comp, texts, least))

    named = materialize(nodes.join(comp, "node", "left").select("node", "first", "n_copies", F.coalesce("comp", "node").alias("comp")))
    classes = named.groupBy("comp").agg(F.min("first").alias("head"), F.sum("n_copies").alias("class_size"), F.count("*").alias("members"))
    classes = materialize(classes)
    # A class with a hundredth of all nodes would meet in one task; there are at most a hundred such.
    most = max(100, classes.agg(F.sum("members")).first()[0] or 0) / 100
    large, small = classes.where(F.col("members") >= most), classes.where(F.col("members") < most)
    with_class = named.join(F.broadcast(large), "comp").unionByName(named.join(F.broadcast(large.select("comp")), "comp", "left_anti").join(small, "comp"))
    of_node = with_class.select(
        "node",
        F.col("head.id").alias("class_id"),
        F.col("first.id").alias("representative"),
        "n_copies",
        "class_size",
        F.col("head.row").alias("kept"),
    )
    out = all_rows.select("id", "node", "row").join(of_node, "node")
    out = out.select("id", "class_id", "representative", "n_copies", "class_size", (F.col("row") == F.col("kept")).alias("keep"), "node")
    one = F.lit(1).cast("long")
    i = F.col(id_col)
    alone = docs.where(F.col(text_col).isNull()).select(
        i.alias("id"), i.alias("class_id"), i.alias("representative"), one.alias("n_copies"), one.alias("class_size"), F.lit(True).alias("keep"), F.lit(None).cast("binary").alias("node")
    )
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def word_bag(words: list[bytes]) -> bytes:
    """Counts of the hashed words, up to 65,535 each. An edit moves two bags apart by at most one on either side."""
    h = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BAG
    return np.minimum(np.bincount(h, minlength=BAG), 65_535).astype("<u2").tobytes()


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(13)).astype(np.int64) % COUNTERS


def _word_counts(texts: DataFrame) -> np.ndarray:
    """For each of ``COUNTERS`` cells the number of texts with a numbered word in it: four bytes each, whatever the input.

    A task sends its counts as 64 parts, which are added part by part.
    """

    def count(batches):
        seen = np.zeros(COUNTERS, "<i4")
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen[_cells(shingle_hashes(text.split(), 1))] += 1
        yield pa.RecordBatch.from_pydict({"part": range(64), "counts": [x.tobytes() for x in np.split(seen, 64)]}, schema=_COUNTS)

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, "<i4") for x in group["counts"].to_pylist()], axis=0, dtype="<i4")
        return pa.Table.from_pydict({"part": [group["part"][0].as_py()], "counts": [total.tobytes()]}, schema=_COUNTS)

    parts = texts.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    return np.frombuffer(b"".join(bytes(r["counts"]) for r in sorted(parts.collect())), "<i4")


def rarest(words: list[bytes], counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest numbered words of a text, one more than the edits it may take, sorted by value.

    Each edit takes away one word at most. So two texts within the bound share so many numbered words that, in any one
    order of all words, a shared one is among the first ``edits + 1`` of both. A word that no other text has is left out.
    """
    tokens = shingle_hashes(words, 1)
    seen = counts[_cells(tokens)]
    first = np.lexsort((tokens, seen))[: int(len(words) * (1 - least) + 1e-9) + 1]
    return np.sort(tokens[first[seen[first] > 1]].view(np.int64))


def _near(node: list, n: np.ndarray, comp: list, bag: np.ndarray, key: list[np.ndarray], meetings: Iterable[tuple[int, np.ndarray, np.ndarray | None]], least: float) -> pa.Table:
    """Candidates of texts that meet under a word: on the left and on the right, or all with each other.

    Texts of one component are not paired, nor those of too different sizes or bags. A pair is left to the smallest word
    that both texts have. One row: the texts in use, and pairs of their places, the nearest first, so that each that
    aligns spares the pairs that it makes one component.
    """
    names = {c: k for k, c in enumerate(dict.fromkeys(comp))}
    of = np.array([names[c] for c in comp])
    found = []
    for word, left, right in meetings:
        for place, u in enumerate(left):
            v = left[place + 1 :] if right is None else right
            v = v[(of[v] != of[u]) & (np.minimum(n[v], n[u]) >= np.maximum(n[v], n[u]) * least - 1e-9)]
            if not len(v):
                continue
            apart = bag[v] - bag[u]
            edits = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
            fits = edits <= (np.maximum(n[v], n[u]) * (1 - least) + 1e-9).astype(np.int64)
            near = zip(edits[fits].tolist(), v[fits].tolist(), strict=True)
            found += [(e, int(u), x) for e, x in near if np.intersect1d(key[u], key[x], assume_unique=True)[0] == word]
    found.sort()
    used = sorted({x for _, u, v in found for x in (u, v)})
    place = {x: k for k, x in enumerate(used)}
    flat = [place[x] for _, u, v in found for x in (u, v)]
    members = [{"node": node[x], "comp": int(of[x])} for x in used]
    return pa.Table.from_pydict({"members": [members] if used else [], "pairs": [flat] if used else []}, schema=_CANDIDATES)


def _bags(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<u2").reshape(-1, BAG).astype(np.int32)


def _met(bags: DataFrame, comp: DataFrame, least: float) -> DataFrame:
    """Candidates (members, pairs) of texts that meet under a word of ``cold``: of at most ``HOT`` texts.

    A task packs its texts and their words by lots of words, and a lot takes a call of Python, so texts are sent once for
    a lot and task, not as a row for each word.
    """
    lots = (bags.agg(F.sum(F.size("cold"))).first()[0] or 0) // LOT_WORDS + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, 4096) for b in batches for k in range(0, b.num_rows, 4096)):
            cold, size = part["cold"], np.diff(np.asarray(part["cold"].offsets))
            words = np.asarray(cold.flatten())
            text = np.repeat(np.arange(part.num_rows), size)
            lot = ((words.view(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64) % lots
            order = np.argsort(lot, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lot[order])) + 1):
                if len(own):
                    rows, at = np.unique(text[own], return_inverse=True)
                    texts = part.select(["node", "n", "comp", "bag", "keys"]).take(pa.array(rows)).to_struct_array()
                    lists = [pa.array([int(lot[own[0]])], pa.int64()), pa.ListArray.from_arrays([0, len(rows)], texts), pa.ListArray.from_arrays([0, len(own)], pa.array(words[own])), pa.ListArray.from_arrays([0, len(own)], pa.array(at.astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays(lists, names=["lot", "texts", "words", "at"])

    def meet(group: pa.Table) -> pa.Table:
        sizes = np.array([len(x) for x in group["texts"]])
        texts = group["texts"].combine_chunks().flatten()
        at = np.concatenate([np.array(x.as_py(), np.int64) + s for x, s in zip(group["at"], np.cumsum(sizes) - sizes, strict=True)])
        words = np.concatenate([np.array(x.as_py(), np.int64) for x in group["words"]])
        order = np.argsort(words, kind="stable")
        begins = np.flatnonzero(np.append(True, words[order][1:] != words[order][:-1]))
        meetings = ((int(words[own[0]]), at[own], None) for own in np.split(order, begins[1:]) if len(own) > 1)
        column = lambda name: texts.field(name).to_pylist()
        return _near(column("node"), np.array(column("n"), np.int64), column("comp"), _bags(column("bag")), [np.array(k, np.int64) for k in column("keys")], meetings, least)

    named = bags.join(comp, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"), "bag", "keys", "cold")
    packed = named.mapInArrow(pack, "lot long, texts array<struct<node:binary,n:int,comp:binary,bag:binary,keys:array<long>>>, words array<long>, at array<int>")
    return packed.groupBy("lot").applyInArrow(meet, "members array<struct<node:binary,comp:int>>, pairs array<int>")


def _met_hot(bags: DataFrame, comp: DataFrame, least: float) -> DataFrame:
    """``_met`` for the words of ``hot``. Of a word with several components, members outside the largest are dealt into
    blocks, and so are those inside; each of the former blocks meets all blocks."""
    own = bags.select("node", F.explode("hot").alias("bucket"))
    own = materialize(own.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    sizes = own.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("size"))
    sizes = sizes.where(F.col("size") > F.col("main.k")).select(
        "bucket",
        F.col("main.comp").alias("main"),
        F.ceil((F.col("size") - F.col("main.k")) / BLOCK).cast("int").alias("outer"),
        F.ceil(F.col("main.k") / BLOCK).cast("int").alias("inner"),
    )
    inside = F.col("comp") == F.col("main")
    salt = F.xxhash64("node", F.lit(1))
    own = own.join(sizes, "bucket").withColumn("own", F.when(inside, F.col("outer") + F.pmod(salt, "inner")).otherwise(F.pmod(salt, "outer")).cast("int"))
    last = F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "bucket", "node", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def candidates(group: pa.Table) -> pa.Table:
        home, word = np.array(group["own"]), np.array(group["bucket"], np.int64)
        low, high = np.array(group["i"]), np.array(group["j"])
        order = np.lexsort((high, low, word))
        new = np.any([x[order][1:] != x[order][:-1] for x in (word, low, high)], axis=0)

        def meetings():
            for met in np.split(order, np.flatnonzero(new) + 1):
                lower, upper = low[met[0]], high[met[0]]
                yield int(word[met[0]]), met[home[met] == lower], None if lower == upper else met[home[met] == upper]

        key = [np.array(x, np.int64) for x in group["keys"].to_pylist()]
        return _near(group["node"].to_pylist(), np.array(group["n"], np.int64), group["comp"].to_pylist(), _bags(group["bag"].to_pylist()), key, meetings(), least)

    dealt = materialize(dealt)
    lot = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(dealt.count() // LOT + 1)).alias("lot")
    return dealt.join(bags.select("node", "n", "bag", "keys"), "node").groupBy(lot).applyInArrow(candidates, "members array<struct<node:binary,comp:int>>, pairs array<int>")


def _crowded(many: DataFrame, comp: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) that join the components of all similar texts among ``many``, with (node, n), from crowded buckets.

    A text meets others under each of its rarest words, so a passage that all share brings none of them together. Pairs
    are aligned unless they are in one component already or the word bags alone rule them out, so the result is that of
    all pairs. Words of over ``HOT`` texts are dealt out in blocks: there rows grow with the square of the texts over
    ``BLOCK``, where the rarest words of many unlike texts are the same.
    """
    marked = materialize(texts.join(many, "node"))
    counts = marked.sparkSession.sparkContext.broadcast(_word_counts(marked))

    def mark_task():
        def per_row(node, n, text):
            words = text.split()
            keys = rarest(words, counts.value, least)
            hot = counts.value[_cells(keys.view(np.uint64))] > HOT
            return node, n, word_bag(words), keys.tolist(), keys[~hot].tolist(), keys[hot].tolist()

        return per_row

    bags = materialize(map_rows(marked.select("node", "n", "text"), mark_task, "node binary, n int, bag binary, keys array<long>, cold array<long>, hot array<long>", binary=["text"]))
    close = _met(bags, comp, least)
    hot = bags.where(F.size("hot") > 0)
    if not hot.isEmpty():
        close = close.unionByName(_met_hot(hot, comp, least))
    close = materialize(close.withColumn("task", F.monotonically_increasing_id()))
    placed = close.select("task", F.posexplode("members").alias("place", "m")).select("task", "place", "m.node", "m.comp").join(texts, "node")
    lists = close.select("task", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("node"), F.lit(None).cast("int").alias("comp"), F.lit(None).cast("string").alias("text"), "pairs")

    def align(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["place", "node", "comp", "text", "pairs"]).to_pylist(), key=lambda r: r["place"])
        flat, rows = rows[0]["pairs"], rows[1:]
        words = [r["text"].encode().split() for r in rows]
        parent = {r["comp"]: r["comp"] for r in rows}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = {"u": [], "v": []}
        for u, v in zip(flat[::2], flat[1::2], strict=True):
            a, b = root(rows[u]["comp"]), root(rows[v]["comp"])
            if a != b and similarity_at_least(words[u], words[v], least) is not None:
                parent[a] = b
                out["u"].append(rows[u]["node"])
                out["v"].append(rows[v]["node"])
        return pa.Table.from_pydict(out, schema=_EDGES)

    both = placed.withColumn("pairs", F.lit(None).cast("array<int>")).select("task", "place", "node", "comp", "text", "pairs").unionByName(lists)
    return both.groupBy("task").applyInArrow(align, "u binary, v binary")


_COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
_CANDIDATES = pa.schema([("members", pa.list_(pa.struct([("node", pa.binary()), ("comp", pa.int32())]))), ("pairs", pa.list_(pa.int32()))])
_EDGES = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _grown(edges: DataFrame, comp: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and components with the pairs ``found`` added."""
    more = materialize(found.select("u", "v"))
    if more.isEmpty():
        return edges, comp
    # Only components that a new pair joins change: unite their labels, then rename.
    a, b = comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), comp.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    joins = more.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    names = components(materialize(joins.distinct())).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    alone = names.join(comp.select(F.col("comp")).distinct(), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("new").alias("comp"))
    renamed = comp.join(names, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return edges.unionByName(more), materialize(renamed.unionByName(alone))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, all columns; rows with a null text stay."""
    kept = near_duplicates(docs, id_col, text_col).where("keep and node is not null")
    kept = kept.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), F.col("node").alias("_node"))
    own = docs.withColumns(
        {"_key": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_node": F.unhex(F.md5(F.col(text_col).cast("binary")))}
    )
    one = own.where("_node is not null").join(kept, ["_key", "_node"], "left_semi").dropDuplicates(["_key", "_node"])
    return one.select(*docs.columns).unionByName(docs.where(F.col(text_col).isNull()))
