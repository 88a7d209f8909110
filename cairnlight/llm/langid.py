"""Language identification: script ranges, character-trigram word scores and a Viterbi pass over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.common import id_type, map_rows

#: Buckets of hashed character trigrams for each language.
BUCKETS = 1 << 15
#: Added to each bucket's count.
PRIOR = 0.5
#: What a change of language between two words costs, in log-probability.
SWITCH = 12.0
#: A language has a script if at least this share of its training letters is in it.
SCRIPT_SHARE = 0.005
#: Letters scored at once.
BLOCK = 1 << 20
UNDETERMINED = "und"

#: First and last code points of script ranges of the Unicode standard.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@lru_cache(1)
def _letters() -> np.ndarray:
    """Script number of each code point that is a letter (0: none of the listed scripts), 255 for the others."""
    out = np.zeros(0x110000, np.uint8)
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            out[low : high + 1] = n
    other = np.fromiter((not chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    out[other] = 255
    return out


class Words:
    """Letters of a text by words: trigram buckets of each letter, and where words start among the letters."""

    def __init__(self, text: str, buckets: int = BUCKETS):
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
        script = _letters()[points]
        letter = script != 255
        code = np.where(letter, points, 0).astype(np.uint64)
        at = np.flatnonzero(letter)
        h = (code[at - 1] * np.uint64(0x9E3779B1) + code[at]) * np.uint64(0x85EBCA77) + code[at + 1] * np.uint64(0xC2B2AE3D)
        self.buckets = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (buckets - 1)
        self.scripts = script[at]
        self.starts = np.flatnonzero(~letter[at - 1])
        self.sizes = np.diff(np.append(self.starts, len(at)))
        self.at = at - 1

    def __len__(self) -> int:
        return len(self.starts)


class Model:
    """Log-probabilities of trigrams by language, and which scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        p = counts + PRIOR
        self.logs = np.log(p / p.sum(axis=0)).astype(np.float32)
        uses = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=0), 1)
        uses[~uses.any(axis=1)] = True
        self.barred = np.where(uses, 0, -1e6).astype(np.float32)

    def word_scores(self, words: Words) -> np.ndarray:
        """Score of each word in each language; languages that don't use the script of its first letter are barred."""
        out = np.empty((len(words), len(self.langs)))
        first = 0
        while first < len(words):
            last = max(first + 1, int(np.searchsorted(words.starts, words.starts[first] + BLOCK)))
            low, high = words.starts[first], words.starts[last] if last < len(words) else len(words.buckets)
            out[first:last] = np.add.reduceat(self.logs[words.buckets[low:high]], words.starts[first:last] - low, axis=0)
            first = last
        return out + self.barred[words.scripts[words.starts]]

    def label(self, words: Words) -> np.ndarray:
        """Language number of each word."""
        return viterbi(self.word_scores(words), SWITCH)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best sequence of columns when each change costs ``penalty``; the lower column wins ties.

    If no run of rows gains half a penalty over the best single column in another one, that column is the answer, as
    every further run in another column costs at least one change, or half of one beside its neighbour.
    """
    total = scores.sum(axis=0)
    best = int(np.argmax(total))
    gain = np.vstack([np.zeros(scores.shape[1]), np.cumsum(scores - scores[:, [best]], axis=0)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(len(scores), best)
    value, back = None, []
    for row in scores.tolist():
        if value is None:
            value = row
            continue
        top = max(value)
        at = value.index(top)
        change = top - penalty
        back.append([i if v >= change else at for i, v in enumerate(value)])
        value = [max(v, change) + s for v, s in zip(value, row, strict=True)]
    state = value.index(max(value))
    out = [state]
    for row in reversed(back):
        state = row[state]
        out.append(state)
    return np.array(out[::-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether CRC-32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text_col: str, lang_col: str, buckets: int = BUCKETS) -> Model:
    """Count trigrams and scripts of all ``docs`` with a text and a language; only the sums reach the driver."""
    extra = 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = sums.setdefault(lang, np.zeros(buckets + extra, np.int64))
                    words = Words(text, buckets)
                    b, n = np.unique(words.buckets, return_counts=True)
                    own[b] += n
                    own[buckets:] += np.bincount(words.scripts, minlength=extra)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "b", "n"])

    train = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    sums = train.mapInArrow(count, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    table = np.zeros((buckets + extra, len(langs)))
    if langs:
        table[sums["b"].to_numpy(), [number[x] for x in sums["lang"].to_pylist()]] = sums["n"].to_numpy()
    return Model(langs, table[:buckets], table[buckets:])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``lang_pred``, ``score`` (its share of the letters) and ``spans``.

    Spans are maximal runs of words with one label, as (lang, start, end) in code points of the lower-cased text. A
    null text, one without letters, or a model without languages give ``und``, score 0 and no spans. The language with
    most letters wins, the first in alphabetical order on a tie.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_task():
        m = shared.value

        def per_row(doc_id, text):
            words = Words(text) if text and m.langs else ()
            if not len(words):
                return doc_id, UNDETERMINED, 0.0, []
            labels = m.label(words)
            letters = np.bincount(labels, weights=words.sizes, minlength=len(m.langs))
            best = int(np.argmax(letters))
            cuts = np.flatnonzero(np.diff(labels)) + 1
            firsts, lasts = np.append(0, cuts), np.append(cuts, len(labels)) - 1
            begin, end = words.at[words.starts[firsts]], words.at[words.starts[lasts] + words.sizes[lasts] - 1] + 1
            spans = [{"lang": m.langs[x], "start": s, "end": e} for x, s, e in zip(labels[firsts].tolist(), begin.tolist(), end.tolist(), strict=True)]
            return doc_id, m.langs[best], float(letters[best] / letters.sum()), spans

        return per_row

    schema = f"`{id_col}` {id_type(docs, id_col)}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"
    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("body")), per_task, schema)
