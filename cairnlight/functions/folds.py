"""Sequential folds over texts and rows: paragraphs, batches, slots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts that are unpacked at a time.
SLICE = 64

#: What parts blocks, and lines that alone make no paragraph.
_BLANK = re.compile(r"\n[ \t]*(?=\n)")
_EMPTY_LINE = re.compile(r"#{1,6}\s+.*|[-*_]{3,}")


def paragraphs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of blocks between blank lines; blocks of headings and rules alone are no paragraphs."""
    out, start, text = [], 0, text or ""
    for end in [*(m.start() for m in _BLANK.finditer(text)), len(text)]:
        block = text[start:end].strip()
        if block and not all(_EMPTY_LINE.fullmatch(x.strip()) for x in block.splitlines() if x.strip()):
            at = text.index(block, start)
            out.append((at, at + len(block), block))
        start = end
    return out


def paragraphs_of(c: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"start": a, "end": b, "text": t} for a, b, t in paragraphs(x)])

    return cut(c)


def paragraph_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, k, start, end) of the paragraphs of each text, k from 0. A few texts are unpacked at a time, and none comes back."""
    kinds = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(x, T.IntegerType()) for x in ("k", "start", "end"))])
    target = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                rows = [(i, k, a, b) for i, x in enumerate(part.column(1).to_pylist()) for k, (a, b, _) in enumerate(paragraphs(x))]
                at, *places = zip(*rows, strict=True) if rows else [()] * 4
                own = part.column(0).take(pa.array(at, pa.int64())).cast(target.field(0).type)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int32()) for x in places)], schema=target)

    return df.select(key, text).mapInArrow(run, kinds)


def batches(sizes: list[int], most_items: int, most_size: int) -> list[int]:
    """Batch number of each item: a new batch where the count or the size would be passed."""
    out, n, total, batch = [], 0, 0, 0
    for s in sizes:
        if n and (n >= most_items or total + s > most_size):
            batch, n, total = batch + 1, 0, 0
        out.append(batch)
        n, total = n + 1, total + s
    return out


def water_fill(have: dict[str, int], caps: dict[str, int], slots: int) -> dict[str, int]:
    """Slots given one by one to the label with the least so far that is under its cap, ties in the order of ``have``."""
    got = dict.fromkeys(have, 0)
    for _ in range(slots):
        open_ = [k for k in have if got[k] < caps.get(k, 0)]
        if not open_:
            break
        least = min(open_, key=lambda k: have[k] + got[k])
        got[least] += 1
    return got
