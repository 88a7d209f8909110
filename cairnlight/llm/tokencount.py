"""Token counts of a byte-pair model by a compiled finite-state transducer.

The last token of a prefix's encoding follows from the tokens at the places where a piece can still be under way: a piece
ends the prefix exactly if it and the token before it are what the model makes of the two together, and one piece alone
does. So reading a character needs a bounded past. That past is the state; a transition carries the number of tokens by
which the encoding grows (it may shrink where pieces merge). States and transitions are compiled when first met.

A text is cut into chunks. What a chunk does to the state is a map: only its head, up to the first place where no piece
can go on, depends on the state it is entered with; the tokens between and the tail do not. Maps compose associatively,
and a prefix scan over them gives the tokens up to the end of each chunk.

Null texts are empty and have no tokens. Repeated rows are counted alike. Very long texts cost time in proportion. Other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cairnlight.llm.common import id_type, map_rows

MAX_TOKENS = 4096
CHUNK = 1 << 16
#: Compiled states and remembered segments that a worker holds before it starts anew.
HELD = 500_000
#: Longer segments are counted each time.
LONGEST_HELD = 48

_BLANK = "▁"
_SEGMENT = re.compile(f"{_BLANK}*[^{_BLANK}]+|{_BLANK}+")
_START = (("", None, 0),)
State = tuple[tuple[str, str | None, int], ...]


class Transducer:
    """Characters to numbers of tokens, for a byte-pair model with byte fallback and texts left as they are."""

    def __init__(self, model_file: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("not a byte-pair model with byte fallback")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("the model changes texts before it encodes them")
        self.prefix = _BLANK if rules.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(_BLANK in p.lstrip(_BLANK) for p in self.score):
            raise ValueError("a piece goes on past a blank")
        self.begun = {p[:n] for p in self.score for n in range(1, len(p))}
        self.whole: dict[str, bool] = {}
        self.paired: dict[tuple[str, str], bool] = {}
        self.held = _Held(self)
        self.forget()

    def forget(self) -> None:
        """Drop all states but the first."""
        self.states: list[State] = [_START]
        self.number: dict[State, int] = {_START: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The model's own rule: join the neighbours whose piece has the highest score, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def is_token(self, piece: str) -> bool:
        if piece not in self.whole:
            self.whole[piece] = piece in self.score and self.merged(piece) == [piece]
        return self.whole[piece]

    def follows(self, before: str | None, piece: str) -> bool:
        if before is None:
            return True
        key = before, piece
        if key not in self.paired:
            if len(self.paired) > HELD:
                self.paired.clear()
            self.paired[key] = self.merged(before + piece) == [before, piece]
        return self.paired[key]

    def compiled(self, state: State, char: str) -> tuple[State, int]:
        """What ``char`` leads to: the next state and the tokens it adds.

        A state has, for each place where a piece may have begun, the characters since, the last token of the encoding up
        to there and its number of tokens less the current one.
        """
        if char not in self.score:
            return _START, len(char.encode())
        last, added = next((since + char, n + 1) for since, before, n in state if self.is_token(since + char) and self.follows(before, since + char))
        going = tuple((since + char, before, n - added) for since, before, n in state if since + char in self.begun)
        return (*going, ("", last, 0)), added

    def move(self, at: int, char: str) -> tuple[int, int]:
        """Compile one transition."""
        state, added = self.compiled(self.states[at], char)
        to = self.number.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
            self.moves.append({})
        self.moves[at][char] = to, added
        return to, added

    def run(self, text: str) -> int:
        """Tokens of a text that is read from the first state."""
        if len(self.states) > HELD:
            self.forget()
        at, total, moves = 0, 0, self.moves
        for char in text:
            at, added = moves[at].get(char) or self.move(at, char)
            total += added
        return total

    def segments(self, parts: Iterable[str]) -> int:
        return sum(map(self.held.__getitem__, parts))

    def chunk(self, text: str) -> ChunkMap:
        parts = _SEGMENT.findall(text)
        return ChunkMap(parts[0], self.segments(parts[1:-1]), parts[-1] if len(parts) > 1 else None)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``: the end of one and the head of the other are one segment, or two if a blank begins it."""
        met = _SEGMENT.findall((a.head if a.tail is None else a.tail) + b.head)
        parts = ([] if a.tail is None else [a.head]) + met + ([] if b.tail is None else [b.tail])
        return ChunkMap(parts[0], a.tokens + b.tokens + self.segments(parts[1:-1]), parts[-1] if len(parts) > 1 else None)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: neighbours compose to pairs, the pairs are scanned, and odd places follow from them."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]))
        return out

    def tokens(self, done: ChunkMap) -> int:
        """Tokens of a text that starts where the map does."""
        return done.tokens + self.segments([done.head] if done.tail is None else [done.head, done.tail])

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(" ", _BLANK)
        maps = [self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        return self.tokens(self.scan(maps)[-1])


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any state: ``head`` is read from the state, ``tokens`` and ``tail`` do not depend on it. A
    chunk in which a piece could go on everywhere is all head."""

    head: str
    tokens: int
    tail: str | None


class _Held(dict):
    """Tokens of segments, each run through the transducer when first met."""

    def __init__(self, of: Transducer) -> None:
        self.of = of

    def __missing__(self, segment: str) -> int:
        n = self.of.run(segment)
        if len(segment) <= LONGEST_HELD:
            if len(self) > HELD:
                self.clear()
            self[segment] = n
        return n


@lru_cache(maxsize=2)
def compiled_model(model_file: str) -> Transducer:
    """One transducer for all tasks of a worker: what one compiled serves the next."""
    return Transducer(model_file)


def count_tokens(docs: DataFrame, model_file: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each document; rows stay where they are, nothing is shuffled."""

    def row_fn():  # noqa: ANN202
        count = compiled_model(model_file).count
        return lambda i, text: (i, len(text.encode()) if text else 0, count(text))

    counted = map_rows(docs.select(id_col, text_col), row_fn, f"`{id_col}` {id_type(docs, id_col)}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
