"""Token counts by a compiled finite-state tokenizer.

A piece vocabulary with merge scores is compiled, as texts need it, into a
deterministic transducer over characters. A state holds the longest suffix that
can begin a piece and, for each position in it, the last token of the prefix's
encoding there and the prefix's count relative to the current one. Reading a character extends the
encoding by the one token that ends there and is stable beside the last token
of the prefix before it; the transition is annotated with the change of the
token count. A space after a non-space resets the transducer, because no piece
holds a space after another character (checked when compiling). What it counts
between two resets is remembered per unit.

Texts are cut into chunks. A chunk's state map is: characters before its first
reset (run from whatever state comes in), then a fixed count and a fixed state.
Maps compose associatively, so a text's count is a tree reduction of its
chunks' maps, as in a parallel prefix scan.

Edge cases: null and empty texts count zero; characters outside the vocabulary
count one token per UTF-8 byte; strings that look like control tokens are
ordinary text; repeated rows count alike; an empty table gives an empty
result; other columns pass through, except that the new columns replace
columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, types as T

from wardwise.llm.common import texts, with_arrow_columns

CHUNK = 1 << 11  # characters of a chunk
MAX_STATES = 200_000  # compiled states per Python worker; beyond, compiled anew
CACHE_ENTRIES = 400_000  # units in each of two generations
CACHE_CHARS = 48
UNIT = re.compile(r" +[^ ]*")
SPACE = "▁"  # the vocabulary's space
NONE = float("inf")


class ChunkMap(NamedTuple):
    """What a chunk does to the incoming state: read ``head``; if it resets, add ``count`` and go to ``state``."""

    head: str
    resets: bool
    count: int = 0
    state: int = 0


class PieceCounter:
    """Transducer for one sentencepiece model with merges and byte fallback."""

    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.cost = {
            sp.id_to_piece(i).replace(SPACE, " "): -sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        if any(" " in piece.lstrip(" ") for piece in self.cost):
            raise ValueError("a piece holds a space after another character: units are not independent")
        self.starts = {piece[:i] for piece in self.cost for i in range(1, len(piece))}  # proper prefixes
        self.stable: dict[tuple[str, str], bool] = {}
        self.units: dict[str, int] = {}
        self.old_units: dict[str, int] = {}
        self._compile_anew()

    # -- compiling -------------------------------------------------------

    def _compile_anew(self) -> None:
        start = ("", ("",), (0,), True)
        self.states = [start]
        self.number = {start: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _merged(self, chars: str) -> list[str]:
        """Symbols after merging the best score first, leftmost on ties."""
        part = list(chars)
        pair = [self.cost.get(a + b, NONE) for a, b in zip(part, part[1:], strict=False)]
        while pair and (best := min(pair)) != NONE:
            i = pair.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = self.cost.get(part[i] + part[i + 1], NONE)
            if i:
                pair[i - 1] = self.cost.get(part[i - 1] + part[i], NONE)
        return part

    def _is_stable(self, before: str, token: str) -> bool:
        known = self.stable.get((before, token))
        if known is None:
            if len(self.stable) > 1_000_000:
                self.stable.clear()
            parts = [p for p in (before, token) if p]
            known = self.stable[(before, token)] = self._merged(before + token) == parts
        return known

    def _move(self, state: int, char: str) -> tuple[int, int]:
        """Compile the transition of ``state`` on ``char``: next state and change of the count."""
        chars, last, counts, in_spaces = self.states[state]
        if char == " " and not in_spaces:
            chars, last, counts, _ = self.states[0]
        chars += char
        for size in range(len(chars), 0, -1):
            token = chars[-size:]
            if (size == 1 or token in self.cost) and self._is_stable(last[-size], token):
                break
        base = counts[-size] + (1 if token in self.cost else len(token.encode()))
        while chars and chars not in self.starts:
            chars = chars[1:]
        keep = len(chars) + 1
        after = (chars, (*last, token)[-keep:], tuple(c - base for c in (*counts, base)[-keep:]), char == " ")
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
            self.moves.append({})
        found = self.moves[state][char] = (self.number[after], base)
        return found

    def run(self, chars: str, state: int = 0) -> tuple[int, int]:
        """State and change of the count after reading ``chars``."""
        count, moves = 0, self.moves
        for c in chars:
            move = moves[state].get(c) or self._move(state, c)
            state = move[0]
            count += move[1]
        return state, count

    # -- counting --------------------------------------------------------

    def unit_count(self, unit: str) -> int:
        """Tokens of one unit (spaces, then other characters), remembered if short."""
        count = self.units.get(unit)
        if count is None:
            count = self.old_units.get(unit)
            if count is None:
                count = self.run(unit)[1]
            if len(unit) <= CACHE_CHARS:
                if len(self.units) >= CACHE_ENTRIES:
                    self.units, self.old_units = {}, self.units
                self.units[unit] = count
        return count

    def chunk_map(self, chunk: str) -> ChunkMap:
        """State map of a chunk whose incoming state is not known."""
        cut = re.search(r"(?<=[^ ]) ", chunk)
        if not cut:
            return ChunkMap(chunk, False)
        *whole, last = UNIT.findall(chunk, cut.start())
        state, count = self.run(last)
        return ChunkMap(chunk[: cut.start()], True, sum(map(self.unit_count, whole)) + count, state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``."""
        if not a.resets:
            return ChunkMap(a.head + b.head, *b[1:])
        state, count = self.run(b.head, a.state)
        return ChunkMap(a.head, True, a.count + count + b.count, b.state if b.resets else state)

    def count(self, text: str) -> int:
        if len(self.states) > MAX_STATES:
            self._compile_anew()
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")  # the model's leading space
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # neighbours pairwise, level by level
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, _, count, _ = maps[0]
        return self.run(head)[1] + count


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    """One compiled tokenizer per Python worker."""
    return PieceCounter(model_path)


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` plus ``n_bytes`` (UTF-8) and ``n_tokens`` of a text column."""

    def run(batch: pa.RecordBatch) -> list:
        rows: Iterable[str] = texts(batch, text_col)
        count = counter(model_path).count
        return [pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array([count(t) for t in rows], pa.int64())]

    return with_arrow_columns(df, run, [text_col], [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
