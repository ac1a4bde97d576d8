"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encoding is a reduction over a binary tree. A text is cut in halves down to
leaves; each leaf is split by the tokenizer's pattern; two neighbours are
joined by splitting a window around their boundary again until the cuts on
both sides provably stay as they are. The same reduction encodes each match
of the pattern: its bytes are halved down to short leaves, neighbours are
joined by encoding a growing boundary window again until the token pairs at
the window's edges are stable. Decoding concatenates token bytes up a tree.

Why the joins are exact:

* Pattern. A match depends only on the characters it examines. A match that
  ends before the left part does, and whose start is at least ``LOOKAHEAD``
  characters before that end, has examined nothing beyond the part, so it is
  the same in the joined text. The pattern has no look-behind: where a new cut
  meets an old cut of the right part, all later cuts are the old ones.
* Merges. A token sequence is the encoding of its bytes exactly if every
  adjacent pair of tokens is the encoding of the pair's bytes. So once the two
  pairs at the window's edges are stable, the tokens outside need no change.

Edge cases: null and empty texts give zero tokens and empty bytes; repeated
rows are encoded alike; an empty table gives an empty result; other columns
pass through, except that ``ids``, ``n_tokens`` and ``decoded`` replace
columns of those names.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from wardwise.llm.common import Memory, texts, with_arrow_columns

TEXT_LEAF = 1 << 11  # characters split at once
BYTE_LEAF = 4  # bytes merged at once
LOOKAHEAD = 3  # most characters that a fixed alternative of the pattern examines
UNIT_ENTRIES, UNIT_CHARS = 150_000, 48  # remembered units of texts, per generation and Python worker
PART_ENTRIES, PART_BYTES = 50_000, 8  # remembered halves of matches
PAIR_ENTRIES = 150_000  # remembered pairs of tokens
DECODE_LEAF = 1 << 16
HEAP_FROM = 32  # bytes of one side from which a window is merged with a heap
NONE = 1 << 40  # above every rank
CUT = re.compile(r" (?=\S)")


class ByteBpe:
    """Encoder and decoder for one ranks file and one pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        compiled = regex.compile(pattern)
        self.find, self.find_all = compiled.finditer, compiled.findall
        self.pairs = Memory(self._pair, PAIR_ENTRIES, 2)
        self.parts = Memory(self.encode_bytes, PART_ENTRIES, PART_BYTES)
        self.cache = Memory(lambda unit: self.encode_unit(f" {unit}"), UNIT_ENTRIES, UNIT_CHARS)
        #: tokens that are the encoding of their bytes: no merge is needed for those
        self.whole = {token: (rank,) for token, rank in self.ranks.items() if len(token) <= HEAP_FROM and self._merge(token) == [rank]}

    # -- bytes to tokens -------------------------------------------------

    def _merge(self, data: bytes) -> list[int]:
        """Merge the lowest rank first, leftmost on ties."""
        if len(data) > 2 * HEAP_FROM:
            return self._merge_long(data)
        rank = self.ranks.get
        part = [data[i : i + 1] for i in range(len(data))]
        pair = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pair and (low := min(pair)) != NONE:
            i = pair.index(low)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = rank(part[i] + part[i + 1], NONE)
            if i:
                pair[i - 1] = rank(part[i - 1] + part[i], NONE)
        return [self.ranks[p] for p in part]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list."""
        ranks, n = self.ranks, len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged meanwhile
            part[i] += part[j]
            part[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [ranks[p] for p in part if p]

    def _pair(self, pair: tuple[int, int]) -> tuple[int, ...]:
        """Encoding of two tokens' bytes; the pair itself if it is stable."""
        return tuple(self._merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]))

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left + right
        pairs, k = self.pairs, 1
        window = pairs[edge := (left[-1], right[0])]
        if window == edge:
            return left + right
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            if (a == 0 or pairs[edge := (left[a - 1], window[0])] == edge) and (b == len(right) or pairs[edge := (window[-1], right[b])] == edge):
                return left[:a] + window + right[b:]
            k *= 2
            window = tuple(self._merge(b"".join([self.bytes_of[t] for t in left[-k:] + right[:k]])))

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one match's bytes: halves encoded recursively, then joined."""
        if (token := self.whole.get(data)) is not None:
            return token
        n = len(data)
        if n <= BYTE_LEAF:
            return tuple(self._merge(data))
        half = 1 << (n - 1).bit_length() - 1  # aligned cuts keep runs of one byte in phase, and word beginnings alike
        return self.join(self.parts[data[:half]], self.parts[data[half:]])

    # -- text to matches -------------------------------------------------

    def split(self, text: str) -> list[str]:
        """Matches of the pattern over a text, by the same halving and joining."""
        return self._split(text, 0, len(text))

    def _split(self, text: str, lo: int, hi: int) -> list[str]:
        if hi - lo <= TEXT_LEAF:
            return self.find_all(text[lo:hi])
        half = lo + (1 << (hi - lo - 1).bit_length() - 1)
        left, right = self._split(text, lo, half), self._split(text, half, hi)
        start = half
        while left and (start >= half or start > half - LOOKAHEAD or start + len(left[-1]) >= half):
            start -= len(left.pop())
        # the match before `start` ended early enough only if it too examined nothing beyond the half
        while left and (start >= half or start - len(left[-1]) > half - LOOKAHEAD):
            start -= len(left.pop())
        old, cut = 0, half
        for m in self.find(text, start, hi):
            left.append(m.group())
            end = m.end()
            while cut < end and old < len(right):
                cut += len(right[old])
                old += 1
            if cut == end and end >= half:
                break
        left.extend(right[old:])
        return left

    # -- whole texts -----------------------------------------------------

    def units(self, text: str) -> list[str]:
        """A text cut at each space before a non-space; the spaces at the cuts are left out.

        The pattern begins a match at every such space, whatever stands
        before it, so units can be encoded separately. A cut depends on two
        characters only: joining halves re-cuts the one unit between them.
        """
        if len(text) <= TEXT_LEAF:
            return CUT.split(text)
        half = 1 << (len(text) - 1).bit_length() - 1
        left, right = self.units(text[:half]), self.units(text[half:])
        return left[:-1] + CUT.split(left[-1] + right[0]) + right[1:]

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        first, *rest = self.units(text)
        return self.encode_unit(first) + b"".join(map(self.cache.__getitem__, rest))

    def encode_unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for match in self.split(unit):
            ids += self.encode_bytes(match.encode())
        return array("I", ids).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed token ids, concatenated up a binary tree."""
        return self._decode(np.frombuffer(ids, "<u4").tolist())

    def _decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self._decode(ids[:half]) + self._decode(ids[half:])


@lru_cache(maxsize=2)
def bpe(ranks_path: str, pattern: str) -> ByteBpe:
    """One encoder per Python worker."""
    return ByteBpe(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` plus ``ids`` (packed little-endian uint32) and ``n_tokens``."""

    def run(batch: pa.RecordBatch) -> list:
        enc = bpe(ranks_path, pattern).encode
        ids = [enc(t) for t in texts(batch, text_col)]
        return [pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64())]

    return with_arrow_columns(df, run, [text_col], [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``df`` plus ``decoded``, the bytes of the packed ids (null: empty)."""

    def run(batch: pa.RecordBatch) -> list:
        dec = bpe(ranks_path, pattern).decode
        return [pa.array([dec(b or b"") for b in batch.column(ids_col).to_pylist()], pa.binary())]

    return with_arrow_columns(df, run, [ids_col], [T.StructField("decoded", T.BinaryType())])


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` plus ``ids``, ``n_tokens`` and ``decoded``: encoding and decoding in one pass of one Python worker."""

    def run(batch: pa.RecordBatch) -> list:
        own = bpe(ranks_path, pattern)
        ids = [own.encode(t) for t in texts(batch, text_col)]
        return [pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(map(own.decode, ids), pa.binary())]

    new = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())]
    return with_arrow_columns(df, run, [text_col], new)
