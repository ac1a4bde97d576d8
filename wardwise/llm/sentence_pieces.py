"""SentencePiece encoding and decoding that keeps source offsets.

1. Normalisation. At each place of a text the longest prefix that the model's
   compiled character map holds is replaced; a character that begins no entry
   stays. Spaces are escaped, the leading one added and extra ones squeezed as
   the model says. Each normalised character records the source byte at which
   its replaced prefix begins.
2. Encoding. Neighbouring symbols whose joint piece scores best are merged,
   leftmost first on ties; characters outside the vocabulary become byte pieces
   (or one unknown piece in a row, for models without those).
3. Projection. A piece covers the source bytes between the records of its first
   character and of the character after it. Spans of neighbours touch; the last
   of a character's byte pieces has its span, the others an empty one.
4. Decoding concatenates the pieces; byte pieces in a row are read as UTF-8,
   bytes that are not become U+FFFD each.

No piece of a usual vocabulary holds a space after another character, so a text
is cut before such spaces and the parts are encoded apart and remembered (a
model with other pieces is not cut). If the map is empty and spaces are not
squeezed, a part's normal form depends on the part alone, and the cut is made
in the source.

Edge cases: null and empty texts have no pieces and decode to the empty text;
strings that look like control pieces are ordinary text; repeated rows are
encoded alike; an empty table gives an empty result; other columns pass
through, except that ``ids``, ``n_tokens``, ``spans`` and ``decoded`` replace
columns of those names. Models of another kind, or with pieces defined by
users, are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from wardwise.llm.common import Memory, texts, with_arrow_columns

SPACE = "▁"
# fixed values of the model file's format
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

SCAN = 64  # characters up to which the best pair is searched by scanning
MEMORY_ENTRIES, MEMORY_CHARS = 500_000, 48
NONE = float("inf")
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SOURCE_UNIT = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            at += size
            yield tag >> 3, data[at - size : at]


class CharacterMap:
    """The compiled map: a double array of prefixes, then the texts that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.values = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """End of the longest prefix of ``data[at:]`` in the map, and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for end in range(at, len(data)):
            byte = data[end]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._offset(units[node])
            if leaf:
                found = end + 1, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end, value = found
        return end, self.values[value : self.values.index(0, value)]


class SentencePieces:
    """Encoder and decoder for one model file."""

    def __init__(self, model_path: str):
        with open(model_path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [{1: b"", 3: NORMAL} | dict(_fields(p)) for n, p in model if n == 1]
        trainer, normalizer = (dict(kv for n, part in model if n == k for kv in _fields(part)) for k in (2, 3))
        if trainer.get(3, 1) != BPE or {p[3] for p in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24):
            raise ValueError("only models of merged pieces without user-defined or unused ones are read")
        self.names = [p[1].decode() for p in pieces]
        self.kinds = [p[3] for p in pieces]
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.ids = {self.names[i]: i for i in normal}
        self.cost = {self.names[i]: -struct.unpack("<f", pieces[i].get(2, bytes(4)))[0] for i in normal}
        self.byte_ids = [i for _, i in sorted((int(self.names[i][1:-1], 16), i) for i, k in enumerate(self.kinds) if k == BYTE)]
        self.unknown = self.kinds.index(UNKNOWN)
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.cuttable = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.cut_source = self.cuttable and self.escape and not self.map.units and not self.squeeze
        surface = trainer.get(44, " ⁇ ".encode())
        self.bytes_of = [
            surface if k == UNKNOWN else b"" if k == CONTROL else bytes([int(n[1:-1], 16)]) if k == BYTE else n.replace(SPACE, " ").encode() for n, k in zip(self.names, self.kinds, strict=True)
        ]
        self.is_byte = [k == BYTE for k in self.kinds]
        self.merged = Memory(self._segment, MEMORY_ENTRIES, MEMORY_CHARS)
        self.parts = Memory(lambda part: self._coded(part, False)[0], MEMORY_ENTRIES, MEMORY_CHARS)

    # -- normalisation ---------------------------------------------------

    def normalise(self, text: str, prefix: bool) -> tuple[str, Sequence[int]]:
        """The normal form, and for each of its characters, and its end, the source byte where it begins."""
        space = SPACE if self.escape else " "
        if not self.map.units and not self.squeeze:  # every prefix is one character
            norm = (space if prefix else "") + text.replace(" ", space)
            at = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode()) for c in text)]
            return norm, [0, *at] if prefix else at
        data, norm, at, end = text.encode(), [], [], 0
        after_space = self.squeeze
        while end < len(data):
            start, found = end, self.map.longest(data, end)
            if found is None:
                end += 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                new = data[start:end].decode()
            else:
                end, new = found[0], found[1].decode()
            if prefix and not (self.squeeze and new == " "):
                norm.append(space)
                at.append(start)
                prefix = False
            if after_space:
                new = new.lstrip(" ")
            norm += new.replace(" ", space)
            at += [start] * len(new)
            if self.squeeze and new:
                after_space = new.endswith(" ")
        while self.squeeze and norm and norm[-1] == space:
            norm.pop()
            end = at.pop()
        return "".join(norm), [*at, end]

    # -- encoding --------------------------------------------------------

    def _merge(self, chars: str) -> list[str]:
        """Symbols after merging the best score first, leftmost on ties."""
        cost = self.cost.get
        if len(chars) > SCAN:
            return self._merge_long(chars)
        part = list(chars)
        pair = [cost(a + b, NONE) for a, b in zip(part, part[1:], strict=False)]
        while pair and (best := min(pair)) != NONE:
            i = pair.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = cost(part[i] + part[i + 1], NONE)
            if i:
                pair[i - 1] = cost(part[i - 1] + part[i], NONE)
        return part

    def _merge_long(self, chars: str) -> list[str]:
        """The same with a queue of pairs over a linked list."""
        cost, part, n = self.cost.get, list(chars), len(chars)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(c, i, i + 1, both) for i in range(n - 1) if (c := cost(both := part[i] + part[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not part[i] or after[i] != j or part[i] + part[j] != both:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (c := cost(part[left] + part[right])) is not None:
                    heapq.heappush(queue, (c, left, right, part[left] + part[right]))
        return [p for p in part if p]

    def _segment(self, norm: str) -> tuple[list[int], list[int]]:
        """Piece ids of a normalised part, and at which of its characters each ends."""
        ids, ends, end = [], [], 0
        for piece in self._merge(norm):
            known = self.ids.get(piece)
            if known is not None or not self.byte_ids:
                if known is None and ids and ids[-1] == self.unknown:
                    ids.pop(), ends.pop()
                ids.append(self.unknown if known is None else known)
                end += len(piece)
                ends.append(end)
            else:  # one character: all but the last of its bytes end where it begins
                data = piece.encode()
                ids += [self.byte_ids[b] for b in data]
                ends += [end] * (len(data) - 1) + [end + 1]
                end += 1
        return ids, ends

    def _coded(self, text: str, prefix: bool) -> tuple[bytes, int]:
        norm, at = self.normalise(text, prefix)
        ids, ends, begin = [], [at[0]], 0
        for unit in _UNIT.findall(norm) if self.cuttable else [norm]:
            more, stops = self.merged[unit] if not self.cut_source else self._segment(unit)
            if not self.byte_ids and ids and more and ids[-1] == more[0] == self.unknown:
                ids.pop(), ends.pop()
            ids += more
            ends += [at[begin + s] for s in stops]
            begin += len(unit)
        return array("i", chain.from_iterable(zip(ids, map(sub, ends[1:], ends), strict=True))).tobytes(), at[0]

    def encode(self, text: str) -> tuple[bytes, int]:
        """Of each piece its id and how many source bytes it covers, packed by turns, and where the first one begins."""
        if not text:
            return b"", 0
        if not self.cut_source:
            return self._coded(text, self.prefix)
        first, *rest = _SOURCE_UNIT.findall(text)
        return self._coded(first, self.prefix)[0] + b"".join(map(self.parts.__getitem__, rest)), 0

    # -- decoding --------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Text of piece ids."""
        strip = self.prefix or self.squeeze
        if strip:  # the leading space goes with the first piece that is not a byte or control piece
            ids = self._without_leading_space(ids)
        data = b"".join([self.bytes_of[i] if i >= 0 else self.bytes_of[~i][1:] for i in ids])
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_parted(ids)

    def _without_leading_space(self, ids: list[int]) -> list[int]:
        """``ids`` with ``~id`` for a piece whose leading space is left out."""
        ids = list(ids)
        for k, i in enumerate(ids):
            if self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] != NORMAL or not self.names[i].startswith(SPACE):
                break
            ids[k] = ~i
            if not self.squeeze or self.names[i] != SPACE:
                break
        return ids

    def _decode_parted(self, ids: list[int]) -> str:
        """The same where byte pieces are not UTF-8: each byte that begins no character is U+FFFD."""
        out, held = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if i >= 0 and self.is_byte[i]:
                held += self.bytes_of[i]
            else:
                flush()
                out.append((self.bytes_of[i] if i >= 0 else self.bytes_of[~i][1:]).decode())
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def sentence_pieces(model_path: str) -> SentencePieces:
    """One encoder per Python worker."""
    return SentencePieces(model_path)


def _encoded(rows: list[str], model: SentencePieces) -> list:
    coded, begins = zip(*map(model.encode, rows), strict=True) if rows else ((), ())
    offsets = np.concatenate([[0], np.cumsum([len(b) // 8 for b in coded])]).astype(np.int32)
    ids, widths = np.frombuffer(b"".join(coded), "i4").reshape(-1, 2).T
    total = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    base = np.repeat(total[offsets[:-1]] - np.array(begins, np.int64), np.diff(offsets))
    spans = pa.StructArray.from_arrays([pa.array((total[k : k + len(ids)] - base).astype(np.int32)) for k in (0, 1)], fields=list(_SPAN))
    lists = pa.array(offsets, pa.int32())
    return [pa.ListArray.from_arrays(lists, pa.array(np.ascontiguousarray(ids))), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(lists, spans)]


_ENCODED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]


def encode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` plus ``ids``, ``n_tokens`` and ``spans`` (each piece's bytes in the UTF-8 source, end exclusive)."""
    return with_arrow_columns(df, lambda batch: _encoded(texts(batch, text_col), sentence_pieces(model_path)), [text_col], _ENCODED)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` plus ``decoded``, the text of an array of piece ids (null: the empty text)."""

    def run(batch: pa.RecordBatch) -> list:
        text_of = sentence_pieces(model_path).decode
        return [pa.array([text_of(ids or []) for ids in batch.column(ids_col).to_pylist()], pa.string())]

    return with_arrow_columns(df, run, [ids_col], [T.StructField("decoded", T.StringType())])


def round_trip(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass of one Python worker."""

    def run(batch: pa.RecordBatch) -> list:
        model = sentence_pieces(model_path)
        columns = _encoded(texts(batch, text_col), model)
        ids, offsets = columns[0].values.to_numpy(), columns[0].offsets.to_pylist()
        return [*columns, pa.array([model.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())]

    return with_arrow_columns(df, run, [text_col], [*_ENCODED, T.StructField("decoded", T.StringType())])
