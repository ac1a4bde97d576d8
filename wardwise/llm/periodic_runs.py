"""Periodic run detection by string synchronising sets.

The words of a document are its symbols. A run is a maximal stretch of words
with smallest period q and at least 2 q words. Runs are found by period, from
small to large; the documents of a batch stand one after another, parted by
symbols that occur once, so that array operations treat them all at once.

* Periods under ``3 * FIRST_SCALE`` are found by comparing the words with
  themselves shifted.
* At each scale t = FIRST_SCALE * 2 ** k, periods from 3 t to 6 t come from a
  synchronising set. A position is left out if its t words have a period of at
  most t / 3 (it lies in a highly periodic region, which a run found before
  tells). Of the others, i is selected if the smallest hash of t words among
  the positions i to i + t is that of i or of i + t. The choice depends on 2 t
  words only, so both copies of a repeated block have it at the same places.
  Every t consecutive positions hold one, unless they are in one highly
  periodic region.
* Two selected positions with equal 2 t words (their context), 3 t to 6 t
  apart, propose their distance as a period. A context's own period is over
  t / 3, so a position has at most 18 partners.
* If a run's block lies as a whole in a highly periodic region of period q, the
  set is silent. Such a run spans two overlapping or touching runs of that same
  q; all periods that align them are proposed.
* Neighbouring proposals of one period are merged over the words between them,
  extended to both sides, and compared word by word. Of equal stretches the
  smallest period stays.

Hashes only propose; what is returned was compared.

Edge cases: null and empty texts have no words and no runs; texts shorter than
``min_length`` words have no runs; repeated rows are treated alike; an empty
table gives an empty result; a run never reaches into another row. Other
columns pass through, except that ``n_words``, ``runs`` and ``collapsed``
replace columns of those names. Memory grows with ``BATCH_WORDS`` or, if
longer, with the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from wardwise.llm.common import texts, with_arrow_columns

MIN_LENGTH = 12
FIRST_SCALE = 4
BATCH_WORDS = 200_000  # words searched at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_STRUCT = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _marked(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a position is in one of the ranges."""
    cover = np.zeros(size + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, ends, -1)
    return np.cumsum(cover)[:-1] > 0


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def _primitive(runs: np.ndarray) -> np.ndarray:
    """Of (start, end, period) rows with equal start and end, the one with the smallest period."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def _small_periods(w: np.ndarray, below: int) -> np.ndarray:
    found = [np.empty((0, 3), np.int64)]
    for p in range(1, min(below, len(w))):
        s, e = _stretches(w[:-p] == w[p:])
        ok = e - s >= p
        found.append(np.stack([s[ok], e[ok] + p, np.full(ok.sum(), p)], 1))
    return _primitive(np.concatenate(found))


def _synchronising(h: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """Selected positions, from the hashes of t words and the positions in highly periodic regions."""
    ids = np.where(periodic, _LAST, h)
    low = _window_min(ids, t + 1)
    return np.flatnonzero((low != _LAST) & ((low == ids[: len(low)]) | (low == ids[t:])))


def _equal_contexts(at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): pairs of selected positions with equal contexts, 3 t to 6 t apart."""
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    positions, periods, k = [], [], 1
    alive = np.arange(len(at))
    while len(alive := alive[alive + k < len(at)]):
        apart = at[alive + k] - at[alive]
        near = (context[alive] == context[alive + k]) & (apart < 6 * t)
        alive, apart = alive[near], apart[near]
        take = apart >= 3 * t
        positions.append(at[alive[take]])
        periods.append(apart[take])
        k += 1
    return np.concatenate([*positions, np.empty(0, np.int64)]), np.concatenate([*periods, np.empty(0, np.int64)])


def _merge(at: np.ndarray, period: np.ndarray, h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of ranges whose words equal those one period later, from pairs with equal contexts."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    joined = np.zeros(len(at), bool)
    joined[1:] = (period[1:] == period[:-1]) & (at[1:] - at[:-1] <= 8 * t)
    same = lambda i, p: h[i] == h[i + p]
    for step in range(2, 9):  # the words between two contexts, t at a time and up to the second
        todo = np.flatnonzero(joined)
        probe = np.minimum(at[todo - 1] + step * t, at[todo] - t)
        todo, probe = todo[probe > at[todo - 1]], probe[probe > at[todo - 1]]
        joined[todo] = same(probe, period[todo])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + 2 * t, period[first]


def _extended(start: np.ndarray, end: np.ndarray, period: np.ndarray, h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges grown by whole steps of t words in both directions; the rest is under t words."""
    start, end = start.copy(), end.copy()
    live = np.arange(len(end))
    while len(live := live[end[live] + period[live] < len(h)]):
        live = live[h[end[live]] == h[end[live] + period[live]]]
        end[live] += t
    live = np.arange(len(start))
    while len(live := live[start[live] >= t]):
        live = live[h[start[live] - t] == h[start[live] - t + period[live]]]
        start[live] -= t
    return start, end


def _grown(w: np.ndarray, start: int, end: int, period: int, step: int) -> tuple[int, int]:
    """The maximal range around [start, end) whose words equal those one period later."""
    while True:
        a, b = w[end : end + step], w[end + period : end + period + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        end += int(differ[0]) if len(differ) else len(b)
        if len(differ) or len(b) < step:
            break
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(w[low:start] != w[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1, end
        start = low
    return start, end


def _scale(w: np.ndarray, h: np.ndarray, t: int, runs: np.ndarray) -> np.ndarray:
    """Runs with periods from 3 t to 6 t that the synchronising set of scale t tells."""
    dense = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    at = _synchronising(h, t, _marked(len(h), dense[:, 0], dense[:, 1] - t + 1))
    at = at[at + t < len(h)]
    context = _mixed(h[at] + _mixed(h[at + t]))
    at, period = _equal_contexts(at, context, t)
    if not len(at):
        return np.empty((0, 3), np.int64)
    low, high, period = _merge(at, period, h, t)
    low, high = _extended(low, high, period, h, t)
    near = np.flatnonzero(high - low + 2 * t > period)
    found, done = [], defaultdict(int)
    for s, e, p in zip(low[near].tolist(), high[near].tolist(), period[near].tolist(), strict=True):
        if e <= done[p]:
            continue  # inside a range of this period that is known
        s, e = _grown(w, s, e, p, t)
        done[p] = e
        if e - s >= p and np.array_equal(w[s:e], w[s + p : e + p]):
            found.append((s, e + p, p))
    return np.array(found, np.int64).reshape(-1, 3)


def _aligned(w: np.ndarray, runs: np.ndarray, low: int, high: int) -> np.ndarray:
    """Runs with periods from ``low`` to ``high`` whose blocks lie in two touching runs of one much smaller period."""
    runs = runs[(3 * 3 * runs[:, 2] <= high) & (runs[:, 1] - runs[:, 0] >= low)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    found = []
    touching = np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1])) if len(runs) else ()
    for k in touching:
        (b1, e1, q), (b2, e2, _) = runs[k].tolist(), runs[k + 1].tolist()
        root = w[e1 - q : e1]
        phase = next((f for f in range(q) if np.array_equal(w[b2 + f : b2 + f + q], root)), None)
        if phase is None:
            continue
        least = b2 + phase - e1 + q
        for p in range(least + max(0, -(-(low - least) // q)) * q, min(e1 - b1, e2 - b2, high - 1) + 1, q):
            s, e = _grown(w, max(b1, b2 - p), min(e1, e2 - p), p, q)
            if e - s >= p:
                found.append((s, e + p, p))
    return np.array(found, np.int64).reshape(-1, 3)


def find_runs(w: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs of at least two periods, none longer than ``longest``."""
    runs = _small_periods(w, 3 * FIRST_SCALE)
    t, h = 1, _mixed(w.astype(np.uint64))
    while t < FIRST_SCALE:
        h, t = _mixed(h[:-t] + _mixed(h[t:])) if len(h) > t else h[:0], 2 * t
    while 6 * t <= longest:
        new = [_scale(w, h, t, runs), _aligned(w, runs, 3 * t, 6 * t)]
        runs = _primitive(np.concatenate([runs, *new]))
        h, t = _mixed(h[:-t] + _mixed(h[t:])), 2 * t
    return runs


def _search(documents: list[list[bytes]]) -> list[np.ndarray]:
    """(start, length, period) of the runs of each document, by start and period."""
    sizes = np.array([len(d) for d in documents])
    number: dict[bytes, int] = defaultdict(count(len(documents)).__next__)
    total = int(sizes.sum()) + len(documents)
    parted = chain.from_iterable(chain(d, (None,)) for d in documents)
    number[None] = -1
    w = np.fromiter(map(number.__getitem__, parted), np.int64, total)
    begins = np.cumsum(sizes + 1) - sizes - 1
    w[begins + sizes] = np.arange(len(documents))  # symbols that occur once
    runs = find_runs(w, int(sizes.max()))
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(begins, runs[:, 0], "right") - 1
    rows = np.stack([runs[:, 0] - begins[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    return np.split(rows, np.searchsorted(owner, np.arange(1, len(documents))))


def runs_of(documents: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each document; as many documents at once as ``BATCH_WORDS`` allows."""
    out: list[np.ndarray] = []
    start = held = 0
    for k, words in enumerate(documents):
        if held and held + len(words) > BATCH_WORDS:
            out += _search(documents[start:k])
            start, held = k, 0
        held += len(words)
    return out + (_search(documents[start:]) if start < len(documents) else [])


def collapse_runs(df: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``df`` plus ``n_words``, ``runs`` of at least ``min_length`` words (start, length, period, by start and period)
    and ``collapsed``: the words outside the repeats, joined by one space. A word stays unless a run holds it after
    the run's first period."""

    def run(batch: pa.RecordBatch) -> list:
        documents = [t.encode().split() for t in texts(batch, text_col)]
        found = [r[r[:, 1] >= min_length] for r in runs_of(documents)]
        collapsed = []
        for words, rows in zip(documents, found, strict=True):
            if len(rows):
                gone = _marked(len(words), rows[:, 0] + rows[:, 2], rows[:, 0] + rows[:, 1])
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            collapsed.append(b" ".join(words).decode())
        rows = np.concatenate([*found, np.empty((0, 3), np.int64)])
        flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in range(3)], fields=list(_STRUCT))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
        return [pa.array(map(len, documents), pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(collapsed, pa.string())]

    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return with_arrow_columns(df, run, [text_col], new)
