"""Substring dedup: word passages that occur earlier in the corpus are removed.

A window is ``window`` consecutive words of one document. A window goes if its
word sequence also starts earlier (in a document with a smaller id, or earlier
in the same one); every word that such a window covers is removed.

Suffix automata of reference shards find them. The corpus is its own
reference, so the shards are not broadcast to every task (that would stream
the whole corpus through every shard) but meet the passages that can match
them, by key:

1. Anchors. The smallest hash of a window's word groups is its anchor; equal
   windows have equal anchors. The anchors of a document go to buckets by
   hash, which tell those that occur more than once. If ``DENSE`` documents of
   one task share an anchor, it is heavy, and their owners pass by the bucket,
   which only hears of the anchor: one that a third of all documents share
   brings at most ``DENSE`` owners from each task.
2. Slices. Consecutive windows under one repeated anchor form a slice; slices
   go to the shard of their anchor. Equal slices collapse to the first one
   while they are counted, so a passage shared by a third of all documents
   arrives once. Windows under an anchor of ``HEAVY`` documents or more, or of
   a dense one, are sent one by one, by the hash of the window itself.
3. Matching statistics. A shard streams its slices in corpus order through an
   online suffix automaton over words. After each word the automaton's suffix
   link tells the longest suffix that has occurred before: if it is as long as
   a window, that window occurs earlier. Slices whose windows' hashes are
   unique in the shard need no automaton.
4. A document's slices that are not the first of their kind go whole, in the
   first one the windows found in step 3; the covered spans are merged.

Texts are shuffled once, by id; all else that moves are hashes and slices of
repeated passages. Hashes only bring together what is then compared word by
word; a false meeting costs time, not results.

Edge cases: null and empty texts have no words; texts shorter than a window
are kept; documents with a null id have no place in the order: they are kept
whole and are no reference, and take no part in any join; equal rows of one id
are one document and get the same result; different texts under one id are
different documents, ordered by their MD5; an empty table gives an empty result.
Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wardwise.llm.common import map_batches

WINDOW = 20
GROUP = 8  # words of an anchor's group
HEAVY = 1000  # documents under one anchor from which its windows go one by one
DENSE = 128  # documents of one task's ``HELD`` anchors from which an anchor is heavy wherever it occurs
HELD = 1 << 20  # anchors that a task sorts at once
BUCKET_CHARS = 16 << 20  # characters of text whose anchors a bucket holds, on average
CACHE_WORDS = 400_000
_RNG = np.random.default_rng(7)
_ODD = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _WordHashes()


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all groups of ``size`` consecutive words, from the words' hashes."""
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j : j + n] * _ODD[j]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        g = np.minimum(g[: len(g) - size], g[size:])
        size *= 2
    rest = width - size
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window (lowest bit cleared) and the hashes of all word groups."""
    g = _grams(h, GROUP) & ~_ONE
    return _sliding_min(g, window - GROUP + 1), g


def _document_anchors(h: np.ndarray, window: int) -> np.ndarray:
    """Distinct anchors of a document; the lowest bit tells that one occurs at two places in it."""
    mins, g = _anchors(h, window)
    starts, ends = _runs(mins)
    values, which, runs = np.unique(mins[starts], return_inverse=True, return_counts=True)
    twice = runs > 1
    width = window - GROUP + 1
    np.logical_or.at(twice, which, ends - starts > width)
    for p in range(1, min(width, len(g))):
        if (same := g[:-p] == g[p:]).any():
            twice |= np.isin(values, g[:-p][same])
    return values | twice.astype(np.uint64)


def _packed(bucket: np.ndarray, anchor: np.ndarray, owner: np.ndarray) -> dict[int, tuple[bytes, bytes]]:
    """Anchors and owners of each bucket."""
    order = np.argsort(bucket, kind="stable")
    anchor, owner, bucket = anchor[order], owner[order], bucket[order]
    return {int(bucket[s]): (anchor[s:e].tobytes(), owner[s:e].tobytes()) for s, e in zip(*_runs(bucket), strict=True)} if len(bucket) else {}


def _emit(buckets: int):
    """Per task: (bucket, anchor, owner, dense) of the documents' anchors, ``HELD`` at a time."""

    def flush(anchor: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        bare = anchor & ~_ONE
        values, which, counts = np.unique(bare, return_inverse=True, return_counts=True)
        is_dense = (counts >= DENSE)[which]
        bucket = lambda a: ((((a >> _ONE) * _MIX) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        dense = values[counts >= DENSE]
        of_dense = _packed(bucket(dense), dense, np.zeros((len(dense), 0), np.int64))
        sparse = _packed(bucket(bare[~is_dense]), anchor[~is_dense], owner[~is_dense])
        # what is known of the owners of dense anchors passes by, dealt by owner
        known = owner[is_dense]
        passing = _packed(-1 - ((known[:, 0] ^ known[:, 1]) % buckets), bare[is_dense] | _ONE, known)
        rows = [(k, *sparse.get(k, (b"", b"")), of_dense.get(k, (b"",))[0]) for k in sorted({*sparse, *of_dense})]
        rows += [(k, *v, b"") for k, v in passing.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "anchor", "owner", "dense"])

    def run(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, owners, held = [], [], 0
        for batch in batches:
            for i, tag, text in zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "text")), strict=True):
                words = (text or "").encode().split()
                if len(words) < window:
                    continue
                found.append(_document_anchors(_word_hashes(words), window))
                owners.append(np.full((len(found[-1]), 2), (i, tag), np.int64))
                held += len(found[-1])
                if held >= HELD:
                    yield flush(np.concatenate(found), np.concatenate(owners))
                    found, owners, held = [], [], 0
        if held:
            yield flush(np.concatenate(found), np.concatenate(owners))

    return run


def _repeated(heavy: int):
    """Per bucket: (id, tag, anchor) of the anchors that occur more than once; the lowest bit marks heavy ones."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        column = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in rows.column(name).to_pylist()])
        anchor, owner = column("anchor", np.uint64), column("owner", np.int64).reshape(-1, 2)
        if key[0].as_py() >= 0:
            values, which, counts = np.unique(anchor & ~_ONE, return_inverse=True, return_counts=True)
            dense = np.isin(values, column("dense", np.uint64))
            again = (counts > 1) | dense
            np.logical_or.at(again, which, (anchor & _ONE) == _ONE)
            keep = again[which]
            anchor, owner = (values | ((counts >= heavy) | dense).astype(np.uint64))[which[keep]], owner[keep]
        return pa.table({"id": owner[:, 0], "tag": owner[:, 1], "anchor": anchor.view(np.int64)})

    return run


def _repeated_anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(id, tag, anchors): each document's anchors that occur more than once; the lowest bit marks heavy ones."""
    run = _emit(buckets)
    packed = docs.mapInArrow(lambda batches: run(window, batches), "bucket long, anchor binary, owner binary, dense binary")
    rows = packed.groupBy("bucket").applyInArrow(_repeated(HEAVY), "id long, tag long, anchor long")
    return rows.groupBy("id", "tag").agg(F.collect_list("anchor").alias("anchors"))


def _slices(words: list[bytes], anchors: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slices of a document as (key, first window, end of its windows)."""
    h = _word_hashes(words)
    mins, _ = _anchors(h, window)
    marked = np.array(anchors, np.int64).view(np.uint64)
    repeated = np.isin(mins, marked & ~_ONE)
    heavy = np.isin(mins, (marked & ~_ONE)[(marked & _ONE) == _ONE])
    starts, ends = _runs(mins)
    ok = repeated[starts] & ~heavy[starts]
    alone = np.flatnonzero(heavy)
    own = _grams(h, window)[alone]
    return np.concatenate([mins[starts[ok]], own]), np.concatenate([starts[ok], alone]), np.concatenate([ends[ok], alone + 1])


class SuffixAutomaton:
    """Online suffix automaton over a sequence of integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, symbol: int) -> int:
        """Append a symbol; the length of the longest suffix that has occurred before."""
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        p = self.last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]


def _earlier_windows(slices: list[list[bytes]], window: int) -> list[list[int]]:
    """For each slice, in corpus order, the windows that occur earlier in these slices."""
    automaton, number, out = SuffixAutomaton(), {}, []
    for k, words in enumerate(slices):
        found = []
        for e, word in enumerate(words):
            if automaton.extend(number.setdefault(word, len(number))) >= window:
                found.append(e + 1 - window)
        automaton.extend(-1 - k)  # a symbol of its own: no match runs over the end of a slice
        out.append(found)
    return out


def _judge(window: int):
    """Per task: first slices (key, slice, id, tag, start) to (id, tag, start, gone), the windows of each that occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        key, ids, tag, start = (table.column(c).to_numpy() for c in ("key", "id", "tag", "start"))
        order = np.lexsort((start, tag, ids, key))
        slices = [s.split(b" ") for s in table.column("slice").to_pylist()]
        sizes = np.array([len(s) for s in slices])
        grams = _grams(_word_hashes(list(chain.from_iterable(slices))), window)  # all slices at once
        owner = np.repeat(np.arange(len(slices)), sizes)[: len(grams)]
        inside = np.arange(len(grams)) + window <= np.cumsum(sizes)[owner]  # windows that end in their slice
        owner = owner[inside]
        _, which, counts = np.unique(grams[inside], return_inverse=True, return_counts=True)
        suspect = np.zeros(len(slices), bool)
        suspect[owner[counts[which] > 1]] = True
        gone: list[list[int]] = [[] for _ in slices]
        order = order[suspect[order]]
        for s, e in zip(*_runs(key[order]), strict=True) if len(order) else ():
            group = order[s:e].tolist()
            for i, found in zip(group, _earlier_windows([slices[i] for i in group], window), strict=True):
                gone[i] = found
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tag), pa.array(start), pa.array(gone, pa.list_(pa.int32()))], names=["id", "tag", "start", "gone"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` are the words that stay, joined by one space."""
    if not GROUP <= window <= len(_ODD):
        raise ValueError(f"windows hold {GROUP} to {len(_ODD)} words")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    named = rows.where("id IS NOT NULL")
    digest = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10).cast("long")
    texts = named.groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("b"), F.sum(F.length("text")).alias("chars"))
    several, chars = texts.agg(F.max(F.col("a") < F.col("b")), F.sum("chars")).first()
    docs = named.withColumn("tag", digest if several else F.lit(0).cast("long"))  # tells the texts of one id apart
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = docs.join(_repeated_anchors(docs, window, max(4 * parts, (chars or 0) // BUCKET_CHARS)), ["id", "tag"], "left")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: dict[str, list] = {"key": [], "slice": [], "id": [], "tag": [], "start": []}
        for i, tag, text, anchors in zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "text", "anchors")), strict=True):
            if not anchors:
                continue
            words, seen = text.encode().split(), set()
            for key, s, e in zip(*(a.tolist() for a in _slices(words, anchors, window)), strict=True):
                part = b" ".join(words[s : e + window - 1])
                if part not in seen:
                    seen.add(part)
                    for column, value in zip(out.values(), (key - (1 << 64) if key >> 63 else key, part, i, tag, s), strict=True):
                        column.append(value)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("slice", pa.binary()), ("id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64())])) if out["key"] else None

    slices = map_batches(marked, cut, "key long, slice binary, id long, tag long, start long")  # unfiltered: both uses of the texts share one exchange
    first = slices.groupBy("key", "slice").agg(F.min(F.struct("id", "tag", "start")).alias("first")).select("key", "slice", "first.*")
    judged = first.repartition("key").mapInArrow(_judge(window), "id long, tag long, start long, gone array<int>")
    verdicts = judged.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "gone")).alias("first"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        for i, text, anchors, first in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "anchors", "first")), strict=True):
            words = (text or "").encode().split()
            cover = np.zeros(len(words) + 1, np.int64)
            if anchors:
                known = {f["start"]: f["gone"] for f in first or ()}
                _, starts, ends = _slices(words, anchors, window)
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    if s not in known:
                        cover[s] += 1
                        cover[e + window - 1] -= 1
                    else:
                        for w in known[s]:
                            cover[s + w] += 1
                            cover[s + w + window] -= 1
            kept = words
            if cover.any():
                stays = np.cumsum(cover)[:-1] == 0
                kept = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
            for column, value in zip(out.values(), (i, len(words), len(words) - len(kept), b" ".join(kept).decode()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    unnamed = rows.where("id IS NULL").select("id", "text", F.lit(None).cast("array<long>").alias("anchors"), F.lit(None).cast(verdicts.schema["first"].dataType).alias("first"))
    judged_rows = marked.join(verdicts, ["id", "tag"], "left").select(unnamed.columns)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return map_batches(judged_rows, finish, schema).unionAll(map_batches(unnamed, finish, schema))
