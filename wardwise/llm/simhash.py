"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most three
bits share at least five bytes at equal positions: the guaranteed minimum. The
inverted index posts each distinct fingerprint under combinations of four
positional bytes, chosen so that any five positions hold one combination (a
covering design), so every pair that reaches the minimum meets in a posting
list. Within a list the shared positional bytes of each pair are tallied, the
pairs that reach the minimum are verified by their bit distance, and only a
spanning forest of the links leaves the task, never all pairs.

A posting list longer than ``LIST_LIMIT`` is not compared as it is. Its members
go to an index of the next level, by the same argument on the bits that the
list leaves open: eight units of four bits, of which at least five agree, and
then eight units of two bits. A list of the last level holds at most 256
distinct fingerprints, so every list is compared within bounds and no link is
lost. Copies share one fingerprint and are one member.

Edge cases: null and empty texts have fingerprint zero and link like any
other; texts of fewer words than a shingle are one shingle; documents with a
null id get a fingerprint and the component of their copies, but name none;
repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wardwise.llm.common import map_batches, stored, texts
from wardwise.llm.components import components

SEED = 42
LIST_LIMIT = 2048
LEVELS = 3
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64 hashes; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)], np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, p], minlength=256) @ _BITS for p in range(8)])
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _design() -> list[tuple[int, ...]]:
    """Combinations of four of eight positions, one within any five (greedy)."""
    open_, chosen = set(combinations(range(8), 5)), []
    while open_:
        best = max(combinations(range(8), 4), key=lambda c: sum(set(c) <= set(f) for f in open_))
        chosen.append(best)
        open_ = {f for f in open_ if not set(best) <= set(f)}
    return chosen


DESIGN = _design()


def _units(values: np.ndarray, width: int, positions: tuple[int, ...]) -> np.ndarray:
    """The units of ``width`` bits at some positions, side by side."""
    out = np.zeros_like(values)
    for k, p in enumerate(positions):
        out |= ((values >> np.uint64(width * p)) & np.uint64((1 << width) - 1)) << np.uint64(width * k)
    return out


def _post(rows: DataFrame, level: int) -> DataFrame:
    """Postings (key, open, fp, node) of each row under every combination of a level."""
    width = 8 >> (level - 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, open_ = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "open"))
        n, keys, rest = batch.num_rows, [], []
        for i, chosen in enumerate(DESIGN):
            part = np.uint64(i) << np.uint64(4 * width) | _units(open_, width, chosen)
            keys.append((key * np.uint64(0x9E3779B97F4A7C15) ^ part) + np.uint64(level))
            rest.append(_units(open_, width, tuple(p for p in range(8) if p not in chosen)))
        again = pa.array(np.tile(np.arange(n), len(DESIGN)))
        out = [pa.array(np.concatenate(c).view(np.int64)) for c in (keys, rest)]
        return pa.RecordBatch.from_arrays(out + [batch.column(c).take(again) for c in ("fp", "node")], names=["key", "open", "fp", "node"])

    return map_batches(rows, run, "key long, open long, fp long, node long")


def _links(fp: np.ndarray, node: np.ndarray, max_bits: int, least: int) -> np.ndarray:
    """Smallest linked node of each member of a list (itself if none): tally, filter, verify."""
    order = np.argsort(node, kind="stable")
    fp, node = fp[order], node[order]
    differ = fp[:, None] ^ fp[None, :]
    shared = (differ.view(np.uint8).reshape(len(fp), len(fp), 8) == 0).sum(2, dtype=np.uint8)
    linked = (shared >= least) & (np.bitwise_count(differ) <= max_bits)
    label = np.arange(len(fp))
    while True:
        low = np.where(linked, label[None, :], len(fp)).min(1)
        if (low == label).all():
            break
        label = low
    out = np.empty_like(node)
    out[order] = node[label]
    return out


def _compare(postings: DataFrame, level: int, max_bits: int) -> DataFrame:
    """Rows (a, b, key, open, fp): links a - b, or members of lists left to the next level (b null)."""
    least = 8 - max_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(a, b, key=None, open_=None, fp=None) -> pa.RecordBatch:
            nulls = pa.nulls(len(a), pa.int64())
            cols = [pa.array(a), *(nulls if c is None else pa.array(c) for c in (b, key, open_, fp))]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "open", "fp"])

        held: list[np.ndarray] | None = None  # rows of the last key so far: key, open, fp, node
        deferred = None  # the key whose list is too long
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "open", "fp", "node")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            yield from _lists(rows, deferred, emit, last=False)
            key = rows[0]
            start = int(np.searchsorted(key, key[-1]))
            held = [c[start:] for c in rows]
            if level < LEVELS and (deferred == key[-1] or len(held[0]) > LIST_LIMIT):
                deferred = key[-1]
                yield emit(held[3], None, *held[:3])
                held = None
        if held is not None:
            yield from _lists(held, deferred, emit, last=True)

    def _lists(rows: list[np.ndarray], deferred, emit, last: bool) -> Iterator[pa.RecordBatch]:
        key, open_, fp, node = rows
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        if not len(starts):
            return
        if deferred is not None and key[starts[0]] == deferred:  # the rest of a long list
            s, e = starts[0], ends[0]
            yield emit(node[s:e], None, key[s:e], open_[s:e], fp[s:e])
            starts, ends = starts[1:], ends[1:]
        size = ends - starts
        two = starts[size == 2]
        a, b = [node[two]], [node[two + 1]]
        ok = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= max_bits
        a, b = [a[0][ok]], [b[0][ok]]
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            if e - s > LIST_LIMIT and level < LEVELS:
                yield emit(node[s:e], None, key[s:e], open_[s:e], fp[s:e])
                continue
            low = _links(fp[s:e].view(np.uint64), node[s:e], max_bits, least)
            moved = low != node[s:e]
            a.append(node[s:e][moved])
            b.append(low[moved])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield emit(a, b)

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long, open long, fp long")


def _class_links(classes: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between the nodes of classes (fp, node) whose prints are near."""
    rows = classes.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("open"), "fp", "node")
    links = None
    for level in range(1, LEVELS + 1):
        found = stored(_compare(_post(rows, level), level, max_bits), "links")
        here = found.where("b IS NOT NULL").select("a", "b")
        links = here if links is None else links.unionByName(here)
        rows = found.where("b IS NULL").select("key", "open", "fp", F.col("a").alias("node"))
        if rows.isEmpty():
            break
    return links


def _check_bits(max_bits: int) -> None:
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees five equal units up to three differing bits")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id reachable over links."""
    _check_bits(max_bits)
    prints = stored(fingerprints(df, id_col, text_col, shingle), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    roots = components(_class_links(classes.where("node IS NOT NULL"), max_bits)).withColumnRenamed("root", "component_id")
    by_class = stored(classes.join(roots, "node", "left").select("fp", F.coalesce("component_id", "node").alias("component_id")), "by-class")
    return prints.join(by_class, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Rows of ``df`` without the near-duplicates of a row with a smaller id.

    Rows are told apart by id and text: texts are linked by their fingerprints
    alone, so an id with several texts neither links them nor loses one for the
    sake of another. Equal rows of one id are one document: one of them stays.
    A row with a null id is never dropped.
    """
    _check_bits(max_bits)
    key, text = F.col(f"`{id_col}`").cast("long"), F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    source = df.where(key.isNotNull()).select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), text.alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(fps)], names=["doc_id", "t", "fp"])

    prints = stored(map_batches(source, run, "doc_id long, t binary, fp long"), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("fp")), "classes")
    roots = components(_class_links(classes.select("fp", "node"), max_bits))
    rooted = stored(classes.join(roots, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first_id"))
    by_class = stored(rooted.join(firsts, "root").select("fp", "first_id"), "by-class")
    gone = prints.join(by_class, "fp").where("doc_id <> first_id").select(F.col("doc_id").alias("__gone"), F.col("t").alias("__t")).distinct()
    kept = df.join(gone, (key == F.col("__gone")) & (text == F.col("__t")), "left_anti")
    if prints.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        return kept
    named = kept.where(key.isNotNull()).withColumn("__text", text).dropDuplicates([id_col, "__text"]).drop("__text")
    return named.unionByName(kept.where(key.isNull()))
