"""Approximate nearest neighbours by collision counting with virtual rehashing.

The vectors are dealt once, by a hash of their id, to shards of at most
``SHARD`` rows. A shard keeps, for each of ``PROJECTIONS`` directions, one sorted
array of the vectors' projections; directions come in random orthogonal sets, as
many as there are dimensions in each, so a set's projections together hold the
whole distance. Around a query's projections windows of half a radius' width are
opened; a vector collides with the query in a direction if it lies in the
window. Virtual rehashing grows the radius by ``GROWTH`` and only counts what
the wider windows add. A vector with at least ``COLLISIONS`` collisions is
verified with its exact distance: the nearest reach that number at the smallest
radius. A query is done in a shard once ``k`` verified vectors lie within the
radius, or once ``k`` and the share ``VERIFIED`` of the shard (``LEAST`` at
least) are verified: where distances differ little, nearly all vectors would
follow at the next radius. The first radius is a little less than the distance to
the nearest of a few vectors of the shard. Both numbers are parameters of the index, and recall
is measured against brute force. The shards' nearest are merged by rank.

Every row is indexed. Queries reach the tasks in blocks of at most
``QUERY_BLOCK`` rows, the size bound of each broadcast; with several blocks the
dealt table is written once, and a shard's index is built again for each (a
thousandth of the block's work). Equal vectors of a shard are one entry that
keeps its ``k + 1`` smallest ids, which is all that any query can return of them.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part, neither do rows with a null id; vectors of another
length than the query's are no candidates; rows that repeat an id and a vector
are one; ties go to the smaller id; an empty table or too few candidates give
as many rows as there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwise.llm.common import stored

SHARD = 8_192
PROJECTIONS = 128
WIDTH = 2.0  # of a window, in radii
COLLISIONS = 80  # of the projections
GROWTH = 1.06
VERIFIED, LEAST = 0.06, 200
FIRST = 0.7  # first radius, in distances to the nearest of 256 vectors of the shard
QUERY_BLOCK = 20_000
SEED = 11
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class CollisionIndex:
    """Sorted projections of one shard's distinct vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        if len(vectors) <= LEAST:
            return  # so few are all verified
        size, rng = vectors.shape[1], np.random.default_rng(SEED)
        sets = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-PROJECTIONS // size))]
        self.axes = np.concatenate(sets, 1)[:, :PROJECTIONS] * np.sqrt(size)
        values = vectors @ self.axes
        order = np.argsort(values, axis=0, kind="stable").T
        self.order = np.ascontiguousarray(order)
        # all sorted arrays one after another, each moved to a range of its own: one search finds a place in every array
        self.low = values.min() - 1.0
        self.room = 2 * (values.max() - self.low) + 2.0
        self.moved = np.arange(PROJECTIONS) * self.room - self.low
        self.sorted = (np.take_along_axis(values.T, order, 1) + self.moved[:, None]).ravel()

    def _windows(self, centre: np.ndarray, half: float) -> np.ndarray:
        """(2, projections): first and end rank of each window."""
        ends = np.clip(np.stack([centre - half, centre + half]), self.low, self.low + self.room / 2) + self.moved
        first = np.arange(PROJECTIONS) * len(self.vectors)
        return np.stack([np.searchsorted(self.sorted, ends[0]), np.searchsorted(self.sorted, ends[1], "right")]) - first

    def near(self, query: np.ndarray, enough, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Verified vectors and their distances; ``enough(rows, distances, radius)`` ends the growth."""
        n = len(self.vectors)
        if n <= LEAST:
            return np.arange(n), np.sqrt(((self.vectors - query) ** 2).sum(1))
        centre = query @ self.axes
        counts, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        lo = hi = None
        rows, distances = np.zeros(0, np.int64), np.zeros(0)
        while True:
            new_lo, new_hi = self._windows(centre, WIDTH * radius / 2)
            if lo is None:
                lo = hi = new_lo
            parts = [o[a:b] for o, a, b in zip(self.order, new_lo.tolist(), lo.tolist(), strict=True)]
            parts += [o[a:b] for o, a, b in zip(self.order, hi.tolist(), new_hi.tolist(), strict=True)]
            lo, hi = new_lo, new_hi
            counts += np.bincount(np.concatenate(parts), minlength=n)
            fresh = np.flatnonzero((counts >= COLLISIONS) & ~seen)
            if len(fresh):
                seen[fresh] = True
                rows = np.concatenate([rows, fresh])
                distances = np.concatenate([distances, np.sqrt(((self.vectors[fresh] - query) ** 2).sum(1))])
            if len(rows) == n or len(rows) >= max(LEAST, VERIFIED * n) or enough(rows, distances, radius):
                return rows, distances
            radius *= GROWTH


def _search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.Table:
    """The k nearest of a shard for each query: (query_id, vec_id, score)."""
    order = np.argsort(ids, kind="stable")
    distinct, entry = np.unique(vectors[order], axis=0, return_inverse=True)
    by_entry = np.argsort(entry.ravel(), kind="stable")  # within an entry ids ascend
    ids, entry = ids[order][by_entry], entry.ravel()[by_entry]
    first = np.searchsorted(entry, np.arange(len(distinct)))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (entry[1:] != entry[:-1])
    members = [[]] * len(distinct)
    for e, (s, t) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True)):
        members[e] = ids[s:t][fresh[s:t]][: k + 1]
    sizes = np.array([len(m) for m in members])
    index = CollisionIndex(distinct)
    spread = np.random.default_rng(SEED).permutation(len(distinct))[:256]
    out = []
    for q, query in zip(query_ids.tolist(), queries, strict=True):
        sample = np.sort(np.sqrt(((distinct[spread] - query) ** 2).sum(1)))
        start = max(FIRST * float(sample[sample > 0][0]) if sample[-1] > 0 else 0.0, 1e-9)

        def enough(rows: np.ndarray, distances: np.ndarray, radius: float) -> bool:
            return int(sizes[rows[distances <= radius]].sum()) >= k + 1  # the query's own row may be among them

        rows, distances = index.near(query, enough, start)
        cut = np.sort(distances)[min(len(rows), k + 1) - 1]  # ties at the cut stay in
        best = rows[distances <= cut]
        found = [(d, v) for e, d in zip(best.tolist(), distances[distances <= cut].tolist(), strict=True) for v in members[e].tolist() if v != q]
        out += [(q, v, d) for d, v in sorted(found)[:k]]
    cols = zip(*out, strict=True) if out else ([], [], [])
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, OUT.types, strict=True)], schema=OUT)


def _shard_search(sent: Broadcast, k: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search of the shards, of at most ``size`` rows, that a task reads for the queries of one block."""

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        sizes = pc.list_value_length(rows.column("v")).to_numpy()
        for length in np.unique(sizes).tolist():
            if length in sent.value:
                own = rows.filter(pa.array(sizes == length))
                vectors = own.column("v").combine_chunks().flatten().to_numpy().reshape(-1, length)
                yield from _search(own.column("id").to_numpy(), vectors, *sent.value[length], k).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room = size
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, room))
                batch, room = batch.slice(room), room - held[-1].num_rows
                if not room:
                    yield from search(held)
                    held, room = [], size
        if held:
            yield from search(held)

    return run


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each row for which ``is_query`` holds."""
    spark = df.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v"), is_query.alias("q")).where(usable(F.col("v")))
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERY_BLOCK))
    dealt = rows.select("id", "v").repartition(shards, "id")
    dealt = stored(dealt, "dealt-vectors") if blocks > 1 else dealt
    found = None
    for block in range(blocks):
        chosen = rows.where("q").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == block).select("id", "v").distinct().collect()
        by_size: dict[int, tuple[list, list]] = {}
        for q in chosen:
            ids, vectors = by_size.setdefault(len(q["v"]), ([], []))
            ids.append(q["id"])
            vectors.append(q["v"])
        sent = spark.sparkContext.broadcast({s: (np.array(i), np.array(v)) for s, (i, v) in by_size.items()})

        part = dealt.mapInArrow(_shard_search(sent, k, SHARD), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
