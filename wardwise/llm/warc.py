"""WARC archives written from pages and read back with boundary-chain verification.

Writing. Every page becomes one record, built by SQL expressions and written
by Spark's text writer with the record separator as its line separator: plain
uncompressed WARC files. Of the pages with equal payloads of at least
``REVISIT_BYTES`` bytes the one with the smallest id is a ``response``, the
others are ``revisit`` records, which hold the HTTP header and a reference but
no payload. Smaller payloads are always responses.

Reading. Spark's text reader splits the files at the magic line, so each task
sees the stretch between two magics in its byte range. A task emits for each
the candidate record and the offset at which its successor must begin by its
Content-Length. Inside a range, pointers are followed to where the chain leaves
it (the exit). Across ranges, pointer jumping from each file's start doubles
the reach of the exits until no new entry is found; it works on the entries
only, a few rows a range. Candidates on the chain from their range's entry are
records; a magic inside a payload is on no chain and is rejected. A payload
that a false magic continues into the next range is completed from there.

Edge cases: a null payload is empty; a null id makes a response without an id;
repeated rows make repeated records; line ends in URLs are dropped, a null URL
is left out; empty tables write and read as no records; a file whose chain
breaks yields the records up to the break.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from wardwise.llm.common import shared_path, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 100
BROADCAST_ROWS = 100_000  # revisit references (at most about 100 bytes each) sent to all tasks; beyond, a shuffle join
DATE = "1970-01-01T00:00:00Z"
_SIZE = len(MAGIC)
_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*?)[ \t]*\r?$", re.M)
_CANDIDATE = "file string, block long, rel long, next long, exit long, total long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, part binary, size long"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write one record per page below ``path`` and return the path."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    large = rows.where((F.col("n") >= revisit_bytes) & F.col("id").isNotNull()).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    revisits = stored(large.join(first, "digest").where("id <> first").select("id", "digest", "first").distinct(), "revisits")
    small = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(revisits) if small else revisits, ["id", "digest"], "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    is_copy = F.col("first").isNotNull()
    uuid = F.regexp_replace(F.md5(F.concat_ws(" ", F.col("id").cast("string"), "digest")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(is_copy, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.concat(F.lit("<"), F.regexp_replace("url", "[\r\n]", ""), F.lit(">"))),  # no header line ends like a magic
        line("WARC-Page-ID", F.col("id").cast("string")),
        line("WARC-Refers-To-Page-ID", F.col("first").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(is_copy, F.lit(0)).otherwise(F.col("n"))).cast("string")),
        F.lit("\r\n"),
        http,
        F.when(is_copy, F.lit("")).otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)
    return path


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the stretches between magics, in file order within each byte range."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, block, pieces) for each byte range of a task."""
    now, pieces = None, []
    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if (file, block) != now:
                if now:
                    yield (*now, pieces)
                now, pieces = (file, block), []
            pieces.append(value or b"")
    if now:
        yield (*now, pieces)


def _payload(content: bytes, headers: dict[bytes, bytes]) -> tuple[int, str | None]:
    """Size and SHA-256 of a record's payload; a revisit's are those in its headers."""
    head, _, body = content.partition(b"\r\n\r\n")
    if headers.get(b"warc-type") == b"revisit":
        http = {k.lower(): v for k, v in _HEADER.findall(head)}
        return int(http.get(b"content-length", b"0")), headers.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:")
    return len(body), hashlib.sha256(body).hexdigest()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate records of each byte range, with successor and exit offsets relative to the range's first piece."""
    for file, block, pieces in _by_range(batches):
        data = MAGIC.encode().join(pieces)
        starts = np.cumsum([0, *(len(p) + _SIZE for p in pieces)])
        total, rows = int(starts[-1]), []
        for rel, piece in zip(starts[:-1].tolist(), pieces, strict=True):
            end = piece.find(b"\r\n\r\n")
            headers = {k.lower(): v for k, v in _HEADER.findall(piece[:end])} if end > 0 else {}
            length = headers.get(b"content-length", b"")
            if not length.isdigit():
                continue  # no record can start here; also what stands before a file's first magic
            at, size = rel + end + 4, int(length)
            row = {"rel": rel, "next": at + size + 4 + _SIZE, "record_type": headers.get(b"warc-type", b"").decode(errors="replace"), "size": size}
            row |= {c: int(headers[k]) if headers.get(k, b"").lstrip(b"-").isdigit() else None for c, k in (("page_id", b"warc-page-id"), ("refers_to", b"warc-refers-to-page-id"))}
            if at + size <= len(data):
                row["payload_bytes"], row["payload_digest"] = _payload(data[at : at + size], headers)
            else:
                row["part"] = data[at:]
            rows.append(row)
        exits: dict[int, int | None] = {}
        for row in reversed(rows):  # every pointer goes forward
            exits[row["rel"]] = row["exit"] = row["next"] if row["next"] >= total else exits.get(row["next"])
        # a range without candidates still counts for the offsets of the ranges after it
        rows = rows or [{"rel": None}]
        out = pd.DataFrame(rows).assign(file=file, block=block, total=total)
        yield pa.RecordBatch.from_pylist(
            [{k: (None if v is None or v is pd.NA or v != v else v) for k, v in r.items()} for r in out.to_dict("records")],
            schema=_SCHEMA,
        )


_SCHEMA = pa.schema(
    [pa.field(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split(" ") for c in _CANDIDATE.split(", "))]
)


def _reached(pointers: DataFrame) -> DataFrame:
    """(file, at) of all entries that are reached from a file's start, by pointer jumping over (file, at, to)."""
    reach = stored(pointers.where(F.col("at") == _SIZE).select("file", "at"), "reach")
    n = reach.count()
    while True:
        stepped = reach.join(pointers, ["file", "at"]).select("file", F.col("to").alias("at")).where("at IS NOT NULL")
        reach = stored(reach.unionAll(stepped).distinct(), "reach")
        if (more := reach.count()) == n:
            return reach
        n = more
        twice = pointers.select("file", F.col("at").alias("to"), F.col("to").alias("__to"))
        pointers = stored(pointers.join(twice, ["file", "to"], "left").select("file", "at", F.col("__to").alias("to")), "pointers")


def _on_chain(key: tuple, rows: pa.Table) -> pa.Table:
    """The candidates of one byte range that lie on the chain from its entries."""
    to = dict(zip(rows.column("rel").to_pylist(), rows.column("next").to_pylist(), strict=True))
    on = set()
    for at in set(rows.column("entry").to_pylist()):
        while at in to and at not in on:
            on.add(at)
            at = to[at]
    return rows.filter(pa.array([r in on for r in rows.column("rel").to_pylist()], pa.bool_())).drop(["entry"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, page_id, record_type, refers_to, payload_bytes, payload_digest) of every record below ``path``."""
    found = stored(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    blocks = found.groupBy("file", "block").agg(F.max("total").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # ranges of one file: its size over the split size
    blocks = stored(blocks.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))), "warc-blocks")
    cands = found.where("rel IS NOT NULL").join(blocks.select("file", "block", "base"), ["file", "block"])
    at = F.col("base") + F.col("rel")
    hops = cands.select("file", at.alias("at"), (F.col("base") + F.col("exit")).alias("to"))
    entries = hops.select("file", F.col("to").alias("at")).where("at IS NOT NULL").unionAll(hops.select("file", F.lit(_SIZE).cast("long").alias("at"))).distinct()
    reached = _reached(stored(hops.join(entries, ["file", "at"]).distinct(), "pointers"))
    entry = reached.withColumnRenamed("at", "__at").join(cands.select("file", "block", "rel", at.alias("__at")), ["file", "__at"])
    entry = entry.select("file", "block", F.col("rel").alias("entry")).distinct()
    # a chain enters a range once
    chained = cands.join(entry, ["file", "block"]).groupBy("file", "block").applyInArrow(_on_chain, f"{_CANDIDATE}, base long")
    records = stored(chained.withColumn("offset", at - _SIZE), "warc-records")
    whole = records.where("part IS NULL")
    out = ["file", "offset", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    cut = records.where("part IS NOT NULL")
    if cut.isEmpty():
        return whole.select(out)
    return whole.select(out).unionByName(_completed(spark, path, cut, blocks).select(out))


def _completed(spark: SparkSession, path: str, cut: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records that false magics continue over the end of their byte range, at most one a range."""
    need = cut.select("file", "offset", F.col("block").alias("__block"), (F.col("base") + F.col("next")).alias("__until"))
    fetch = need.join(blocks, "file").where("block > __block AND base < __until").select("file", "block", "base", "offset", "__until")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, pieces in _by_range(batches):
            rel = np.cumsum([0, *(len(p) + _SIZE for p in pieces)])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(pieces)), pa.array([block] * len(pieces), pa.int64()), pa.array(rel, pa.int64()), pa.array(pieces, pa.binary())], names=["file", "block", "rel", "value"])

    pieces = _pieces(spark, path).mapInArrow(offsets, "file string, block long, rel long, value binary")
    more = pieces.join(fetch, ["file", "block"]).where("base + rel < __until").select("file", "offset", F.struct(F.col("base") + F.col("rel"), "value").alias("p"))
    tails = more.groupBy("file", "offset").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["value"]).alias("__tail"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                content = MAGIC.encode().join([r.pop("part"), *(r.pop("__tail") or [])])[: r.pop("size")]
                r["payload_bytes"], r["payload_digest"] = _payload(content, {})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = "file string, offset long, page_id long, record_type string, refers_to long"
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split(" ") for c in f"{names}, payload_bytes long, payload_digest string".split(", "))])
    rows = cut.select(*[c.split(" ")[0] for c in names.split(", ")], "part", "size").join(tails, ["file", "offset"], "left")
    return rows.mapInArrow(finish, f"{names}, payload_bytes long, payload_digest string")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to a new archive folder in the shared folder and read its records back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, shared_path(spark, "warc"), id_col, url_col, payload_col))
