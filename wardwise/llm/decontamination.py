"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A
window is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window. A window is contained in a document only if all its
words are, so its necessary prefix, with its words ordered from rare to common
over the corpus, is its rarest word. The join goes through that word: each of
its occurrences in a document proposes one start, which the length and
positional bounds must allow, and the item-sized window of document words
there is compared exactly.

Item windows are written once and reach the tasks in shards of at most
``SHARD_WORDS`` window words (the size bound of each broadcast). Word counts are
aggregated over all documents by the cluster, in one pass for all shards.
Of documents only those counts are shuffled.

Edge cases: null and empty texts have no words and no hits; items without
words match nothing; the windows of items with a null id hit words but add
no item id; repeated items with one id count once; repeated documents are judged alike; an empty table on either side gives no hits.
Other columns pass through, except that ``n_words``, ``hit_spans`` and
``item_ids`` replace columns of those names.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardwise.llm.common import map_batches, stored, texts, with_arrow_columns

SHARD_WORDS = 2_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def words_of(text: str) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split()


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item, w): each window's words, joined by spaces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"item": [], "w": []}
        for item, text in zip(batch.column("item").to_pylist(), texts(batch, "text"), strict=True):
            words = words_of(text)
            for w in {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else ():
                out["item"].append(item)
                out["w"].append(w)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.string()), ("w", pa.binary())]))

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return stored(map_batches(rows, run, "item string, w binary").distinct(), "item-windows")


def _counted(docs: DataFrame, text_col: str, vocabulary: set[bytes] | None = None) -> DataFrame:
    """(word, n): occurrences over all documents, of the vocabulary's words or of all."""
    sent = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else frozenset(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, seen = sent.value, Counter()
        for text in texts(batch, "text"):
            seen.update(words_of(text) if known is None else [w for w in words_of(text) if w in known])
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return map_batches(docs.select(F.col(text_col).alias("text")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _vocabulary(rows: DataFrame) -> DataFrame:
    """Distinct words of windows."""
    return map_batches(rows.select("w"), lambda b: pa.RecordBatch.from_arrays([pa.array(list({x for w in b.column("w").to_pylist() for x in w.split(b" ")}), pa.binary())], names=["word"]), "word binary").distinct()


def _index(windows: dict[bytes, list[str]], counts: dict[bytes, int]) -> dict[bytes, list[tuple[int, int, dict[bytes, list[str]]]]]:
    """Rarest word -> (its offset, window length, windows with their items)."""
    found: dict[bytes, dict[tuple[int, int], dict[bytes, list[str]]]] = defaultdict(lambda: defaultdict(dict))
    for w, items in windows.items():
        words = w.split(b" ")
        rarest = min(words, key=lambda x: (counts.get(x, 0), x))
        if counts.get(rarest, 0):  # a word that no document has: the window is nowhere
            found[rarest][words.index(rarest), len(words)][w] = items
    return {word: [(o, n, ws) for (o, n), ws in sorted(by.items())] for word, by in found.items()}


def _search(words: list[bytes], index: dict, spans: list[tuple[int, int]], items: set[str]) -> None:
    """Add one document's window occurrences to its spans and items."""
    total = len(words)
    for at, word in enumerate(words):
        for offset, size, windows in index.get(word, ()):
            start = at - offset
            if start >= 0 and start + size <= total and (hit := windows.get(b" ".join(words[start : start + size]))) is not None:
                spans.append((start, start + size))
                items.update(hit)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` plus ``n_words``, ``hit_spans`` (merged word ranges, end exclusive) and ``item_ids`` (sorted as strings)."""
    spark = docs.sparkSession
    rows = item_windows(items, window, item_id, item_text)
    shards = 1 + int(rows.agg(F.sum(F.lit(window))).first()[0] or 0) // shard_words
    counted = stored(_counted(docs, text_col).join(_vocabulary(rows), "word", "left_semi"), "word-counts") if shards > 1 else None
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast(T.ArrayType(SPAN)), "item_ids": F.lit(None).cast("array<string>")})
    for shard in range(shards):
        windows: dict[bytes, list[str]] = defaultdict(list)
        own = rows.where(F.pmod(F.xxhash64("w"), F.lit(shards)) == shard)
        for item, w in own.toLocalIterator():
            windows[bytes(w)] += [] if item is None else [item]
        counts = counted.join(_vocabulary(own), "word", "left_semi") if counted else _counted(docs, text_col, {x for w in windows for x in w.split(b" ")})
        index = _index(windows, {bytes(word): n for word, n in counts.collect()})
        sent = spark.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, sent=sent) -> list:
            n, spans, ids = [], [], []
            for text, old, had in zip(texts(batch, text_col), batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True):
                words = words_of(text)
                hits, found = [(s["start"], s["end"]) for s in old or ()], set(had or ())
                _search(words, sent.value, hits, found)
                n.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in _merged(hits)])
                ids.append(sorted(found))
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            return [pa.array(n, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(ids, pa.list_(pa.string()))]

        new = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(SPAN)), T.StructField("item_ids", T.ArrayType(T.StringType()))]
        out = with_arrow_columns(out, run, [text_col, "hit_spans", "item_ids"], new)
    return out
