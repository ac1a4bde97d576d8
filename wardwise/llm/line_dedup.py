"""Line dedup by distinct-site spread.

Every line is known by its MD5. One HyperLogLog sketch of the sites per line
hash is built by aggregation (partial sketches merge, so a line that a third
of all rows share never meets in one task). A line whose estimate is clear of
the threshold is decided by it; a line near the threshold, within the sketch's
error, gets an exact distinct count of its sites. Lines on at least
``min_sites`` sites are cross-site boilerplate and are removed from all texts.

Copies are told from boilerplate by evidence, on the lines found so far: each
text is one witness, with the smallest of its sites, however many rows it has;
texts that mostly consist of such lines and share the smallest of them are
likely near-copies of each other and together one witness. Only lines that
witnesses on ``min_sites`` sites hold are boilerplate, and these go from every
text that also has a line of its own, whatever their share. A text without one
stays as it is, so no document is emptied.

Decisions about a text are joined back by the text's MD5, so repeated rows and
rows without an id are treated alike.

Edge cases: blank lines are never boilerplate; null texts stay null and have
no lines; a null site is no site; an empty table gives an empty result. Other
columns pass through, except that ``n_lines`` and ``n_removed`` replace
columns of those names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardwise.llm.common import stored, with_arrow_columns

MIN_SITES = 5
LG_K = 12  # sketches of 2 ** LG_K registers


def _lines(df: DataFrame, text_col: str) -> DataFrame:
    """(site, t, total, pos, h, size) of every line that is not blank; t and h are the MD5 of the text and of the line,
    total and size their characters."""
    text = F.col(f"`{text_col}`")
    total = F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = df.select(F.col("__site"), F.unhex(F.md5(text)).alias("t"), total.alias("total"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(F.trim("line") != "").select("__site", "t", "total", "pos", F.unhex(F.md5("line")).alias("h"), F.length("line").alias("size"))


def widespread(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """Hashes ``h`` of the lines on at least ``min_sites`` distinct sites."""
    margin = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    sketches = lines.groupBy("h").agg(F.hll_sketch_agg("__site", lg_k).alias("sketch"))
    near_or_above = stored(sketches.select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin), "line-sites")
    sure = near_or_above.where(F.col("sites") >= min_sites + margin).select("h")
    near = near_or_above.where(F.col("sites") < min_sites + margin).select("h")
    exact = lines.join(near, "h", "left_semi").select("h", "__site").distinct().groupBy("h").agg(F.count("__site").alias("sites"))
    return sure.unionAll(exact.where(F.col("sites") >= min_sites).select("h"))


def _held_by_witnesses(texts: DataFrame, min_sites: int) -> DataFrame:
    """Hashes ``h`` of the lines that witnesses on at least ``min_sites`` sites hold; ``texts`` is (t, site, total, found)."""
    chars = F.aggregate("found", F.lit(0), lambda n, line: n + line["size"])
    witness = F.when(2 * chars > F.col("total"), F.array_min("found.h")).otherwise(F.col("t"))
    held = texts.select("site", witness.alias("witness"), F.explode(F.array_distinct("found.h")).alias("h"))
    sites = held.groupBy("h", "witness").agg(F.min("site").alias("site")).groupBy("h").agg(F.countDistinct("site").alias("n"))
    return sites.where(F.col("n") >= min_sites).select("h")


def remove_boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """``df`` with boilerplate lines removed from the text, plus ``n_lines`` and ``n_removed``."""
    lines = _lines(df.withColumn("__site", F.col(f"`{site_col}`")), text_col)
    candidates = stored(widespread(lines, min_sites), "boilerplate")
    found = F.collect_set(F.struct("pos", "h", "size")).alias("found")
    texts = stored(lines.join(candidates, "h").groupBy("t").agg(F.min("__site").alias("site"), F.first("total").alias("total"), found), "line-texts")
    gone = stored(_held_by_witnesses(texts, min_sites), "line-spread")
    marks = texts.select("t", F.explode("found").alias("line")).join(gone, F.col("line.h") == F.col("h"))
    marks = stored(marks.groupBy("t").agg(F.collect_list("line.pos").alias("__gone")), "line-marks").withColumnRenamed("t", "__t")
    joined = df.join(marks, F.unhex(F.md5(F.col(f"`{text_col}`"))) == F.col("__t"), "left").drop("__t")

    def run(batch: pa.RecordBatch) -> list:
        kept, total, removed = [], [], []
        for text, marked in zip(batch.column(text_col).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
            parts = [] if text is None else text.split("\n")
            drop = set(marked or ())
            if not any(p.strip(" ") for i, p in enumerate(parts) if i not in drop):
                drop = set()
            kept.append("\n".join([p for i, p in enumerate(parts) if i not in drop]) if drop else text)
            total.append(len(parts))
            removed.append(len(drop))
        return [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]

    new = [T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    return with_arrow_columns(joined, run, [text_col, "__gone"], new).drop("__gone")
