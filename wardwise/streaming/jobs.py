"""Structured Streaming jobs (K1, K2).

K1 scores every arriving admission with the same column expressions as the
batch path (D1-D3) and routes rows that fail validation, also those of an
unknown site, to a side sink: scored plus rejected rows are all rows.
K2 counts visits per site in tumbling event-time windows with a watermark
(append mode: a day is emitted once the watermark passes its end) and flags
surge days against thresholds from the batch history (stream-static join).

``hourly_volume`` is K2 by the hour with kept state: repeated events are
dropped within the watermark, closed hours are counted, and each site's hours
so far (their number and visits) stay in the state of the query, so an hour is
judged against the mean of the site's earlier hours, also over restarts. Hours
without visits are judged too: an event-time timer tells those at the end.

Sinks are parquet folders with their own checkpoints. A caller that passes
the same ``out`` folder again resumes where the last run stopped, exactly
once; without one each call starts anew below the session's checkpoint folder
(a shared location on a cluster). ``availableNow`` drains what is in the
source and stops; on a live source the same code runs with a processing-time
trigger.

All files that wait are read in one micro-batch unless ``max_files`` says
otherwise, so a backfill does not depend on the order of its files: the
watermark moves only between micro-batches. Rows that do come later than the
watermark allows are counted (``late_rows``).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardwise.functions.rules import alc_factors, alc_risk_score, alc_tier, top_factors
from wardwise.session import checkpoint_dir
from wardwise.sources import dims
from wardwise.sources.bindings import admission_rules, admissions_from, customer_sites, table
from wardwise.sources.validate import validate


def _stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """File stream over a table's path, a single file or a folder of part files (new files are picked up)."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a pattern that only this name matches: the source then takes a single file as well as a folder
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def _run_dir(spark: SparkSession, job: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{job}-{uuid.uuid4().hex[:12]}"


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished query dropped because they came after the watermark."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


SCORED = ("patient_id long, hospital string, alc_risk_raw double, alc_risk_score double, risk_level string, "
          "top_factors array<struct<factor: string, contribution: double>>")
REJECTED = "patient_id long, hospital string, violations array<string>"


def write_scored_batch(out: str):
    """foreachBatch sink of K1: one pass over the micro-batch, two outputs.

    Each output goes to a ``batch=<id>`` folder written in overwrite mode, so
    a micro-batch replayed after a failure replaces its own output
    (idempotent, exactly-once together with the query checkpoint).
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        checked = batch.persist()
        valid = checked.filter(F.size("violations") == 0).drop("violations")
        scored = top_factors(alc_factors(alc_tier(alc_risk_score(valid))))
        factors = F.transform("top_factors", lambda f: F.struct(f["factor"].alias("factor"),
                                                                f["contribution"].alias("contribution")))
        scored.select("patient_id", "hospital", "alc_risk_raw", "alc_risk_score", "risk_level",
                      factors.alias("top_factors")).write.mode("overwrite").parquet(f"{out}/scored/batch={batch_id}")
        checked.filter(F.size("violations") > 0).select("patient_id", "hospital", "violations") \
            .write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
        checked.unpersist()
    return run


def score_admissions(spark: SparkSession, sf_dir: str, out: str | None = None,
                     max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K1: stream orders -> admissions -> validate -> D1-D3; returns the (scored, rejected) sinks."""
    sites = customer_sites(spark, sf_dir).select("c_custkey", "hospital")
    checked = validate(admissions_from(_stream(spark, sf_dir, "orders", max_files), sites),
                       admission_rules(spark, sf_dir))
    out = out or _run_dir(spark, "alc_scores")
    for name, schema in (("scored", SCORED), ("rejected", REJECTED)):  # an empty source has sinks too
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/{name}/batch=-1")
    q = (checked.writeStream.foreachBatch(write_scored_batch(out))
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return (spark.read.schema(SCORED).parquet(f"{out}/scored"), spark.read.schema(REJECTED).parquet(f"{out}/rejected"))


def stream_alc_scores(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """K1: the scored rows."""
    return score_admissions(spark, sf_dir, out)[0]


def volume_stream(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """K2 transformation: visits per (site, tumbling window); late rows past the watermark dropped."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), F.col("hospital"))
            .agg(F.count(F.lit(1)).alias("visits"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "hospital", "visits"))


def event_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-site surge threshold from the batch event history: floor(1.25 x mean daily visits)."""
    ev = table(spark, sf_dir, "events")
    daily = ev.groupBy(F.to_date("ts").alias("d"), F.col("event_type").alias("hospital")).agg(
        F.count(F.lit(1)).alias("n"))
    return daily.groupBy("hospital").agg(F.floor(F.avg("n") * F.lit(1.25)).cast("bigint").alias("surge_threshold"))


def count_volume(spark: SparkSession, sf_dir: str, out: str | None = None,
                 max_files: int | None = None) -> tuple[DataFrame, int]:
    """K2: the sink of closed daily windows per site, and the number of rows that came too late."""
    raw = _stream(spark, sf_dir, "events", max_files)
    events = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("hospital"))
    out = out or _run_dir(spark, "daily_volume")
    q = (volume_stream(events).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{out}/_checkpoint").option("path", f"{out}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    closed = spark.read.schema("window_start timestamp, window_end timestamp, hospital string, visits long")
    return closed.parquet(f"{out}/data"), late_rows(q)


def stream_daily_volume(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """K2: closed daily windows per site with the D9 surge flag."""
    vol, _ = count_volume(spark, sf_dir, out)
    thr = event_thresholds(spark, sf_dir)
    return (vol.join(thr, "hospital")
            .select(F.to_date("window_start").alias("visit_date"), "hospital", "visits", "surge_threshold",
                    (F.col("visits") > F.col("surge_threshold")).cast("int").alias("surge_flag")))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOURLY = ("hospital string, window_start timestamp, visits long, earlier_hours long, surge_threshold long, "
          "surge_flag int")


HOUR_MS = 3_600_000


class HourJudge(StatefulProcessor):
    """Judges every hour of one site since its first, in order, against the mean of the earlier ones.

    Hours with visits arrive closed. The hours between them had none; those
    after the last one are told by an event-time timer, which expires when
    the watermark passes the end of the next hour.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.so_far = handle.getValueState("so_far", "hours long, visits long, next_ms long")

    def _judged(self, site: str, closed: list[tuple[int, int]], until: int | None = None) -> Iterator[pd.DataFrame]:
        """Rows of the closed hours (start in ms, visits) and of the silent ones before them, or up to ``until``."""
        hours, visits, at = self.so_far.get() or (0, 0, closed[0][0])
        timer = at + HOUR_MS
        rows = []
        for start, n in [*closed, *([] if until is None else [(until, None)])]:
            for hour in range(at, start + (n is not None) * HOUR_MS, HOUR_MS):
                count = n if hour == start else 0
                threshold = math.floor(dims.SURGE_MULTIPLIER * visits / hours) if hours else None
                rows.append((site, pd.Timestamp(hour, unit="ms"), count, hours, threshold,
                             int(threshold is not None and count > threshold)))
                hours, visits, at = hours + 1, visits + count, hour + HOUR_MS
        self.so_far.update((hours, visits, at))
        self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + HOUR_MS)
        out = pd.DataFrame(rows, columns=["hospital", "window_start", "visits", "earlier_hours", "surge_threshold",
                                          "surge_flag"])
        yield out.astype({"surge_threshold": "Int64", "window_start": "datetime64[us]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = pd.concat(list(rows))
        starts = closed["window_start"].astype("datetime64[ms]").astype("int64")
        yield from self._judged(key[0], sorted(zip(starts.tolist(), closed["visits"].astype(int).tolist(), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        at = self.so_far.get()[2]
        yield from self._judged(key[0], [], at + (passed - at) // HOUR_MS * HOUR_MS)

    def close(self) -> None:
        pass


def hourly_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """K2 by the hour over (event_id, ts, hospital): judged closed hours.

    Three stateful steps: event ids seen within the watermark, counts of the
    open hours (partial counts are made before the shuffle, so a site with a
    third of all events sends few rows), and one small state row per site.
    """
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    closed = (once.groupBy(F.window("ts", "1 hour").alias("w"), F.col("hospital")).agg(F.count(F.lit(1)).alias("visits"))
              .select(F.window_time("w").alias("at"), F.col("w.start").alias("window_start"), "hospital", "visits"))
    return closed.groupBy("hospital").transformWithStateInPandas(HourJudge(), HOURLY, "append", "EventTime")


def hourly_volume(spark: SparkSession, sf_dir: str, out: str | None = None, max_files: int | None = None) -> DataFrame:
    """K2 by the hour: the sink of judged hours. The same ``out`` resumes where the last run stopped."""
    raw = _stream(spark, sf_dir, "events", max_files)
    events = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("hospital"))
    out = out or _run_dir(spark, "hourly_volume")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # state with named parts needs it
    q = (hourly_stream(events).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{out}/_checkpoint").option("path", f"{out}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(HOURLY).parquet(f"{out}/data")
