"""Results that grow with a stream: verdicts so far, the breaker's state, time budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators import ballot

READING = "view_ord int, weight double, kind string, lines array<string>"
BREAKER_OUT = "endpoint string, ts double, call_id bigint, ok boolean, failures int, is_open boolean, half_open boolean"


def progressive_verdicts(readings: DataFrame, out_dir: str, checkpoint: str):
    """Keeps every image's best verdict so far; returns the started query.

    ``readings`` streams image_id with READING. State is one list of readings an image
    (a handful of views). Each batch replaces nothing in place: it writes the verdicts
    of the images it touched under its batch number, so a batch that runs again writes
    the same folder, and ``latest`` picks each image's newest.
    """
    sofar = readings.groupBy("image_id").agg(F.collect_list(F.struct("view_ord", "weight", "kind", "lines")).alias("r"))

    def write(batch: DataFrame, number: int):
        rows = batch.select("image_id", F.explode("r").alias("r")).select("image_id", "r.*")
        seen = batch.select("image_id", F.size("r").alias("n_readings"))
        ballot.vote(rows).join(seen, "image_id").write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return sofar.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark, out_dir: str) -> DataFrame:
    """The newest verdict of each image."""
    rows = spark.read.parquet(out_dir)
    cols = [c for c in rows.columns if c not in ("image_id", "batch")]
    return rows.groupBy("image_id").agg(F.max_by(F.struct(*cols), "batch").alias("v")).select("image_id", "v.*")


def breaker(calls: DataFrame, threshold: int, reset_seconds: float) -> DataFrame:
    """Streaming form of the breaker: the state is a count of failures and the last call's time, by endpoint."""

    def step(key, batches, state: GroupState):
        failures, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "call_id"], kind="stable")
        out = []
        for ts, call, ok in zip(rows["ts"], rows["call_id"], rows["ok"], strict=True):
            half = failures >= threshold and last is not None and ts - last >= reset_seconds
            failures = 0 if ok else failures + 1
            last = float(ts)
            out.append((key[0], last, int(call), bool(ok), failures, failures >= threshold, bool(half)))
        state.update((failures, last))
        yield pd.DataFrame(out, columns=["endpoint", "ts", "call_id", "ok", "failures", "is_open", "half_open"])

    return calls.groupBy("endpoint").applyInPandasWithState(step, BREAKER_OUT, "failures int, last double", "append", GroupStateTimeout.NoTimeout)


def within_budget(views: DataFrame, overall_s: float = 24.0, per_view_s: float = 16.0, floor_s: float = 2.0) -> DataFrame:
    """Views (image_id, started_s, latency_s) that come in time.

    A view may take ``per_view_s``, or what is left of the overall budget when it
    starts if that is less, but ``floor_s`` at the least.
    """
    left = F.greatest(F.lit(floor_s), F.least(F.lit(per_view_s), overall_s - F.col("started_s")))
    return views.where(F.col("latency_s") <= left)


def retries(views: DataFrame, overall_s: float = 24.0, least_left_s: float = 6.0) -> DataFrame:
    """Failed first readings (image_id, view_ord, ended_s, ok, attempt) with time left for their one retry."""
    return views.where(~F.col("ok") & (F.col("attempt") == 0) & (overall_s - F.col("ended_s") > least_left_s))


def windowed_counts(events: DataFrame, ts: str = "ts", window: str = "1 day", late: str = "1 hour", *by: str) -> DataFrame:
    """Counts by event-time window behind a watermark."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"))
