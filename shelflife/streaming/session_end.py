"""Run the retention pass when sessions end on an activity stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelflife.functions.times import time_type, to_instant
from shelflife.operators.policy import settings_of
from shelflife.session import drop_folder

# Sessions of one partition are merged before the shuffle, so a user with most of the events sends one
# row per session and task, not one per event.
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
# Open sessions are kept outside the heap and on disk, so their number is not bounded by memory.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
STREAM_SETTINGS = {
    LOCAL_MERGE: "true",
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    CHANGELOG: "true",
}


def closed_sessions(activity: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions of each key: activity at most ``gap`` apart belongs together.

    On a stream a session comes out once the watermark, ``delay`` behind the latest event, has passed
    its end.
    """
    window = F.session_window(time, gap)
    return (
        activity.withColumn(time, to_instant(F.col(time), time_type(activity, time)))
        .withWatermark(time, delay)
        .groupBy(key, window)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            key,
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "events",
        )
    )


def run_on_session_end(
    sessions: DataFrame,
    retention_pass: Callable[[dt.datetime, str], DataFrame],
    out_dir: str,
    policy: dict | Callable[[], dict | None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream: a batch with closed sessions runs the retention pass once.

    ``retention_pass(as_of, run_dir)`` gets the latest session end of the batch and a folder of its own,
    and returns the run's one total row. Closed sessions go to ``out_dir/sessions``, totals to
    ``out_dir/runs``, both by batch, so a repeated batch replaces its own output; a batch without closed
    sessions leaves nothing. A policy given as a function is read at every batch. With
    ``clean_on_session_end`` off the batch runs nothing and is recorded in ``out_dir/skipped``; with
    ``session_end_summary`` off the line for the user is left out.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(f"{out_dir}/sessions/{part}")
        closed = spark.read.schema(batch.schema).parquet(f"{out_dir}/sessions/{part}")
        row = closed.agg(
            F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("session_end")).alias("at")
        ).first()
        if row["n"] == 0:
            # The batch is written before it is looked at, since each look would run its stateful plan again.
            drop_folder(spark, f"{out_dir}/sessions/{part}")
            return
        settings = settings_of(policy() if callable(policy) else policy)
        marks = {
            "as_of": F.timestamp_micros(F.lit(row["at"])),
            "closed_sessions": F.lit(row["n"]).cast("bigint"),
        }
        if not settings["clean_on_session_end"]:
            spark.range(1).select(*(c.alias(n) for n, c in marks.items())).write.mode("overwrite").parquet(f"{out_dir}/skipped/{part}")
            return
        as_of = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=row["at"])
        total = retention_pass(as_of, f"{out_dir}/purge/{part}")
        if not settings["session_end_summary"]:
            total = total.withColumn("session_message", F.lit(None).cast("string"))
        total.withColumns(marks).write.mode("overwrite").parquet(f"{out_dir}/runs/{part}")

    spark = sessions.sparkSession
    before = {name: spark.conf.get(name, None) for name in STREAM_SETTINGS}
    try:
        for name, value in STREAM_SETTINGS.items():
            spark.conf.set(name, value)
        # The query takes a copy of the session's settings when it starts.
        return (
            sessions.writeStream.outputMode("append")
            .option("checkpointLocation", f"{out_dir}/checkpoint")
            .foreachBatch(on_batch)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
