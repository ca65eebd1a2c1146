"""Incremental forms of the batch operators on Structured Streaming.

All state is Spark's own (windows, aggregates, duplicate filters); groups still open at the end of
the input are read from it. Results are written per micro-batch into ``batch_id=N`` folders which a replay overwrites, or by the Parquet sink
with its own log, so a lost executor or a restarted query leaves no duplicates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessaly.functions import vocabulary as V
from tessaly.operators.chunking import split_text
from tessaly.operators.jobs import next_retry
from tessaly.operators.memory import partial_fold
from tessaly.sources.folders import is_folder, shared_root


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names for checkpoints."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of one table as they arrive: in a folder of the table's name, or files of that name in ``folder``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    own = f"{folder}/{name}"
    return reader.parquet(own) if is_folder(spark, own) else reader.option("pathGlobFilter", name).parquet(folder)


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is available into a Parquet table and return it."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log")
        .option("path", f"{folder}/rows").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_batches(stream: DataFrame, folder: str, shape: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Process what is available; every micro-batch writes its own ``batch_id`` folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows")


def open_groups(groups: DataFrame, folder: str) -> DataFrame:
    """Groups that still wait behind the watermark, with the columns of ``groups``, read from the state which the
    stream left in its folder. Nothing is computed twice, and a later run goes on from the same state.

    The buffers of the aggregates must be their results, as those of counts, minima and maxima are; columns stand as keys,
    window, aggregates.
    """
    state = groups.sparkSession.read.format("statestore").load(f"{folder}/log")
    held = {part: [f"{part}.{name}" for name in state.schema[part].dataType.names] for part in ("key", "value")}
    # Session state repeats its keys beside the aggregates, window state does not.
    columns = held["value"] if len(held["value"]) == len(groups.columns) else held["key"] + held["value"]
    return state.select(*[F.col(c).alias(name) for c, name in zip(columns, groups.columns, strict=True)])


def run_complete(groups: DataFrame, folder: str) -> DataFrame:
    """Process what is available and return every group: those the watermark closed, and those open at the end of the input.

    Closed groups are appended once and never change; open ones are the state of the last batch, so replays and
    further runs over the same folder neither lose nor repeat a group. ``open`` tells them apart.
    """
    closed = run_append(groups, folder).withColumn("open", F.lit(False))
    return closed.unionByName(open_groups(groups, folder).withColumn("open", F.lit(True)))


def activity(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions per item with their count and newest event. Native session state, no Python."""
    newest = F.max(F.struct("ts", "event_id", "status", "cancel_requested"))
    windowed = events.withWatermark("ts", delay).groupBy("job_id", F.session_window("ts", gap))
    return windowed.agg(F.count(F.lit(1)).alias("events"), newest.alias("newest"))


def stale_heartbeats(events: DataFrame, folder: str, now: Column, delay: str = "10 minutes", seconds: int = V.STALE_SECONDS) -> DataFrame:
    """Items which went silent for longer than the limit while running, those silent at the end of the input among them.

    A session of activity closes after the limit plus one microsecond of silence; a session whose last event is a
    running one is a stale item. What the watermark has not closed yet is judged by ``now``.
    """
    sessions = run_complete(activity(events, f"{seconds} seconds 1 microsecond", delay), folder)
    # An open session of an item may be followed by another one, which shows that it was silent.
    silent = ~F.col("open") | (F.unix_micros(now) - F.unix_micros("newest.ts") > seconds * 1_000_000)
    return sessions.filter(silent & F.col("newest.status").isin("running", "cancelling")).select(
        "job_id", F.col("newest.event_id").alias("event_id"), F.when(F.col("newest.cancel_requested"), "cancelled").otherwise("queued").alias("status")
    )


def heartbeat_sessions(events: DataFrame, folder: str, gap_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Sessions of activity per item, with those still open."""
    return run_complete(activity(events, f"{gap_seconds} seconds", delay), folder).select(
        "job_id", F.col("session_window.start").alias("started_at"), F.col("newest.ts").alias("last_at"), "events", "open"
    )


def weekly_refresh_windows(events: DataFrame, folder: str, delay: str = "1 day") -> DataFrame:
    """Volume per seven-day window, with the windows still open; rows later than the watermark are dropped."""
    windowed = events.withWatermark("ts", delay).groupBy("event_type", F.window("ts", f"{V.REFRESH_DAYS} days"))
    return run_complete(windowed.agg(F.count(F.lit(1)).alias("n")), folder).select("event_type", F.col("window.start").alias("window_start"), "n", "open")


def status_updates(events: DataFrame) -> DataFrame:
    """Running status of each job, re-emitted when it changes (update mode). State is one row per job."""
    return events.groupBy("job_id").agg(
        F.max(F.struct("ts", "event_id", "status")).alias("l"), F.count_if(F.col("status") == "retry_wait").alias("attempts"),
        F.count(F.lit(1)).alias("seen"),
    ).select("job_id", F.col("l.status").alias("status"), F.col("l.ts").alias("updated_at"), "attempts", "seen")


def latest_updates(updates: DataFrame) -> DataFrame:
    """Current row of each job from its emitted updates."""
    newest = updates.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at", "attempts"), "seen").alias("n"))
    return newest.select("job_id", "n.*").withColumn("next_retry_at", next_retry(F.col("updated_at"), F.col("status"), F.col("attempts")))


def memory_upsert_stream(events: DataFrame, folder: str) -> DataFrame:
    """Partial folds per micro-batch; ``memory.merge_folds`` reads them as memories."""
    return run_batches(events, folder, partial_fold, "append")


def first_arrivals(docs: DataFrame, folder: str) -> DataFrame:
    """``content_hash, id``: each content once, with the document that arrived first (the smallest id of ties).

    ``docs``: id, body, arrived_at. The stream keeps one short row per content, no text: which document comes first is
    settled over all batches before texts are read, so the choice depends neither on files nor on tasks.
    """
    hashed = docs.withColumn("content_hash", F.sha2(F.col("body"), 256))
    firsts = hashed.groupBy("content_hash").agg(F.min(F.struct("arrived_at", "id")).alias("first"))
    updates = run_batches(firsts, folder, lambda batch: batch, "update")
    return updates.groupBy("content_hash").agg(F.min("first").alias("first")).select("content_hash", F.col("first.id").alias("id"))


def ingested_chunks(firsts: DataFrame, docs: DataFrame, size: int = V.INDEX_CHUNK, overlap: int = V.INDEX_OVERLAP) -> DataFrame:
    """Chunks of the documents chosen by ``first_arrivals``, led back to their ids."""
    return split_text(docs.join(firsts, "id").select("id", "content_hash", "body"), size=size, overlap=overlap)
