"""Work items: status from events, due and stale items, retry rules, audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.functions.text import contains_any
from tessaly.operators.segmented import neighbour, running_sum


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next attempt: 5 doubling to at most 300."""
    exponent = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(6))
    return F.least(F.lit(300), (5 * F.pow(F.lit(2), exponent)).cast("bigint"))


def short_delay(attempts: Column) -> Column:
    return F.least(F.lit(30), F.pow(F.lit(2), F.least(attempts, F.lit(10))).cast("bigint"))


def is_retryable(message: Column) -> Column:
    return contains_any(F.lower(message), V.RETRYABLE_MARKERS)


def is_active(status: Column) -> Column:
    return status.isin(*V.ACTIVE_STATUSES)


def latest_status(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Current status of each item with attempts and times, from its events. Aggregates only."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return events.groupBy(key).agg(
        last.alias("l"), F.min("ts").alias("created_at"), F.count_if(F.col("status") == "retry_wait").alias("attempts"),
        F.max(F.when(F.col("status") == "running", F.col("ts"))).alias("heartbeat_at"),
        F.max_by("document_id", F.struct("ts", "event_id")).alias("document_id"),
        F.max(F.col("cancel_requested").cast("int")).alias("cancel_requested"),
    ).select(key, F.col("l.status").alias("status"), F.col("l.ts").alias("updated_at"), "created_at", "attempts", "heartbeat_at", "document_id", "cancel_requested")


def next_retry(updated_at: Column, status: Column, attempts: Column) -> Column:
    return F.when(status == "retry_wait", updated_at + F.make_dt_interval(secs=retry_delay(attempts)))


def due_items(jobs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Not cancelled and queued, or waiting for a retry time which has come (or is missing); oldest first."""
    due = jobs.filter(
        (F.col("cancel_requested") == 0)
        & ((F.col("status") == "queued") | ((F.col("status") == "retry_wait") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))))
    ).orderBy("created_at", "job_id")
    return due if limit is None else due.limit(limit)


def one_active_per_document(jobs: DataFrame) -> DataFrame:
    """The first active job of a document wins; later requests get its id."""
    first = jobs.filter(is_active(F.col("status"))).groupBy("document_id").agg(F.min(F.struct("created_at", "job_id")).alias("f"))
    return jobs.join(first, "document_id").select("document_id", "job_id", F.col("f.job_id").alias("active_job_id"))


def document_status(docs: DataFrame, latest: DataFrame) -> DataFrame:
    """What the newest job does to its document."""
    empty = F.coalesce("body", F.lit("")) == ""
    status = (
        F.when(F.col("job_status") == "queued", F.when(empty, "processing").otherwise(F.col("status")))
        .when(F.col("job_status") == "cancelling", F.when(empty, "error").otherwise("ready"))
        .when(F.col("job_status") == "retry_wait", F.when(empty, "processing").otherwise("ready"))
        .otherwise(F.col("status"))
    )
    newest = latest.groupBy("document_id").agg(F.max(F.struct("updated_at", "job_id", "status")).alias("n"))
    jobs = newest.select(F.col("document_id").alias("id"), F.col("n.status").alias("job_status"))
    return docs.join(jobs, "id", "left").select("id", "job_status", status.alias("status"))


def stale_gaps(events: DataFrame, now: Column, seconds: int = V.STALE_SECONDS) -> DataFrame:
    """Running items which then stayed silent for longer than the limit; after its last event an item is silent until ``now``.

    ``events``: job_id, ts, event_id, status, cancel_requested. The next event is found per
    (job, day) with a carry between days, so one busy job is not one task.
    """
    placed = events.withColumn("day", F.to_date("ts"))
    followed = neighbour(placed, ["job_id"], "day", ["ts", "event_id"], "ts", "next_ts", 1)
    silent = F.unix_micros(F.coalesce(F.col("next_ts").cast("timestamp"), now)) - F.unix_micros(F.col("ts").cast("timestamp"))
    return followed.filter((F.col("status").isin("running", "cancelling")) & (silent > seconds * 1_000_000)).select(
        "job_id", "event_id", F.when(F.col("cancel_requested"), "cancelled").otherwise("queued").alias("status"),
        (silent / 1_000_000).alias("silent_seconds"),
    )


def activity_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Sessions of activity per item: a gap longer than the limit starts a new one.

    Same result as a session window, computed per (item, day) with carries.
    """
    placed = events.withColumn("day", F.to_date("ts"))
    lagged = neighbour(placed, ["job_id"], "day", ["ts", "event_id"], "ts", "previous_ts", -1)
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))
    opens = (gap.isNull() | (gap >= gap_seconds * 1_000_000)).cast("int")
    numbered = running_sum(lagged, ["job_id"], "day", [F.col("ts"), F.col("event_id")], opens, "session_no")
    return numbered.groupBy("job_id", "session_no").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("events")
    )


def tool_success(runs: DataFrame, trace: str = "tool_trace_json") -> DataFrame:
    """Calls and failures per tool from audit logs."""
    return trace_events(runs, trace).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"))


TRACE_SCHEMA = "array<struct<tool:string,ok:boolean,output:struct<success:boolean,record_id:string>,error:string>>"


def trace_events(runs: DataFrame, trace: str = "tool_trace_json") -> DataFrame:
    parsed = F.from_json(trace, TRACE_SCHEMA)
    return runs.select("run_id", F.posexplode(parsed).alias("position", "e")).select("run_id", "position", "e.tool", "e.ok", "e.output")


def last_selection(runs: DataFrame, trace: str = "tool_trace_json") -> DataFrame:
    """Last successful choice of each run."""
    chosen = trace_events(runs, trace).filter(F.col("tool").startswith("choose_") & F.col("output.success"))
    return chosen.groupBy("run_id").agg(F.max_by("output.record_id", "position").alias("record_id"))


def is_stale(updated_at: Column, now: Column, days: int = V.REFRESH_DAYS) -> Column:
    """Missing, unreadable or older than the refresh interval; a time without zone is UTC."""
    parsed = F.try_to_timestamp(F.replace(updated_at, F.lit("Z"), F.lit("+00:00")))
    return parsed.isNull() | (F.unix_micros(now) - F.unix_micros(parsed) > days * 86_400_000_000)


def should_resume(status: Column, error: Column) -> Column:
    return (F.lower(F.coalesce(status, F.lit("ready"))) != "ready") | (F.trim(F.coalesce(error, F.lit(""))) != "")
