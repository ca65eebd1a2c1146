"""Queries over work items and their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.operators import jobs as J
from tessaly.operators import library as L
from tessaly.plans.registry import query
from tessaly.plans.views import any_sql, view, view_sql
from tessaly.session import table

EVENTS = f"WITH {view_sql('job_events')}"
LATEST = f"""{EVENTS}, latest AS (SELECT job_id, arg_max(status, ts) AS status, max(ts) AS updated_at, min(ts) AS created_at, count(*) FILTER (status = 'retry_wait') AS attempts,
      max(ts) FILTER (status = 'running') AS heartbeat_at, arg_max(document_id, ts) AS document_id, max(CAST(cancel_requested AS INT)) AS cancel_requested FROM job_events GROUP BY job_id)"""
DELAY = "least(300, CAST(5 * power(2, least(greatest({0} - 1, 0), 6)) AS BIGINT))"
ACTIVE = "status IN ('queued', 'running', 'retry_wait', 'cancelling')"


def iso(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"


# Several items per document and per user make the per-document rules bite.
MANY = f"""WITH {view_sql('job_events').replace('user_id AS "job_id"', 'event_id - event_id % 7 AS "job_id"')}"""
MANY_LATEST = LATEST.replace(EVENTS, MANY)


def many(spark, sf_dir):
    return view(spark, sf_dir, "job_events").withColumn("job_id", F.col("event_id") - F.col("event_id") % 7)


@query("w9_latest_status", f"{LATEST} SELECT job_id, status, {iso('updated_at')} AS updated_at, {iso('created_at')} AS created_at, attempts, {iso('heartbeat_at')} AS heartbeat_at FROM latest")
def latest(spark, sf_dir):
    return J.latest_status(view(spark, sf_dir, "job_events")).select("job_id", "status", "updated_at", "created_at", "attempts", "heartbeat_at")


NOW = "2024-01-20 12:00:00"


def with_retry(rows):
    retry = J.next_retry(F.col("updated_at"), F.col("status"), F.col("attempts"))
    return rows.withColumn("next_retry_at", F.when(F.col("job_id") % 3 > 0, retry))


RETRY = f"retried AS (SELECT *, CASE WHEN status = 'retry_wait' AND job_id % 3 > 0 THEN updated_at + to_seconds({DELAY.format('attempts')}) END AS next_retry_at FROM latest)"


@query("f8_due_items", f"""{MANY_LATEST}, {RETRY} SELECT job_id, status, {iso('created_at')} AS created_at, {iso('next_retry_at')} AS next_retry_at FROM retried
    WHERE cancel_requested = 0 AND (status = 'queued' OR (status = 'retry_wait' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}')))
    ORDER BY retried.created_at, job_id LIMIT 200""")
def due(spark, sf_dir):
    rows = with_retry(J.latest_status(many(spark, sf_dir)))
    return J.due_items(rows, F.lit(NOW).cast("timestamp_ntz"), 200).select("job_id", "status", "created_at", "next_retry_at")


@query("f11_active_items", f"{MANY_LATEST} SELECT document_id, job_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) AS position FROM latest WHERE {ACTIVE}")
def active(spark, sf_dir):
    from tessaly.operators.segmented import ranked

    rows = J.latest_status(many(spark, sf_dir)).filter(J.is_active(F.col("status"))).withColumn("day", F.to_date("created_at"))
    order = [F.col("created_at").desc(), F.col("job_id").desc()]
    return ranked(rows, ["document_id"], "day", order, "position", True).select("document_id", "job_id", "position")


@query("w10_one_active_per_document", f"""{MANY_LATEST} SELECT document_id, job_id, f.active_job_id FROM latest JOIN (SELECT document_id, arg_min(job_id, (created_at, job_id)) AS active_job_id FROM latest WHERE {ACTIVE} GROUP BY document_id) f USING (document_id)""")
def one_active(spark, sf_dir):
    return J.one_active_per_document(J.latest_status(many(spark, sf_dir)))


@query("j2_attach_active_job", f"""{MANY_LATEST}, oldest AS (SELECT document_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, job_id) AS n FROM latest WHERE {ACTIVE}) WHERE n = 1)
    SELECT doc_id AS id, job_id, status AS job_status FROM documents LEFT JOIN oldest ON document_id = doc_id""")
def with_job(spark, sf_dir):
    running = J.latest_status(many(spark, sf_dir)).filter(J.is_active(F.col("status")))
    return L.attach_active_job(view(spark, sf_dir, "docs").select("id"), running)


@query("w11_document_status", f"""{MANY_LATEST}, {view_sql('library')}, newest AS (SELECT document_id, arg_max(status, (updated_at, job_id)) AS job_status FROM latest GROUP BY document_id),
    held AS (SELECT id, status, job_status, id % 4 = 1 AS blank FROM library LEFT JOIN newest ON document_id = id)
    SELECT id, job_status, CASE job_status WHEN 'queued' THEN CASE WHEN blank THEN 'processing' ELSE status END WHEN 'cancelling' THEN CASE WHEN blank THEN 'error' ELSE 'ready' END
      WHEN 'retry_wait' THEN CASE WHEN blank THEN 'processing' ELSE 'ready' END ELSE status END AS status FROM held""")
def doc_status(spark, sf_dir):
    docs = view(spark, sf_dir, "library").select("id", "status", F.when(F.col("id") % 4 != 1, F.col("body")).alias("body"))
    return J.document_status(docs, J.latest_status(many(spark, sf_dir)))


UPDATED = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not a time' ELSE CAST(ts AS STRING) END"


@query("f9_stale_catalogue", f"""SELECT event_id, CAST(TRY_CAST(u AS TIMESTAMP) IS NULL OR TIMESTAMP '{NOW}' - TRY_CAST(u AS TIMESTAMP) > INTERVAL 7 DAY AS BIGINT) AS stale
    FROM (SELECT event_id, {UPDATED} AS u FROM events)""")
def stale(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{UPDATED} AS u")
    return rows.select("event_id", J.is_stale(F.col("u"), F.lit(NOW).cast("timestamp")).alias("stale"))


ERRORS = "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'last retry failed' END"


@query("f10_resume_flag", f"{EVENTS} SELECT event_id, CAST(lower(CASE WHEN status = 'completed' THEN 'Ready' ELSE status END) <> 'ready' OR trim(coalesce({ERRORS}, '')) <> '' AS BIGINT) AS resume FROM job_events")
def resume(spark, sf_dir):
    status = F.when(F.col("status") == "completed", "Ready").otherwise(F.col("status"))
    return view(spark, sf_dir, "job_events").select("event_id", J.should_resume(status, F.expr(ERRORS)).alias("resume"))


@query("c12_retry_delay", f"SELECT event_id, {DELAY.format('event_id % 12')} AS long_delay, least(30, CAST(power(2, least(event_id % 12, 10)) AS BIGINT)) AS short_delay FROM events")
def delays(spark, sf_dir):
    n = F.col("event_id") % 12
    return table(spark, sf_dir, "events").select("event_id", J.retry_delay(n).alias("long_delay"), J.short_delay(n).alias("short_delay"))


MESSAGE = "concat('Got ', CASE event_id % 6 WHEN 0 THEN 'TimeOut' WHEN 1 THEN 'HTTP 503 from host' WHEN 2 THEN '拒绝访问' WHEN 3 THEN 'Connection  reset' WHEN 4 THEN 'connection reset' ELSE event_type END)"


@query("c13_is_retryable", f"SELECT event_id, CAST({any_sql(f'lower({MESSAGE})', V.RETRYABLE_MARKERS)} AS BIGINT) AS retryable FROM events")
def retryable(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.is_retryable(F.expr(MESSAGE)).alias("retryable"))


@query("c16_label", f"{EVENTS} SELECT event_id, CASE status WHEN 'completed' THEN '可学习' WHEN 'queued' THEN '处理中' WHEN 'retry_wait' THEN '处理失败' ELSE '可学习' END AS label FROM job_events")
def labels(spark, sf_dir):
    names = F.create_map(*[F.lit(v) for v in ("completed", "可学习", "queued", "处理中", "retry_wait", "处理失败")])
    return view(spark, sf_dir, "job_events").select("event_id", F.coalesce(F.try_element_at(names, F.col("status")), F.lit("可学习")).alias("label"))


# When items are looked at: after the last event.
CLOCK = "2024-02-01 00:00:00"


@query("x1_stale_heartbeats", f"""{EVENTS}, followed AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next_ts FROM job_events)
    SELECT job_id, event_id, CASE WHEN cancel_requested THEN 'cancelled' ELSE 'queued' END AS status, (epoch_us(coalesce(next_ts, TIMESTAMP '{CLOCK}')) - epoch_us(ts)) / 1000000 AS silent_seconds FROM followed
    WHERE status IN ('running', 'cancelling') AND epoch_us(coalesce(next_ts, TIMESTAMP '{CLOCK}')) - epoch_us(ts) > 75000000""")
def stale_jobs(spark, sf_dir):
    return J.stale_gaps(view(spark, sf_dir, "job_events"), F.lit(CLOCK).cast("timestamp"))


GAP = 6 * 3600


@query("x5_heartbeat_sessions", f"""{EVENTS}, lagged AS (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS p FROM job_events),
    numbered AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM lagged)
    SELECT job_id, CAST(n AS BIGINT) AS session_no, {iso('min(ts)')} AS started_at, {iso('max(ts)')} AS last_at, count(*) AS events FROM numbered GROUP BY job_id, n""")
def sessions(spark, sf_dir):
    return J.activity_sessions(view(spark, sf_dir, "job_events"), GAP)


@query("x6_weekly_refresh_windows", "SELECT event_type, strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY ALL")
def weekly(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("event_type", F.window("ts", "7 days")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("window.start").alias("window_start"), "n")


@query("x3_status_by_job", f"{LATEST} SELECT job_id, status, attempts, CASE WHEN status = 'retry_wait' THEN {iso(f'''updated_at + to_seconds({DELAY.format('attempts')})''')} END AS next_retry_at FROM latest")
def status_by_job(spark, sf_dir):
    rows = J.latest_status(view(spark, sf_dir, "job_events"))
    return rows.select("job_id", "status", "attempts", J.next_retry(F.col("updated_at"), F.col("status"), F.col("attempts")).alias("next_retry_at"))


TRACE = ("concat('[{\"tool\": \"search\", \"ok\": ', CASE WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END, '}, {\"tool\": \"choose_', event_type, '\", \"ok\": true, \"output\": {\"success\": ', "
         "CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, ', \"record_id\": \"r', CAST(event_id % 90 AS STRING), '\"}}]')")


@query("a10_tool_success", f"""WITH runs AS (SELECT event_id AS run_id, {TRACE} AS t FROM events), e AS (SELECT run_id, unnest(CAST(json_extract(t, '$[*]') AS JSON[])) AS j FROM runs)
    SELECT json_extract_string(j, '$.tool') AS tool, count(*) AS calls, count(*) FILTER (json_extract_string(j, '$.ok') = 'false') AS failures FROM e GROUP BY 1""")
def tools(spark, sf_dir):
    return J.tool_success(table(spark, sf_dir, "events").selectExpr("event_id AS run_id", f"{TRACE} AS tool_trace_json"))


@query("a10_last_selection", f"""WITH runs AS (SELECT event_id AS run_id, {TRACE} AS t FROM events)
    SELECT run_id, json_extract_string(t, '$[1].output.record_id') AS record_id FROM runs WHERE json_extract_string(t, '$[1].output.success') = 'true'""")
def selections(spark, sf_dir):
    return J.last_selection(table(spark, sf_dir, "events").selectExpr("event_id AS run_id", f"{TRACE} AS tool_trace_json"))
