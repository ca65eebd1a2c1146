"""Streaming jobs over the given tables, run until what is available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.operators import memory as M
from tessaly.plans.jobs import CLOCK, DELAY, EVENTS, GAP, LATEST, iso
from tessaly.plans.memory import MEMORIES
from tessaly.plans.registry import query
from tessaly.plans.retrieval import chunks_sql
from tessaly.plans.views import VIEWS, view_sql
from tessaly.session import table
from tessaly.streaming import jobs as S


def stream(spark, sf_dir, name):
    return S.file_stream(spark, sf_dir, f"{name}.parquet", table(spark, sf_dir, name).schema)


def event_stream(spark, sf_dir):
    columns = VIEWS["job_events"][1]
    rows = stream(spark, sf_dir, "events").selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()], "event_type")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("x1_stale_heartbeats_stream", f"""{EVENTS}, followed AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next_ts FROM job_events)
    SELECT job_id, event_id, CASE WHEN cancel_requested THEN 'cancelled' ELSE 'queued' END AS status FROM followed
    WHERE status IN ('running', 'cancelling') AND epoch_us(coalesce(next_ts, TIMESTAMP '{CLOCK}')) - epoch_us(ts) > 75000000""")
def stale(spark, sf_dir):
    return S.stale_heartbeats(event_stream(spark, sf_dir), S.shared_folder(spark), F.lit(CLOCK).cast("timestamp"))


@query("x5_heartbeat_sessions_stream", f"""{EVENTS}, lagged AS (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS p FROM job_events),
    numbered AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM lagged)
    SELECT job_id, {iso('min(ts)')} AS started_at, {iso('max(ts)')} AS last_at, count(*) AS events FROM numbered GROUP BY job_id, n""")
def sessions(spark, sf_dir):
    return S.heartbeat_sessions(event_stream(spark, sf_dir), S.shared_folder(spark), GAP).drop("open")


@query("x6_weekly_refresh_stream", "SELECT event_type, strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY ALL")
def weekly(spark, sf_dir):
    return S.weekly_refresh_windows(event_stream(spark, sf_dir), S.shared_folder(spark)).drop("open")


@query("x3_status_stream", f"{LATEST} SELECT job_id, status, {iso('updated_at')} AS updated_at, attempts, CASE WHEN status = 'retry_wait' THEN {iso(f'''updated_at + to_seconds({DELAY.format('attempts')})''')} END AS next_retry_at FROM latest")
def status(spark, sf_dir):
    updates = S.run_batches(S.status_updates(event_stream(spark, sf_dir)), S.shared_folder(spark), lambda b: b, "update")
    return S.latest_updates(updates)


@query("x2_memory_upsert_stream", f"{MEMORIES} SELECT * FROM memories")
def upserts(spark, sf_dir):
    rows = stream(spark, sf_dir, "conversations").selectExpr(*[f"{e} AS `{n}`" for n, e in VIEWS["memory_events"][1].items()])
    return M.merge_folds(S.memory_upsert_stream(rows, S.shared_folder(spark)))


# Documents arrive in the order of a hash, not of their ids.
ARRIVES = "1700000000 + (doc_id * 7919) % 5000"


@query("x4_ingest_stream", f"""WITH {view_sql('docs')}, arrived AS (SELECT doc_id AS id, text AS body, {ARRIVES} AS arrived_at FROM documents),
    firsts AS (SELECT sha256(body) AS h, arg_min(id, (arrived_at, id)) AS id, any_value(body) AS body FROM arrived GROUP BY 1)
    SELECT f.id, h AS content_hash, chunk_index, content FROM {chunks_sql('firsts', 'h', 'body', V.INDEX_CHUNK, V.INDEX_OVERLAP)} JOIN firsts f USING (h)""")
def ingested(spark, sf_dir):
    docs = stream(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS body", f"timestamp_seconds({ARRIVES}) AS arrived_at")
    texts = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS body")
    return S.ingested_chunks(S.first_arrivals(docs, S.shared_folder(spark)), texts)
