"""Registered queries on streams, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans.catalog import registered
from tallyframe.streaming import jobs
from tallyframe.streaming.tables import shared_place, stream_of

STEPS = {"signup": "queue", "view": "start", "purchase": "finish", "click": "finish_with_issues", "error": "fail"}
LIMIT = 5 * 86_400
_OVER = f"epoch(ts - since) > {LIMIT}"


@registered(f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
edge AS (SELECT max(ts) - INTERVAL 1 DAY AS seen FROM e),
m(user_id, k, status, queued_at, since, n, told) AS (SELECT user_id, CAST(0 AS BIGINT), '', NULL::TIMESTAMP, NULL::TIMESTAMP, 0, CAST([] AS STRUCT(q TIMESTAMP, s VARCHAR, t TIMESTAMP, n INTEGER)[]) FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, k, CASE WHEN moved IS NULL THEN now WHEN moved IN ('queued', 'running') THEN moved ELSE '' END, CASE WHEN moved = 'queued' THEN ts ELSE queued_at END, CASE WHEN moved IS NOT NULL THEN ts ELSE since END, CASE WHEN moved = 'queued' THEN 1 WHEN moved IS NOT NULL THEN n + 1 ELSE n END,
    told || CASE WHEN late THEN [{{'q': queued_at, 's': 'interrupted', 't': since + INTERVAL {LIMIT} SECOND, 'n': n + 1}}] ELSE [] END || CASE WHEN moved IS NOT NULL THEN [{{'q': CASE WHEN moved = 'queued' THEN ts ELSE queued_at END, 's': moved, 't': ts, 'n': CASE WHEN moved = 'queued' THEN 1 ELSE n + 1 END}}] ELSE [] END
  FROM (SELECT *, CASE WHEN now = '' AND event_type = 'signup' THEN 'queued' WHEN now = 'queued' AND event_type = 'view' THEN 'running' WHEN now = 'running' THEN CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'completed_with_issues' WHEN 'error' THEN 'failed' END END AS moved
    FROM (SELECT m.user_id, e.k, e.ts, e.event_type, queued_at, since, n, told, m.status <> '' AND {_OVER} AS late, CASE WHEN m.status <> '' AND {_OVER} THEN '' ELSE m.status END AS now FROM m JOIN e ON e.user_id = m.user_id AND e.k = m.k + 1))),
last AS (SELECT user_id, max_by(status, k) AS status, max_by(queued_at, k) AS queued_at, max_by(since, k) AS since, max_by(n, k) AS n, max_by(told, k) AS told FROM m GROUP BY 1),
everything AS (SELECT user_id, unnest(told) AS j FROM last UNION ALL SELECT user_id, {{'q': queued_at, 's': 'interrupted', 't': since + INTERVAL {LIMIT} SECOND, 'n': n + 1}} FROM last, edge WHERE status <> '' AND since + INTERVAL {LIMIT} SECOND <= seen)
SELECT user_id AS owner, j.q AS queued_at, max_by(j.s, j.n) AS status, max_by(j.t, j.n) AS since, max(j.n) AS n FROM everything GROUP BY 1, 2""")
def job_states(spark, sf_dir):
    """The event table as a stream of job steps; a job without a step for five days is interrupted."""
    step = jobs.step_of(F.col("event_type"), STEPS)
    events = stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("owner"), F.col("ts").cast("timestamp").alias("ts"), "event_id", step.alias("step"))
    at = shared_place(spark, "jobs")
    jobs.run(events, f"{at}/table", f"{at}/checkpoint", LIMIT)
    return jobs.latest(spark, f"{at}/table")
