"""Streaming queries, each drained over the stored events, with the SQL of the batch result.

Windows and sessions are put out once the watermark (ten minutes behind the newest event) has passed them.
"""

from tidewright.streaming import live as L

QUERIES = {
    "io16_windowed_counts": L.streamed(L.windowed_counts, "append"),
    "io16_sessions": L.streamed(L.sessions, "append"),
    "io16_deduplicated": L.streamed(L.once, "append"),
    "io18_latest_state": L.streamed(L.latest_by_user),
}
PASSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
ORACLES = {
    "io16_windowed_counts": f"SELECT date_trunc('hour', ts) AS period, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {PASSED}",
    "io16_sessions": "WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e) "
    f"SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n FROM s GROUP BY user_id, run HAVING max(ts) + INTERVAL 30 MINUTE <= {PASSED}",
    "io16_deduplicated": "SELECT event_id, min(ts) AS ts FROM events GROUP BY 1",
    "io18_latest_state": "SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
