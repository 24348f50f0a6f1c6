"""Rate limiters over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import slices
from paperloom.plans.registry import query
from paperloom.sources.tables import load


def clocked(spark, folder):
    """Events with their time as seconds, without going through a time zone."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return load(spark, folder, "events").select("event_id", "user_id", "event_type", (micros / F.lit(1000000.0)).alias("t"))


@query(
    "rate_sliding_log",
    """WITH RECURSIVE seq AS (SELECT event_id, event_type AS k, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS admitted, []::DOUBLE[] AS log FROM (SELECT DISTINCT k FROM seq)
UNION ALL SELECT k, i, event_id, len(l) < 3, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END
  FROM (SELECT s.*, list_filter(w.log, lambda x: x > s.t - 3600) AS l FROM walk w JOIN seq s ON s.k = w.k AND s.i = w.i + 1))
SELECT event_id, admitted FROM walk WHERE i > 0""",
)
def rate_sliding_log(spark, folder):
    """Three requests an hour per event type: five hot keys share all rows."""
    flagged = slices.sliding_log(clocked(spark, folder), 3, 3600.0, key="event_type", order="event_id", clock="t", slice_width=86_400.0)
    return flagged.select("event_id", "admitted")


@query(
    "rate_fixed_window",
    """WITH RECURSIVE seq AS (SELECT event_id, user_id AS k, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS admitted, -1e18::DOUBLE AS opened, 0::BIGINT AS n FROM (SELECT DISTINCT k FROM seq)
UNION ALL SELECT s.k, s.i, s.event_id, s.t > w.opened + 86400 OR w.n < 2, CASE WHEN s.t > w.opened + 86400 THEN s.t ELSE w.opened END,
  CASE WHEN s.t > w.opened + 86400 THEN 1 WHEN w.n < 2 THEN w.n + 1 ELSE w.n END FROM walk w JOIN seq s ON s.k = w.k AND s.i = w.i + 1)
SELECT event_id, admitted FROM walk WHERE i > 0""",
)
def rate_fixed_window(spark, folder):
    """Two requests per day and user."""
    flagged = slices.fixed_window(clocked(spark, folder), 2, 86_400.0, key="user_id", order="event_id", clock="t", slice_width=7 * 86_400.0)
    return flagged.select("event_id", "admitted")


@query(
    "rate_window_counts",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent
FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)""",
)
def rate_window_counts(spark, folder):
    return slices.window_counts(clocked(spark, folder), key="user_id", clock="t", window=86_400).select("event_id", "recent")
