"""Queries of windows, intake and retention in batch form with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.plans.prelude import with_tables
from lumenspan.sources import tables as T
from lumenspan.streaming import windows as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    """Register a query under ``name`` together with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add


def _flat(df, *keys):
    """Windows with their start as seconds since the epoch."""
    return df.select(*keys, F.unix_seconds("window.start").alias("start_s"), "n", F.round("total", 4).alias("total"))


def _events(s, d):
    return S.event_time(T.read(s, d, "events").select("event_id", "user_id", "event_type", "ts", "value"))


_S = "epoch(ts)::BIGINT"


@query("s01_tumbling", "SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start_s, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return _flat(S.tumbling(S.watermarked(_events(s, d)), "1 hour", ("event_type",)), "event_type")


@query("s02_hopping", "SELECT CAST((floor(epoch(ts) / 2880) - k) * 2880 AS BIGINT) AS start_s, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events, range(2) r(k) WHERE epoch(ts) < (floor(epoch(ts) / 2880) - k) * 2880 + 3600 GROUP BY 1")
def _(s, d):
    return _flat(S.hopping(_events(s, d), "60 minutes", "48 minutes"))


@query("s25_busy_windows", "SELECT user_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start_s, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2 HAVING COUNT(*) >= 5")
def _(s, d):
    return _flat(S.busy(S.tumbling(_events(s, d), "1 day", ("user_id",))), "user_id")


@query("s25_sessions", """WITH o AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts >= LAG(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM o)
  SELECT user_id, MIN(floor(epoch(ts)))::BIGINT AS start_s, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM g GROUP BY user_id, nth""")
def _(s, d):
    return _flat(S.sessions(_events(s, d), "6 hours"), "user_id")


@query("s37_intake_once", "SELECT DISTINCT event_id, platform FROM (SELECT event_id, platform FROM webhook_events UNION ALL SELECT event_id, platform FROM webhook_events WHERE retry_count > 0)")
def _(s, d):
    events = T.webhook_events(s, d).select("event_id", "platform", "retry_count")
    return S.once(events.unionByName(events.where("retry_count > 0"))).select("event_id", "platform")


@query("s12_retained", """WITH f AS (SELECT *, (SELECT MAX(t) FROM frames) - t > CASE WHEN is_keyframe THEN 360 ELSE 300 END AS old FROM frames), o AS (SELECT frame_id, COUNT(*) FILTER (NOT old) OVER (PARTITION BY stream_id ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS stays, COUNT(*) OVER (PARTITION BY stream_id) - ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY t, frame_id) AS remaining FROM f)
  SELECT frame_id FROM o WHERE stays > 0 OR remaining < 100""")
def _(s, d):
    frames = T.frames(s, d)
    return S.retained(frames, frames.agg(F.max("t")).scalar()).select("frame_id")


@query("s39_latest", "SELECT stream_id, arg_max(status, {'a': received_at, 'b': event_id}) AS status, MAX(received_at) AS received_at FROM webhook_events GROUP BY stream_id")
def _(s, d):
    return S.latest(T.webhook_events(s, d), "stream_id", "received_at", ["event_id", "status", "received_at"]).select("stream_id", "status", "received_at")


@query("s42_failure_runs", """WITH o AS (SELECT event_id, stream_id, status = 'failed' AS bad, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY received_at, event_id) AS i FROM webhook_events), g AS (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY stream_id, bad ORDER BY i) AS grp FROM o)
  SELECT stream_id, MAX(n) AS longest FROM (SELECT stream_id, grp, COUNT(*) AS n FROM g WHERE bad GROUP BY stream_id, grp) GROUP BY stream_id""")
def _(s, d):
    order = Window.partitionBy("stream_id").orderBy("received_at", "event_id")
    runs = T.webhook_events(s, d).withColumn("bad", F.col("status") == "failed").withColumn("run", F.count_if(~F.col("bad")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("bad").groupBy("stream_id", "run").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.max("n").alias("longest"))
