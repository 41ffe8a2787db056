"""The domain tables as DuckDB common table expressions, for the SQL of the queries."""

from __future__ import annotations

import re

from lumenspan.sources.tables import PHRASES

_T = "(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6::DOUBLE)"

TABLES = {
    "ev": "SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events",
    "users": "SELECT c_custkey AS id, c_name AS company_name, lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_acctbal >= 0 AS is_active FROM customer",
    "memberships": "SELECT c_nationkey::BIGINT AS organization_id, c_custkey AS user_id FROM customer",
    "organizations": """SELECT n_nationkey::BIGINT AS id, n_name AS name, owner_id, ['starter', 'professional', 'enterprise', 'custom'][n_nationkey % 4 + 1] AS plan_type, n_nationkey % 7 <> 0 AS is_active,
      CASE WHEN n_nationkey % 5 <> 0 THEN TIMESTAMP '1998-01-01' + to_days(n_nationkey * 20) END AS subscription_ends_at
      FROM nation LEFT JOIN (SELECT organization_id, MIN(user_id) AS owner_id FROM memberships GROUP BY 1) o ON o.organization_id = n_nationkey""",
    "streams": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
      ['twitch', 'youtube', 'rtmp', 'custom'][o_orderkey % 4 + 1] AS platform, o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS started_at, o_totalprice / 10 AS duration, o_orderpriority AS title,
      CASE WHEN o_orderstatus = 'F' THEN shipped END AS completed_at FROM orders LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS shipped FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey""",
    "highlights": f"""SELECT event_id AS id, user_id AS stream_id, {_T} / 600 AS start_time, {_T} / 600 + 10 + event_id % 90 AS end_time, 0.5::DOUBLE + k / 200 AS confidence_score, event_type AS highlight_type, LEAST(value / 200, 1.0::DOUBLE) AS viewer_engagement,
      k / 50 - 1 AS sentiment_score, ts AS created_at, [event_type, 'k' || (k % 5)] AS tags, event_type AS title, props AS description FROM ev""",
    "usage_records": """SELECT event_id AS id, user_id, user_id % 25 AS organization_id, CASE event_type WHEN 'view' THEN 'stream_processing' WHEN 'click' THEN 'api_call' WHEN 'purchase' THEN 'batch_processing' WHEN 'signup' THEN 'webhook_delivery' ELSE 'storage' END AS usage_type,
      user_id % 20 AS resource_id, ['stream', 'batch'][event_id % 2 + 1] AS resource_type, value AS quantity, ['minutes', 'calls'][k % 2 + 1] AS unit, ts AS period_start, CASE WHEN event_id % 20 <> 0 THEN ts END AS period_end,
      event_type <> 'error' AS billable, (k % 4 + 1) * 0.01::DOUBLE AS rate, value * ((k % 4 + 1) * 0.01::DOUBLE) AS total_cost, event_id % 50 AS api_key_id FROM ev""",
    "webhooks": """SELECT s_suppkey AS id, s_nationkey::BIGINT AS user_id, 'https://hooks.example.com/' || s_name AS url, COALESCE(events, []) AS events, COALESCE(total_deliveries, 0) AS total_deliveries, COALESCE(successful_deliveries, 0) AS successful_deliveries,
      s_suppkey % 12 AS consecutive_failures, ['active', 'inactive', 'failed'][s_suppkey % 3 + 1] AS status
      FROM supplier LEFT JOIN (SELECT l_suppkey, COUNT(*) AS total_deliveries, COUNT(*) FILTER (l_returnflag = 'N') AS successful_deliveries, list_sort(list(DISTINCT l_linestatus)) AS events FROM lineitem GROUP BY 1) d ON l_suppkey = s_suppkey""",
    "webhook_events": """SELECT event_id, ['twitch', 'youtube', 'custom'][event_id % 3 + 1] AS platform, event_type, ts AS received_at, ['received', 'processing', 'processed', 'failed', 'duplicate'][k % 5 + 1] AS status, event_id % 6 AS retry_count, user_id AS stream_id FROM ev""",
    "batches": """SELECT o_orderkey AS id, o_custkey AS user_id, ['pending', 'processing', 'completed', 'partially_failed', 'failed', 'cancelled'][o_orderkey % 6 + 1] AS status, o_orderdate AS created_at, COALESCE(total_items, 0) AS total_items, COALESCE(successful_items, 0) AS successful_items, COALESCE(failed_items, 0) AS failed_items,
      CASE WHEN o_orderkey % 6 IN (2, 3) THEN shipped END AS completed_at
      FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS total_items, COUNT(*) FILTER (l_returnflag = 'N') AS successful_items, COUNT(*) FILTER (l_returnflag = 'R') AS failed_items, MAX(l_shipdate) AS shipped FROM lineitem GROUP BY 1) i ON l_orderkey = o_orderkey""",
    "batch_items": "SELECT l_orderkey AS batch_id, l_partkey AS item_id, l_linenumber AS line, CASE l_returnflag WHEN 'N' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status FROM lineitem",
    "api_keys": """SELECT c_custkey AS id, c_custkey % 150 AS user_id, md5(c_name) AS key_hash, c_custkey % 9 <> 0 AS is_active, CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INTEGER) END AS expires_at,
      list_filter(['streams:read', CASE WHEN c_custkey % 2 = 0 THEN 'streams:write' END, CASE WHEN c_custkey % 3 = 0 THEN 'webhooks:read' END, CASE WHEN c_custkey % 10 = 0 THEN 'admin' END], lambda x: x IS NOT NULL) AS scopes FROM customer""",
    "chat_texts": """SELECT ROW_NUMBER() OVER (ORDER BY kind, a NULLS FIRST, b NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS nth, text FROM (SELECT 0 AS kind, conv_id AS a, turn AS b, role, text FROM conversations UNION ALL SELECT 1, doc_id, 0, '', text FROM documents)""",
    "chat_events": "SELECT ROW_NUMBER() OVER (ORDER BY event_id NULLS FIRST, ts NULLS FIRST) AS nth, * FROM ev",
    "chat_messages": f"""SELECT i AS event_id, user_id % 10 AS stream_id, user_id, CASE WHEN user_id % 50 = 0 THEN 'bot' ELSE 'user' END || user_id AS username, ts, {_T} AS t,
      COALESCE(text, '') || CASE WHEN i % 4 = 0 THEN ' ' || [{', '.join(f"'{p}'" for p in PHRASES)}][(i + k) % {len(PHRASES)} + 1] ELSE '' END AS message
      FROM (SELECT e, t, UNNEST(range(GREATEST(e, t))) AS i FROM (SELECT (SELECT COUNT(*) FROM chat_events) AS e, (SELECT COUNT(*) FROM chat_texts) AS t)) n
      JOIN chat_events c ON c.nth = i % GREATEST(e, 1) + 1 LEFT JOIN chat_texts x ON x.nth = i % GREATEST(t, 1) + 1""",
    "detections": f"""SELECT event_id AS seq, user_id % 20 AS stream_id, CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'audio' ELSE 'chat' END AS modality, {_T} / 600 AS t, LEAST(value / 100, 1.0::DOUBLE) AS score, 0.5::DOUBLE + k / 200 AS confidence
      FROM ev WHERE event_type IN ('view', 'click', 'purchase')""",
    "stream_urls": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderkey % 4 WHEN 0 THEN 'https://www.twitch.tv/User_' || o_custkey WHEN 1 THEN 'https://www.youtube.com/watch?v=' || lpad(o_orderkey::VARCHAR, 11, 'x')
      WHEN 2 THEN 'rtmp://live.example.com/app/' || o_orderkey ELSE 'https://cdn.example.com/live/' || o_orderkey || '.m3u8' END AS url FROM orders""",
    "qualities": "SELECT p_partkey AS id, p_partkey % 25 AS manifest_id, [180, 240, 360, 480, 720, 1080, 1440, 2160][p_size % 8 + 1] AS height, CAST(floor(p_retailprice * 1000) AS BIGINT) AS bandwidth FROM part",
    "frames": f"SELECT event_id AS frame_id, user_id % 20 AS stream_id, ts, {_T} / 600 AS t, event_id % 30 = 0 AS is_keyframe, LEAST(value / 100, 1.0::DOUBLE) AS quality, (k * 1000)::BIGINT AS size_bytes FROM ev",
}


def with_tables(sql: str, recursive: bool = False) -> str:
    """``sql`` behind the definitions of the domain tables that it names, and those that they name."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(TABLES[name])

    need(sql)
    body = sql.strip()
    heads = [f"{n} AS ({q})" for n, q in TABLES.items() if n in needed]
    if body[:5].upper() == "WITH ":
        body = body[5:].lstrip()
        if body[:10].upper() == "RECURSIVE ":
            body, recursive = body[10:], True
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*heads, body])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads) + "\n" if heads else "") + body
