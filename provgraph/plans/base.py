"""What the registered queries share: the edge table and, for SQL, the same as a common table expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: ``e``: enriched edges; ``p``: property maps; ``best``: one property per node; ``ends``: both ends of every edge.
EDGES = """
raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
), e AS (
  SELECT concat('u', user_id) AS actorID, 'SUBJECT_PROCESS' AS actor_type,
         CASE WHEN k < 25 THEN concat('u', k) ELSE concat('k', k) END AS objectID,
         CASE WHEN k < 25 THEN 'SUBJECT_PROCESS' WHEN k < 50 THEN 'FILE_OBJECT_BLOCK' WHEN k < 75 THEN 'NETFLOW_OBJECT' ELSE 'MemoryObject' END AS object,
         concat('EVENT_', upper(event_type)) AS action,
         CAST(epoch_us(ts) * 1000 AS VARCHAR) AS "timestamp", event_type AS exec,
         CASE WHEN k % 2 = 0 THEN concat('/k/', k) ELSE '' END AS path,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'benign' ELSE 'malicious' END AS category,
         event_id, epoch_us(ts) AS us
  FROM raw
), p AS (
  SELECT CASE object WHEN 'NETFLOW_OBJECT' THEN 'netflow' WHEN 'FILE_OBJECT_BLOCK' THEN 'file' ELSE 'subject' END AS kind, objectID AS node_id,
         CASE object WHEN 'NETFLOW_OBJECT' THEN concat('10.0.0.', n, ',80,1.1.1.', n, ',443') WHEN 'FILE_OBJECT_BLOCK' THEN concat('/data/', n) ELSE concat('cmd ', n, ',', n, ',null') END AS property
  FROM (SELECT DISTINCT objectID, object, CAST(substr(objectID, 2) AS INT) AS n FROM e) WHERE object <> 'MemoryObject' AND n % 3 <> 0
), ends AS (
  SELECT *, coalesce(p.property, x.fallback) AS prop FROM (
    SELECT actorID AS name, actor_type AS type, 0 AS side, us, event_id, category, concat_ws(' ', exec, action, nullif(path, '')) AS fallback FROM e
    UNION ALL SELECT objectID, object, 1, us, event_id, category, concat_ws(' ', exec, action, nullif(path, '')) FROM e
  ) x LEFT JOIN p ON p.node_id = x.name
)"""

LABELS = "labels_(label) AS (VALUES ('u13'), ('k50'), ('k66'), ('k99'))"


def over_edges(sql: str, *more: str) -> str:
    """SQL over the edge table; ``more`` are further common table expressions."""
    return "WITH RECURSIVE " + ", ".join([EDGES, *more]) + "\n" + sql
