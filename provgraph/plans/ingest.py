"""Queries on reading logs and on edge-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from provgraph.functions import mask_events, ns_to_timestamp
from provgraph.operators import edges as ops
from provgraph.sources import cdm, dot, tables

from .base import LABELS, Query, over_edges

CDM_CTE = """
lines AS (
  SELECT *, event_id % 10 = 0 AS two, event_id % 7 = 0 AS bare FROM e
), cdm AS (
  SELECT actorID, objectID, action, "timestamp", CASE WHEN bare THEN '' ELSE exec END AS exec, CASE WHEN bare THEN '' ELSE path END AS path, event_id FROM lines
  UNION ALL SELECT actorID, 'second-' || objectID, action, "timestamp", CASE WHEN bare THEN '' ELSE exec END, '/second', event_id FROM lines WHERE two
)"""

DOT_CTE = """
dn AS (
  SELECT DISTINCT objectID AS node_id, CASE WHEN object = 'SUBJECT_PROCESS' THEN 'process' WHEN object = 'FILE_OBJECT_BLOCK' THEN 'file'
    ELSE ['web_object', 'domain_name', 'IP_Address', 'connection', 'session'][CAST(substr(objectID, 2) AS INT) % 5 + 1] END AS kind
  FROM e WHERE object <> 'MemoryObject'
), dt AS (
  SELECT node_id, CASE WHEN kind IN ('domain_name', 'IP_Address', 'connection', 'session') THEN 'NETFLOW_OBJECT' WHEN kind = 'web_object' THEN 'NetFlowObject'
    WHEN kind = 'process' THEN 'SUBJECT_PROCESS' ELSE 'FILE_OBJECT_BLOCK' END AS type FROM dn
)"""


def base_edges(s, d):
    return tables.event_edges(s, d).select("actorID", "actor_type", "objectID", "object", "action", "timestamp")


def edge_table(s, d):
    e = tables.event_edges(s, d)
    known = ops.best_property(tables.event_properties(s, d))
    fallback = F.concat_ws(" ", "exec", "action", F.nullif("path", F.lit("")))
    of = lambda end: known.toDF(end, f"{end}_known")
    return e.join(of("actorID"), "actorID", "left").join(of("objectID"), "objectID", "left").select("event_id", "actorID", "objectID", F.coalesce("actorID_known", fallback).alias("actor_property"), F.coalesce("objectID_known", fallback).alias("object_property"))


def tsv_edges(s, d):
    line = F.when(F.col("event_id") % 20 == 0, F.concat_ws("\t", "actorID", "actor_type")).otherwise(F.concat_ws("\t", *ops_columns()))
    return cdm.parse_base_edges(tables.event_edges(s, d).select(line.alias("value")))


def ops_columns():
    return ["actorID", "actor_type", "objectID", "object", "action", "timestamp"]


def labels_clean(s, d):
    lines = tables.event_edges(s, d).select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), F.col("objectID"), F.lit(" "))).when(F.col("event_id") % 3 == 1, F.col("objectID")).otherwise("  ").alias("value"))
    return cdm.clean_labels(lines)


def cdm_join_edges(s, d):
    return ops.join_base_with_events(base_edges(s, d), cdm.extract_events(tables.cdm_lines(s, d)))


def line_cap(s, d):
    lines = tables.cdm_lines(s, d).where("line >= 0 and file <> 'nodes.json'")
    return cdm.first_lines(lines, 600).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last_line"))


def dot_edges(s, d):
    statements = tables.dot_statements(s, d)
    return dot.typed_edges(dot.extract_edges(statements), dot.extract_nodes(statements))


def dot_properties(s, d):
    e = tables.event_edges(s, d)
    known = ops.best_property(tables.event_properties(s, d)).withColumnRenamed("node_id", "name")
    return e.select(F.explode(F.array("actorID", "objectID")).alias("name")).distinct().join(known, "name", "left").select("name", F.coalesce("known", "name").alias("property"))


def first_wins_props(s, d):
    props = tables.event_properties(s, d)
    later = props.select("kind", "node_id", F.concat(F.lit("later "), "property").alias("property"), F.lit(1).alias("load_order"))
    alone = props.select("kind", F.concat(F.lit("new-"), "node_id").alias("node_id"), "property", F.lit(1).alias("load_order"))
    return ops.first_wins(props.unionByName(later).unionByName(alone))


def mask_event_tokens(s, d):
    text = F.concat_ws(" ", "exec", "action", F.concat(F.lit("x"), F.col("action")), "path")
    return tables.event_edges(s, d).select("event_id", mask_events(text).alias("masked"))


def time_split(s, d):
    e = tables.event_edges(s, d)
    marked = e.where(F.col("objectID").isin("k50", "k66", "k99") & (F.col("event_id") % 5 == 0))
    return ops.time_split(e, marked).groupBy("category", "split").agg(F.count(F.lit(1)).alias("n"))


def scene_category_filter(s, d):
    e = tables.event_edges(s, d).withColumn("scene", F.lit("events"))
    return e.where(F.col("scene").isin("events")).groupBy("scene", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actorID", "objectID").alias("pairs"))


def all_scenes_distinct(s, d):
    e = tables.event_edges(s, d)
    part = lambda c: e.where(F.col("category") == c).select("actorID", "objectID", "action", "exec", "path")
    return part("benign").unionByName(part("malicious")).distinct()


def ns_timestamp(s, d):
    text = F.when(F.col("event_id") % 11 == 0, "no time").otherwise(F.col("timestamp"))
    return tables.event_edges(s, d).select("event_id", F.unix_micros(ns_to_timestamp(text)).alias("us"))


def drop_labelled_edges(s, d):
    return ops.drop_touching(tables.event_edges(s, d), tables.event_labels(s), ["actorID", "objectID", "actor_type", "object", "action"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def label_anti_join(s, d):
    return ops.drop_touching(tables.event_edges(s, d), tables.event_labels(s), ["actorID", "objectID"]).select("event_id", "actorID", "objectID")


def node_names(s, d):
    return tables.event_edges(s, d).select(F.explode(F.array("actorID", "objectID")).alias("name")).distinct()


def labels_exact(s, d):
    return ops.exact_labels(node_names(s, d), tables.event_labels(s)).select("name", "label")


def labels_substring(s, d):
    return ops.substring_labels(node_names(s, d), list(tables.LABELS)).select("name", "label")


def label_theta_join(s, d):
    labels = tables.event_labels(s).select("label")
    return node_names(s, d).join(F.broadcast(labels), F.col("name").contains(F.col("label"))).select("name", "label")


MARKED = "m AS (SELECT us FROM e WHERE objectID IN ('k50', 'k66', 'k99') AND event_id % 5 = 0)"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "edge_table": (edge_table, over_edges("""SELECT event_id, actorID, objectID, coalesce(a.property, f) AS actor_property, coalesce(o.property, f) AS object_property
        FROM (SELECT *, concat_ws(' ', exec, action, nullif(path, '')) AS f FROM e) x LEFT JOIN p a ON a.node_id = actorID LEFT JOIN p o ON o.node_id = objectID""")),
    "cdm_nodes": (lambda s, d: cdm.extract_nodes(tables.cdm_lines(s, d)), over_edges("SELECT kind, node_id, property FROM p")),
    "cdm_events": (lambda s, d: cdm.extract_events(tables.cdm_lines(s, d)), over_edges('SELECT actorID, objectID, action, "timestamp", exec, path FROM cdm', CDM_CTE)),
    "cdm_join_edges": (cdm_join_edges, over_edges('SELECT DISTINCT e.actorID, e.actor_type, e.objectID, e.object, e.action, e."timestamp", cdm.exec, cdm.path FROM e JOIN cdm USING (actorID, objectID, action, "timestamp")', CDM_CTE)),
    "line_cap": (line_cap, over_edges("""SELECT file, count(*) AS n, max(line) AS last_line FROM (
        SELECT concat('events-', event_id % 4, '.json') AS file, event_id // 4 AS line, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id // 4) AS place FROM e) WHERE place <= 600 GROUP BY file""")),
    "dot_nodes": (lambda s, d: dot.extract_nodes(tables.dot_statements(s, d)), over_edges("SELECT node_id, kind FROM dn", DOT_CTE)),
    "dot_edges": (dot_edges, over_edges("""SELECT actorID, coalesce(a.type, 'PRINCIPAL_LOCAL') AS actor_type, objectID, coalesce(o.type, 'PRINCIPAL_LOCAL') AS object, exec AS action, event_id AS "timestamp"
        FROM e LEFT JOIN dt a ON a.node_id = actorID LEFT JOIN dt o ON o.node_id = objectID""", DOT_CTE)),
    "dot_properties": (dot_properties, over_edges("SELECT DISTINCT name, coalesce(property, name) AS property FROM ends")),
    "labels_clean": (labels_clean, over_edges("SELECT DISTINCT objectID AS label FROM e WHERE event_id % 3 < 2")),
    "tsv_edges": (tsv_edges, over_edges('SELECT actorID, actor_type, objectID, object, action, "timestamp" FROM e WHERE event_id % 20 <> 0')),
    "labels_exact": (labels_exact, over_edges("SELECT DISTINCT name, CASE WHEN name IN (SELECT label FROM labels_) THEN 1 ELSE 0 END AS label FROM ends", LABELS)),
    "labels_substring": (labels_substring, over_edges("SELECT DISTINCT name, CASE WHEN EXISTS (SELECT 1 FROM labels_ l WHERE contains(name, l.label)) THEN 1 ELSE 0 END AS label FROM ends", LABELS)),
    "label_theta_join": (label_theta_join, over_edges("SELECT DISTINCT name, label FROM ends JOIN labels_ ON contains(name, label)", LABELS)),
    "drop_labelled_edges": (drop_labelled_edges, over_edges("SELECT category, count(*) AS n FROM e WHERE actorID NOT IN (SELECT label FROM labels_) AND objectID NOT IN (SELECT label FROM labels_) GROUP BY category", LABELS)),
    "label_anti_join": (label_anti_join, over_edges("SELECT event_id, actorID, objectID FROM e WHERE actorID NOT IN (SELECT label FROM labels_) AND objectID NOT IN (SELECT label FROM labels_)", LABELS)),
    "first_wins_props": (first_wins_props, over_edges("SELECT kind, node_id, property FROM p UNION ALL SELECT kind, 'new-' || node_id, property FROM p")),
    "mask_event_tokens": (mask_event_tokens, over_edges("SELECT event_id, concat_ws(' ', exec, 'EVENT_MASKED', 'x' || action, path) AS masked FROM e")),
    "time_split": (time_split, over_edges("""SELECT category, split, count(*) AS n FROM (
        SELECT category, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.us BETWEEN e.us - 600000000 AND e.us + 600000000) THEN 'malicious'
          WHEN EXISTS (SELECT 1 FROM m WHERE m.us BETWEEN e.us - 1200000000 AND e.us + 1200000000) THEN 'test' ELSE 'train' END AS split FROM e) GROUP BY ALL""", MARKED)),
    "scene_category_filter": (scene_category_filter, over_edges("SELECT 'events' AS scene, category, count(*) AS n, count(DISTINCT (actorID, objectID)) AS pairs FROM e GROUP BY category")),
    "all_scenes_distinct": (all_scenes_distinct, over_edges("SELECT DISTINCT actorID, objectID, action, exec, path FROM e")),
    "ns_timestamp": (ns_timestamp, over_edges("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE us END AS us FROM e")),
}
