"""Queries on property graphs and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from provgraph.cluster import checkpointed
from provgraph.operators import graph, report, snapshots
from provgraph.sources import tables

from .base import LABELS, Query, over_edges

DAY = 86_400_000_000
SNAP = "low AS (SELECT min(us) AS low FROM e), snap AS (SELECT e.*, (us - low) // 300000000 AS snapshot_id FROM e, low)"
PAIRS = "pairs AS (SELECT actorID AS src, objectID AS dst, string_agg(DISTINCT action, '|' ORDER BY action) AS actions FROM e GROUP BY ALL)"
DAYS = f"days AS (SELECT ends.*, us // {DAY} AS day FROM ends)"


def daily(s, d):
    return tables.event_edges(s, d).withColumn("day", F.floor(F.col("us") / DAY))


def joined(df, *arrays):
    for a in arrays:
        df = df.withColumn(a, F.array_join(a, "|"))
    return df


def time_snapshots(s, d):
    snaps = snapshots.time_snapshots(tables.event_edges(s, d))
    return snaps.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("actorID", "objectID").alias("n_edges"), F.min("us").alias("first_us"))


def vertex_table(s, d):
    v = graph.vertices(daily(s, d), tables.event_properties(s, d), tables.event_labels(s), ["day"])
    return joined(v, "properties")


def edge_index(s, d):
    return graph.edge_index(daily(s, d).select("day", F.col("actorID").alias("src"), F.col("objectID").alias("dst")).distinct(), ["day"]).withColumn("src_idx", F.col("src_idx").cast("long")).withColumn("dst_idx", F.col("dst_idx").cast("long"))


def induced_subgraph(s, d):
    pairs = graph.edge_actions(tables.event_edges(s, d)).select("src", "dst")
    members = pairs.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("community", F.substring("name", 2, 9).cast("int") % 7)
    return graph.induced_subgraphs(pairs, members).select("community", "src", "dst")


def lru_evict(s, d):
    return snapshots.least_recent(daily(s, d), ["day"], 0.3)


def snapshot_sequence(s, d):
    return snapshots.snapshot_sequence(snapshots.time_snapshots(tables.event_edges(s, d), keys=["category"]))


def count_snapshots(s, d):
    return snapshots.count_snapshots(tables.event_edges(s, d), 20).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("seen").alias("seen"), F.min("event_id").alias("first_event"))


def node_budget(s, d):
    found = snapshots.node_budget_snapshots(tables.event_edges(s, d).withColumn("scene", F.col("category")), 100, 0.3)
    return found.select("scene", "snapshot_id", F.size("nodes").cast("long").alias("n_nodes"), "n_edges", F.aggregate("frequencies", F.lit(0).cast("long"), lambda a, x: a + x).alias("frequency"), "until_us")


def triples(s, d):
    e = tables.event_edges(s, d)
    return graph.triples(graph.edge_actions(e), graph.node_properties(e, tables.event_properties(s, d)))


def triple_text_join(s, d):
    """Triples and distinct tails of each head and relation. Texts are compared by digest, and only a head's text comes back, once for each of its rows."""
    e = tables.event_edges(s, d)
    nodes = graph.node_properties(e, tables.event_properties(s, d)).select("name", F.array_join("properties", " ").alias("text"))
    nodes = checkpointed(nodes.withColumn("digest", F.sha2("text", 256)))
    found = graph.triples(graph.edge_actions(e), nodes.select("name", F.array("digest").alias("properties")))
    counted = found.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("tails"))
    texts = nodes.groupBy(F.col("digest").alias("h")).agg(F.min("name").alias("name")).join(nodes.select("name", "text"), "name").select("h", "text")
    return counted.join(texts, "h").select(F.col("text").alias("h"), "r", "n", "tails")


def snapshot_summary(s, d):
    """Vertices, edges, labelled vertices and the share of processes of every five-minute snapshot."""
    snaps = snapshots.time_snapshots(tables.event_edges(s, d))
    v = graph.vertices(snaps, tables.event_properties(s, d), tables.event_labels(s), ["snapshot_id"])
    return report.snapshot_summary(v, graph.edge_actions(snaps, ["snapshot_id"]), ["snapshot_id"])


TRIPLES = """props AS (SELECT name, string_agg(DISTINCT prop, ' ' ORDER BY prop) AS text FROM ends GROUP BY name),
acts AS (SELECT DISTINCT actorID AS src, objectID AS dst, action FROM e),
tri AS (SELECT a.text AS h, action AS r, b.text AS t FROM acts JOIN props a ON a.name = src JOIN props b ON b.name = dst)"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "node_frequency": (lambda s, d: graph.node_frequency(tables.event_edges(s, d)), over_edges("SELECT name, count(*) AS frequency FROM ends GROUP BY name")),
    "node_properties": (lambda s, d: joined(graph.node_properties(tables.event_edges(s, d), tables.event_properties(s, d)), "properties"), over_edges("SELECT name, string_agg(DISTINCT prop, '|' ORDER BY prop) AS properties FROM ends GROUP BY name")),
    "edge_actions": (lambda s, d: joined(graph.edge_actions(tables.event_edges(s, d)), "actions"), over_edges("SELECT src, dst, actions, split_part(actions, '|', 1) AS type FROM pairs", PAIRS)),
    "node_type_first_seen": (lambda s, d: graph.node_types(tables.event_edges(s, d)), over_edges("SELECT DISTINCT ON (name) name, type FROM ends ORDER BY name, us, event_id, side")),
    "edge_first_action": (lambda s, d: graph.first_action(tables.event_edges(s, d)), over_edges("SELECT DISTINCT ON (actorID, objectID) actorID AS src, objectID AS dst, action AS type, us FROM e ORDER BY actorID, objectID, us, event_id")),
    "edge_per_action": (lambda s, d: graph.edge_per_action(tables.event_edges(s, d)), over_edges("SELECT DISTINCT actorID AS src, objectID AS dst, action FROM e")),
    "edge_index": (edge_index, over_edges("""SELECT DISTINCT x.day, actorID AS src, objectID AS dst, a.i AS src_idx, b.i AS dst_idx FROM (SELECT *, us // 86400000000 AS day FROM e) x
        JOIN idx a ON a.day = x.day AND a.name = actorID JOIN idx b ON b.day = x.day AND b.name = objectID""", DAYS, "idx AS (SELECT day, name, row_number() OVER (PARTITION BY day ORDER BY name) - 1 AS i FROM (SELECT DISTINCT day, name FROM days))")),
    "induced_subgraph": (induced_subgraph, over_edges("SELECT CAST(substr(src, 2) AS INT) % 7 AS community, src, dst FROM pairs WHERE CAST(substr(src, 2) AS INT) % 7 = CAST(substr(dst, 2) AS INT) % 7", PAIRS)),
    "vertex_table": (vertex_table, over_edges("""SELECT day, name, arg_min(type, (us, event_id, side)) AS type, string_agg(DISTINCT prop, '|' ORDER BY prop) AS properties, count(*) AS frequency,
        CASE WHEN name IN (SELECT label FROM labels_) THEN 1 ELSE 0 END AS label FROM days GROUP BY day, name""", DAYS, LABELS)),
    "time_snapshots": (time_snapshots, over_edges("SELECT snapshot_id, count(*) AS n_rows, count(DISTINCT (actorID, objectID)) AS n_edges, min(us) AS first_us FROM snap GROUP BY snapshot_id", SNAP)),
    "snapshot_summary": (snapshot_summary, over_edges("""SELECT a.snapshot_id, n_vertices, n_edges, n_labelled, n_processes FROM (
        SELECT snapshot_id, count(*) AS n_vertices, sum(CASE WHEN name IN (SELECT label FROM labels_) THEN 1 ELSE 0 END)::BIGINT AS n_labelled, count(*) FILTER (type = 'SUBJECT_PROCESS') AS n_processes
        FROM (SELECT snapshot_id, name, arg_min(type, (us, event_id, side)) AS type FROM (SELECT snapshot_id, actorID AS name, actor_type AS type, 0 AS side, us, event_id FROM snap UNION ALL SELECT snapshot_id, objectID, object, 1, us, event_id FROM snap) GROUP BY ALL) GROUP BY snapshot_id) a
        JOIN (SELECT snapshot_id, count(DISTINCT (actorID, objectID)) AS n_edges FROM snap GROUP BY snapshot_id) b USING (snapshot_id)""", SNAP, LABELS)),
    "count_snapshots": (count_snapshots, over_edges("""SELECT (seen - 1) // 20 AS snapshot_id, count(*) AS n_rows, max(seen) AS seen, min(event_id) AS first_event FROM (
        SELECT event_id, sum(fresh) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS seen FROM (
          SELECT e.us, e.event_id, coalesce(f.fresh, 0) AS fresh FROM e LEFT JOIN (SELECT event_id, count(*) AS fresh FROM (SELECT DISTINCT ON (name) name, event_id FROM ends ORDER BY name, us, event_id) GROUP BY event_id) f USING (event_id))) GROUP BY 1""")),
    "lru_evict": (lru_evict, over_edges("""SELECT day, name, last_us, first_us FROM (SELECT *, count(*) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY last_us, first_us, name) AS place
        FROM (SELECT day, name, max(us) AS last_us, min(us) AS first_us FROM days GROUP BY ALL)) WHERE place <= floor(n * 0.3)""", DAYS)),
    "snapshot_sequence": (snapshot_sequence, over_edges("""SELECT category, snapshot_id, row_number() OVER (ORDER BY category <> 'benign', category, snapshot_id) - 1 AS seq
        FROM (SELECT DISTINCT e.category, (us - low) // 300000000 AS snapshot_id FROM e JOIN (SELECT category, min(us) AS low FROM e GROUP BY category) USING (category))""")),
    "snapshot_bounds": (lambda s, d: snapshots.snapshot_bounds(snapshot_sequence(s, d)), over_edges("""SELECT category, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT category, row_number() OVER (ORDER BY category <> 'benign', category, snapshot_id) - 1 AS seq
        FROM (SELECT DISTINCT e.category, (us - low) // 300000000 AS snapshot_id FROM e JOIN (SELECT category, min(us) AS low FROM e GROUP BY category) USING (category))) GROUP BY category""")),
    "snapshot_slice": (lambda s, d: snapshot_sequence(s, d).where("seq between 10 and 40"), over_edges("""SELECT * FROM (SELECT category, snapshot_id, row_number() OVER (ORDER BY category <> 'benign', category, snapshot_id) - 1 AS seq
        FROM (SELECT DISTINCT e.category, (us - low) // 300000000 AS snapshot_id FROM e JOIN (SELECT category, min(us) AS low FROM e GROUP BY category) USING (category))) WHERE seq BETWEEN 10 AND 40""")),
    "node_budget_snapshots": (node_budget, None),
    "dataset_counts": (lambda s, d: graph.dataset_counts(tables.event_edges(s, d)), over_edges("SELECT category, n AS rows, pairs, nodes FROM (SELECT category, count(*) AS n, count(DISTINCT (actorID, objectID)) AS pairs FROM e GROUP BY category) JOIN (SELECT category, count(DISTINCT name) AS nodes FROM ends GROUP BY category) USING (category)")),
    "triples": (triples, over_edges("SELECT h, r, t FROM tri", TRIPLES)),
    "triple_text_join": (triple_text_join, over_edges("SELECT h, r, count(*) AS n, count(DISTINCT t) AS tails FROM tri GROUP BY ALL", TRIPLES)),
    "neighbour_lists": (lambda s, d: joined(graph_neighbours(s, d), "neighbours"), over_edges("SELECT name, string_agg(part, '|' ORDER BY part) AS neighbours FROM (SELECT src AS name, actions || ':' || dst AS part FROM pairs UNION ALL SELECT dst, actions || ':' || src FROM pairs) GROUP BY name", PAIRS)),
}


def graph_neighbours(s, d):
    pairs = graph.edge_actions(tables.event_edges(s, d))
    part = lambda end: F.concat(F.array_join("actions", "|"), F.lit(":"), F.col(end))
    both = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("name"), part("dst").alias("part")), F.struct(F.col("dst").alias("name"), part("src").alias("part")))).alias("x")).select("x.*")
    return both.groupBy("name").agg(F.sort_array(F.collect_list("part")).alias("neighbours"))
